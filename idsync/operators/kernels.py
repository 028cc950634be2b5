"""Matching steps without a relational form, for one bounded block at a time."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np


def assign(profit: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of the largest total; -1 for rows without one.

    Shortest augmenting paths with potentials, one row at a time; ties go to the lower column.
    """
    rows, columns = profit.shape
    if rows > columns:
        back = assign(profit.T)
        out = np.full(rows, -1, "int64")
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    cost = profit.max(initial=0.0) - profit
    u, v = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1, "int64")
    for r in range(rows):
        reach, way, done = np.full(columns, np.inf), np.full(columns, -1, "int64"), np.zeros(columns, bool)
        row, at, visited = r, -1, []
        shortest = 0.0
        while True:
            through = shortest + cost[row] - u[row] - v
            better = ~done & (through < reach - 1e-12)
            reach[better], way[better] = through[better], at
            open_ = np.where(done, np.inf, reach)
            at = int(open_.argmin())
            shortest = float(open_[at])
            done[at] = True
            visited.append(at)
            if owner[at] < 0:
                break
            row = int(owner[at])
        u[r] += shortest
        for j in visited[:-1]:
            gap = shortest - reach[j]
            u[owner[j]] += gap
            v[j] -= gap
        while at >= 0:
            before = int(way[at])
            owner[at] = r if before < 0 else owner[before]
            at = before
    out = np.full(rows, -1, "int64")
    taken = np.flatnonzero(owner >= 0)
    out[owner[taken]] = taken
    return out


@lru_cache(maxsize=20_000)
def trigrams(text: str, n: int = 3) -> dict[str, int]:
    """The runs of ``n`` characters with their counts, after blanks and , - . / ; are deleted."""
    text = re.sub(r"[,\-./;]|\s", "", text)
    return Counter(text[i : i + n] for i in range(len(text) - n + 1))


def cosine_matrix(left: list[str], right: list[str]) -> np.ndarray:
    """Cosines of smoothed TF-IDF trigram vectors, right x left; the vocabulary is that of both lists."""
    bags = [trigrams(t) for t in [*left, *right]]
    place: dict[str, int] = {}
    for b in bags:
        for g in b:
            place.setdefault(g, len(place))
    matrix = np.zeros((len(bags), max(1, len(place))))
    for i, b in enumerate(bags):
        for g, n in b.items():
            matrix[i, place[g]] = n
    idf = np.log((1 + len(bags)) / (1 + (matrix > 0).sum(0))) + 1
    matrix *= idf
    norm = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
    return matrix[len(left) :] @ matrix[: len(left)].T


Row = tuple[str, "str | None", "str | None"]  # id, raw text, normalised text


def cosine_match(left: list[Row], right: list[Row], threshold: float, agree: tuple[list, list] | None = None) -> list[tuple[str, str]]:
    """Pairs by optimal assignment of TF-IDF cosines, then cut at the threshold, joined back on the raw text; one per left id.

    ``agree`` holds what must be equal afterwards, per row; if no pair over the threshold agrees, the
    assignment cannot contribute and is not computed.
    """
    a, b = [r for r in left if r[1] is not None], [r for r in right if r[1] is not None]
    if not a or not b:
        return []
    matrix = cosine_matrix([r[2] for r in a], [r[2] for r in b])
    if agree is not None:
        x = [k for k, r in zip(agree[0], left) if r[1] is not None]
        y = [k for k, r in zip(agree[1], right) if r[1] is not None]
        rows: dict = {}
        for i, k in enumerate(x):
            rows.setdefault(k, []).append(i)
        floor = max(min(threshold, 1.0), 0.0) - 1e-9
        if not any(k is not None and k in rows and (matrix[j, rows[k]] >= floor).any() for j, k in enumerate(y)):
            return []
    column = assign(matrix)
    limit = max(min(threshold, 1.0), 0.0)
    met = [(float(matrix[i, j]), i, int(j)) for i, j in enumerate(column) if j >= 0 and matrix[i, j] >= limit]
    met.sort(key=lambda m: (-m[0], m[1]))
    best: dict[str, list[tuple[float, str]]] = {}
    for s, i, j in met:
        best.setdefault(a[j][1], []).append((s, b[i][1]))
    partners: dict[str, str] = {}
    for r in right:
        if r[1] is not None:
            partners.setdefault(r[1], r[0])
    return [(r[0], partners[best[r[1]][0][1]]) for r in left if r[1] is not None and r[1] in best]


def similarity_table(left: list[Row], right: list[Row]) -> list[tuple]:
    """(text 1, normal form 1, text 2, normal form 2, cosine) of the optimal assignment, in the order of the right side."""
    a, b = [r for r in left if r[1] is not None], [r for r in right if r[1] is not None]
    if not a or not b:
        raise ValueError("both sides need a text that is not null")
    matrix = cosine_matrix([r[2] for r in a], [r[2] for r in b])
    return [(a[j][1], a[j][2], b[i][1], b[i][2], float(matrix[i, j])) for i, j in enumerate(assign(matrix)) if j >= 0]


def naive_match(left: list[Row], right: list[Row]) -> list[tuple[str, str]]:
    """Equal normalised texts first, then one token set within the other; each text serves once."""
    first = lambda rows: {t: i for i, _, t in reversed([r for r in rows if r[1] is not None])}
    a, b = first(left), first(right)
    order = lambda rows: list(dict.fromkeys(r[2] for r in rows if r[1] is not None))
    out = [(a[t], b[t]) for t in order(left) if t in b]
    used_a, used_b = {t for t in a if t in b}, {t for t in b if t in a}
    sets = {t: set(re.split(r"\s+", t)) for t in [*a, *b]}
    for x in order(left):
        if x in used_a:
            continue
        for y in order(right):
            if y not in used_b and (sets[x] <= sets[y] or sets[y] <= sets[x]):
                used_a.add(x)
                used_b.add(y)
                out.append((a[x], b[y]))
                break
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def indel_ratio(a: str, b: str) -> float:
    """100 times the share of letters that insertions and deletions leave."""
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0
    windows = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
    return max(indel_ratio(a, w) for w in windows if w)


def _set_ratio(a: set[str], b: set[str], ratio) -> float:
    shared = " ".join(sorted(a & b))
    one, two = (" ".join(filter(None, (shared, " ".join(sorted(x - y))))) for x, y in ((a, b), (b, a)))
    if shared and (a <= b or b <= a):
        return 100.0
    scores = [ratio(one, two)]
    if shared:
        scores += [ratio(shared, one), ratio(shared, two)]
    return max(scores)


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, sorted-token and token-set ratios, with partial forms for texts of uneven length."""
    if not a or not b:
        return 0.0
    sorted_ = lambda t: " ".join(sorted(t.split()))
    sets = (set(a.split()), set(b.split()))
    uneven = max(len(a), len(b)) / min(len(a), len(b))
    base = indel_ratio(a, b)
    if uneven < 1.5:
        return max(base, 0.95 * indel_ratio(sorted_(a), sorted_(b)), 0.95 * _set_ratio(*sets, indel_ratio))
    scale = 0.9 if uneven <= 8 else 0.6
    shared = 100.0 if sets[0] & sets[1] else partial_ratio(sorted_(a), sorted_(b))
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * shared)


def fuzzy_match(left: list[Row], right: list[Row], threshold: float) -> list[tuple[str, str]]:
    """Each distinct right text with its best left text, if that reaches the threshold and isn't taken."""
    a = [r for r in left if r[1] is not None]
    limit, taken, out, seen = 100 * max(min(threshold, 1.0), 0.0), set(), [], set()
    for rid, raw, text in right:
        if raw is None or text in seen or not a:
            continue
        scores = [round(weighted_ratio(text, r[2])) for r in a]
        k = int(math.nan if not scores else np.argmax(scores))
        if scores[k] >= limit and a[k][2] not in taken:
            taken.add(a[k][2])
            seen.add(text)
            out.append((a[k][0], rid))
    return out
