"""Layered matching of two providers' players or teams inside one block.

The cascades are sequential by nature: each layer works on what the last one left, and
assignment is a global optimum over a block. They run as one Arrow kernel per block (a
match, or a competition and season), reached by a single co-grouped shuffle, on columns that
the JVM has already normalised.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from itertools import product

import pandas as pd

from idsync.operators.kernels import cosine_match, fuzzy_match, naive_match


class Similarity(Enum):
    COSINE = "cosine"
    NAIVE = "naive"
    FUZZY = "fuzzy"


@dataclass(frozen=True)
class PlayerLayer:
    """One strategy: which texts are compared how, and which attributes must agree afterwards."""

    title: str
    method: Similarity = Similarity.COSINE
    date_shift: int | None = 0
    swap_month_day: bool = False
    fields: tuple[str, str] = ("player_name", "player_name")
    equal: tuple[str, ...] = field(default=("birth_date", "team_id"))
    threshold: float = 0.75


NAMES = tuple(product(("player_name", "player_nickname"), repeat=2))


def player_layers(with_birth: bool, with_jersey: bool) -> list[PlayerLayer]:
    """The default strategies in order."""
    out = [PlayerLayer("shirt and team", date_shift=None, equal=("jersey_number", "team_id"))]
    if with_birth:
        out += [PlayerLayer("birth date and team", fields=f, date_shift=d, swap_month_day=swap) for f in NAMES for swap in (False, True) for d in (-1, 0)]
    out += [PlayerLayer("team", date_shift=None, fields=f, equal=("team_id",)) for f in NAMES]
    out += [PlayerLayer("token sets and team", Similarity.NAIVE, None, fields=f, equal=("team_id",)) for f in NAMES]
    last = ("jersey_number", "team_id") if with_jersey else ("team_id",)
    return [*out, PlayerLayer("whatever is left", date_shift=None, equal=last, threshold=0.0)]


def pairs_of(left: pd.DataFrame, right: pd.DataFrame, fields: tuple[str, str], method: Similarity, threshold: float, agree: tuple[list, list] | None = None) -> list[tuple[str, str]]:
    """Id pairs by one method; the frames have id, the raw fields and their normal forms (``n_`` prefix)."""
    rows = lambda df, c: [(i, r, n) for i, r, n in zip(df["id"], df[c], df[f"n_{c}"])]
    a, b = rows(left, fields[0]), rows(right, fields[1])
    if method is Similarity.NAIVE:
        return naive_match(a, b)
    if method is Similarity.FUZZY:
        return fuzzy_match(a, b, threshold)
    return cosine_match(a, b, threshold, agree)


def _attributes(df: pd.DataFrame, columns: list[str]) -> list:
    """What must agree, per row; None where something is unknown."""
    if not columns:
        return [()] * len(df)
    return [None if None in k else k for k in zip(*(df[c] for c in columns))]


def apply_layer(left: pd.DataFrame, right: pd.DataFrame, layer: PlayerLayer) -> list[tuple[str, str]]:
    """Pairs of one layer after its attribute checks; ids with more than one partner are left out."""
    equal = [c for c in layer.equal if c in left.columns]
    shifted = f"{'s' if layer.swap_month_day else 'b'}{layer.date_shift}"
    mine = [shifted if c == "birth_date" and layer.date_shift is not None else c for c in equal]
    one, two = _attributes(left, mine), _attributes(right, equal)
    if not (set(one) & set(two)) - {None}:
        return []
    found = pairs_of(left, right, layer.fields, layer.method, layer.threshold, (one, two))
    of_left, of_right = {}, {}
    for known, ids, keys in ((of_left, left["id"], one), (of_right, right["id"], two)):
        for i, k in zip(ids, keys):
            known.setdefault(i, k)
    found = list(dict.fromkeys((i, j) for i, j in found if of_left[i] is not None and of_left[i] == of_right[j]))
    left_n, right_n = Counter(i for i, _ in found), Counter(j for _, j in found)
    return [(i, j) for i, j in found if left_n[i] == 1 and right_n[j] == 1]


def match_players(left: pd.DataFrame, right: pd.DataFrame, with_jersey: bool, layers: Callable = player_layers) -> list[tuple[str, str]]:
    """All layers, each on what is still open on both sides."""
    dated = bool(left["birth_date"].notna().all() and right["birth_date"].notna().all())
    done: list[tuple[str, str]] = []
    for layer in layers(dated, with_jersey):
        if not len(left) or not len(right):
            break
        new = apply_layer(left, right, layer)
        if new:
            done += new
            left, right = left[~left["id"].isin([i for i, _ in new])], right[~right["id"].isin([j for _, j in new])]
    return done


def match_teams(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple[str, str]]:
    """Optimal assignment of similar names, then of whatever is left."""
    done: list[tuple[str, str]] = []
    for threshold in (0.75, 0.0):
        if not len(left) or not len(right):
            break
        new = pairs_of(left, right, ("team_name", "team_name"), Similarity.COSINE, threshold)
        done += new
        left, right = left[~left["id"].isin([i for i, _ in new])], right[~right["id"].isin([j for _, j in new])]
    return done
