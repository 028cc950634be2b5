from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from idsync.operators.kernels import assign, cosine_match, fuzzy_match, indel_ratio, naive_match, similarity_table, weighted_ratio


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_against_all_permutations(rows, columns, seed):
    profit = np.random.default_rng(seed).integers(0, 10, (rows, columns)).astype(float)
    got = assign(profit)
    taken = got[got >= 0]
    assert len(set(taken.tolist())) == len(taken) == min(rows, columns)
    total = sum(profit[i, j] for i, j in enumerate(got) if j >= 0)
    wide = profit if rows <= columns else profit.T
    best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
    assert abs(total - best) < 1e-9


def rows(prefix, names):
    return [(f"{prefix}{i}", n, n.lower() if n is not None else None) for i, n in enumerate(names)]


def test_cosine_match():
    a, b = rows("a", ["Alpha City", "Beta Town", None]), rows("b", ["Beta Towne", "Alpha City", "Gamma"])
    assert cosine_match(a, b, 0.6) == [("a0", "b1"), ("a1", "b0")]
    assert cosine_match(a, [], 0.5) == []
    assert cosine_match(rows("a", ["AB"]), rows("b", ["ABCD"]), 0.75) == []
    assert cosine_match(rows("a", ["AB"]), rows("b", ["ABCD"]), 0.0) == [("a0", "b0")]
    repeated = cosine_match(rows("a", ["Team 1", "Team 2"]), rows("b", ["Team 1"] * 3), 0.0)
    assert repeated[0] == ("a0", "b0")


def test_similarity_table():
    table = similarity_table(rows("a", ["Alpha City", "Beta Town"]), rows("b", ["Beta Towne", None, "Alpha City"]))
    assert [(r[0], r[2]) for r in table] == [("Beta Town", "Beta Towne"), ("Alpha City", "Alpha City")] and abs(table[1][4] - 1) < 1e-9


def naive_by_loops(a, b):
    used, out = {}, []
    for i, raw, t in a:
        if raw is None or t in used:
            continue
        for j, other, u in b:
            if other is None or u in used.values():
                continue
            if t == u:
                used[t] = u
                out.append((i, j))
    for i, raw, t in a:
        if raw is None or t in used:
            continue
        for j, other, u in b:
            if other is None or u in used.values():
                continue
            if set(t.split(" ")) <= set(u.split(" ")) or set(u.split(" ")) <= set(t.split(" ")):
                used[t] = u
                out.append((i, j))
                break
    return out


NAMES = st.lists(st.one_of(st.none(), st.lists(st.sampled_from("xyz"), min_size=1, max_size=3).map(" ".join)), max_size=7)


@settings(max_examples=200, deadline=None)
@given(NAMES, NAMES)
def test_naive_match_against_nested_loops(x, y):
    a, b = rows("a", x), rows("b", y)
    assert naive_match(a, b) == naive_by_loops(a, b)


def test_fuzzy_match():
    a, b = rows("a", ["maria guadalupe sanchez", "john smith"]), rows("b", ["smith john", "maria sanchez", "nobody", None])
    assert fuzzy_match(a, b, 0.9) == [("a1", "b0")]
    assert fuzzy_match(a, b, 0.85) == [("a1", "b0"), ("a0", "b1")]
    assert fuzzy_match([], b, 0.9) == []


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=8), st.text("abc ", max_size=8))
def test_ratios_are_symmetric_and_bounded(a, b):
    assert 0 <= indel_ratio(a, b) <= 100 and indel_ratio(a, b) == indel_ratio(b, a)
    assert 0 <= weighted_ratio(a, b) <= 100
    assert not a or weighted_ratio(a, a) == 100
