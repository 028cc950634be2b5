"""Look-alikes, variant spellings and the rule cascade on small tables."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idsync.llm.cascade import birth_date, keyed, label_sample, match_cascade
from idsync.llm.lookalikes import CLASSES, Canonical, Lattice, compatible, same_looks
from idsync.llm.variants import CLUBS, PEOPLE, _grams, candidates, edits, link_variants, name_similarity, token_similarity, tokens_of

LATTICE = Lattice({"^a": 5, "an": 9, "no": 4, "ра": 3, "ар": 2, "ос": 2, "ca": 3, "ap": 2})


@pytest.mark.parametrize(
    "given, wanted",
    [("Ａｎｎ　Ｌｅｅ", "Ann Lee"), ("a​b­c", "abc"), (" x y ", "x y"), ("a‑b", "a-b"), ("é", "é"), ("ﬁn", "fin"), ("ｶﾞ", "ガ"), ("​ ", ""), ("a  b", "a  b")],
)
def test_compatible(given, wanted):
    assert compatible(given) == wanted


LETTERS = st.text(st.sampled_from("aаAАoоοbвиpрcс é- "), max_size=8)


@settings(max_examples=300, deadline=None)
@given(LETTERS, LETTERS)
def test_equal_forms_mean_equal_looks(a, b):
    look = lambda t: "".join(CLASSES.get(c, (c,))[0] for c in unicodedata.normalize("NFD", compatible(t)))
    assert (LATTICE(compatible(a)) == LATTICE(compatible(b))) == (look(a) == look(b))


def test_a_word_stays_in_one_script():
    assert LATTICE("аnn") == "ann" and LATTICE("Пpoиc") == "Проис" and LATTICE(None) is None


def test_same_looks(spark):
    rows = [(1, "m", "Ann Lee"), (2, "m", "Аnn Lee"), (3, "m", "Ann Lee"), (4, "n", "Ann Lee"), (5, "m", None), (6, None, "Аnn Lee"), (7, "m", "ann lee"), (8, "m", " Ann Lee"), (9, "m", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "record_id long, match_id string, name string, form string")
    canonical = Canonical.fit(spark, [(df, "name")])
    got = sorted(tuple(r) for r in same_looks(df, "record_id", ["match_id"], "name", canonical).collect())
    assert got == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)]
    empty = df.limit(0)
    assert same_looks(empty, "record_id", ["match_id"], "name", Canonical.fit(spark, [(empty, "name")])).count() == 0


def test_tokens_and_edits():
    assert tokens_of("Łeé, Ann-Mary Jr.") == ["lee", "ann", "mary"] and tokens_of("КасТаранов") == ["кас", "таранов"] and tokens_of(None) == []
    assert tokens_of("FC Alpha U-19 Women", True) == ["alpha"] and tokens_of("Ann (GK)") == ["ann"]
    assert (edits("abcd", "abdc", 2), edits("abcd", "abxd", 2), edits("abc", "xyz", 2)) == (1, 1, 3)
    assert token_similarity("jose", "pepe", False) == 0.9 and token_similarity("a", "ann", False) == 0.8 and token_similarity("ann", "zoe", False) == 0


@pytest.mark.parametrize("a, b, alike", [("Ann Lee", "Lee, Ann", 1), ("A. Leewood", "Ann Leewood", 1), ("Ann Maria Leewood", "Ann Leewood", 1), ("Ann Leewood", "Zoe Leewood", 0), ("Ann Lee", "Bob Ray", 0), ("KimMin", "Kim Min", 1)])
def test_name_similarity(a, b, alike):
    x, y = tokens_of(a), tokens_of(b)
    s, conflict = name_similarity(x, y, [1.0] * len(x), [1.0] * len(y), False)
    assert (s - 0.6 * conflict >= 0.5) == bool(alike)


def link(spark, rows, weights=PEOPLE):
    schema = "rid long, m string, src string, pid string, form string, nick string, b string, j string, tokens string, uid long"
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], schema)
    return sorted(tuple(r) for r in link_variants(df, key="rid", blocks=["m"], source="src", source_id="pid", form="form", nickname="nick", evidence=["b", "j"], weights=weights).collect())


def test_variants(spark):
    rows = [
        (1, "m", "x", "1", "Ann Leewood", None, "1990-01-01", "7"), (2, "m", "y", "1", "Leewood, A.", None, "1990-01-01", None), (3, "m", "z", "5", "Ann Lewood", "Annie", None, "7"),
        (4, "m", "y", "2", "Zoe Leewood", None, "1995-05-05", "9"), (5, "n", "y", "1", "Ann Leewoood", None, "1990-01-01", "7"), (6, "m", "x", "9", None, None, None, None), (7, "m", "x", "1", "Ann Leewood", None, "1990-01-01", "7"),
        (8, "m", "z", "8", "", None, None, None), (9, "m", "x", "1", "Anne Leewood", None, None, None), (10, "m", "z", "11", "Kim " * 2000, None, None, None),
    ]
    assert link(spark, rows) == [(1, 2), (1, 3), (1, 9), (2, 3), (2, 7), (2, 9), (3, 7), (3, 9), (7, 9)]
    assert link(spark, []) == []


def test_variants_that_share_no_gram(spark):
    """An initial and a slip leave no gram in common; the birth date or the shirt finds the pair inside its block."""
    rows = [(1, "m", "x", "1", "Dong-hwa Tak", None, "1990-01-01", None), (2, "m", "y", "1", "D. Tk", None, "1990-01-01", None), (3, "n", "x", "1", "Dong-hwa Tak", None, None, "7"), (4, "n", "y", "1", "D. Tk", None, None, "7"), (5, "o", "y", "1", "D. Tk", None, "1990-01-01", "7")]
    schema = "rid long, m string, src string, pid string, form string, nick string, b string, j string"
    df = spark.createDataFrame(rows, schema)
    link = lambda **more: sorted(tuple(r) for r in link_variants(df, key="rid", blocks=["m"], source="src", source_id="pid", form="form", nickname="nick", evidence=["b", "j"], weights=PEOPLE, **more).collect())
    assert link(exact=("b", "j")) == [(1, 2), (3, 4)] and link(exact=("b",)) == [(1, 2)]


def test_variants_by_nickname(spark):
    """A nickname finds its pair: against the other's name, and against the other's nickname."""
    rows = [
        (1, "m", "x", "1", "Dong-hwa Tak", None, None, None), (2, "m", "y", "1", "D. Tk", "Dong-hwa Tak", None, None),
        (3, "n", "x", "2", "N. Gawk", "Nam-jin Gwak", None, None), (4, "n", "y", "2", "Nm. Gk", "Nam-jin Gwak", None, None), (5, "n", "y", "3", "Zoe Leewood", "Zozo", None, None),
    ]
    assert link(spark, rows) == [(1, 2), (3, 4)]


def test_clubs(spark):
    rows = [(1, "m", "x", "1", "FC Racing Town", None, "A", "K"), (2, "m", "y", "1", "Racing Town", None, "A", "K"), (3, "m", "y", "2", "AC Dynamo Town", None, "B", "L"), (4, "m", "x", "2", "Dynamo Town (AC)", None, "B", "L")]
    assert link(spark, rows, CLUBS) == [(1, 2), (3, 4)]


def test_team_is_evidence(spark):
    """A null team is neutral; another team weighs against a pair, but birth date and shirt outweigh it."""
    rows = [
        (1, "m", "x", "1", "Ann Leewood", "1990-01-01", "7", "t"), (2, "m", "y", "1", "Leewood, Ann", "1990-01-01", "7", None), (3, "n", "x", "2", "Bo Marsh", "1991-01-01", "8", "t"),
        (4, "n", "y", "2", "Marsh, Bo", "1991-01-01", "8", "u"), (5, "o", "x", "3", "Cy Dorn", "1992-01-01", "9", "t"), (6, "o", "y", "3", "Dornn, C.", "1993-01-01", "3", "u"),
    ]
    df = spark.createDataFrame(rows, "rid long, m string, src string, pid string, form string, b string, j string, team string")
    found = link_variants(df, key="rid", blocks=["m"], source="src", source_id="pid", form="form", nickname=None, evidence=["b", "j", "team"], weights=PEOPLE, exact=("b", "j"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (3, 4)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcdeßé"), max_size=9), st.text(st.sampled_from("abcdeßé"), max_size=9), st.integers(1, 2))
def test_letter_sets_bound_edits(a, b, most):
    """The quick bound leaves the distance as it is: against the plain recursion."""
    from functools import lru_cache

    @lru_cache(None)
    def plain(i, j):
        if not i or not j:
            return i + j
        best = min(plain(i - 1, j) + 1, plain(i, j - 1) + 1, plain(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return min(best, plain(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else best

    assert edits(a, b, most) == min(plain(len(a), len(b)), most + 1)


def test_prefix_filter_loses_nothing(spark):
    """All pairs of sources that share 40 % of the smaller gram set, against brute force."""
    names = ["ann lee", "ana leewood", "leewood", "bo", "anna lee may", "zed zed", "lee"]
    grams = lambda t: {g for w in t.split() for v in ["^" + w + "$"] for g in [v[i : i + 3] for i in range(max(1, len(v) - 2))]}
    df = spark.createDataFrame([(i, "m", f"s{i % 2}", n.split()) for i, n in enumerate(names)], "uid long, b string, source string, tokens array<string>")
    got = {tuple(r) for r in candidates(df.withColumns({"set": F.lit(0), "grams": _grams(F.col("tokens"), 3)}), ["b"], 0.4).collect()}
    wanted = {(i, j) for i in range(7) for j in range(i + 1, 7) if i % 2 != j % 2 and len(grams(names[i]) & grams(names[j])) >= 0.4 * min(len(grams(names[i])), len(grams(names[j])))}
    assert wanted <= got


def test_birth_dates(spark):
    given = ["1990-05-31", "31.05.1990", "31.05.90", "01.02.05", "1990-02-30", "1990", None, "x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    got = [str(r.y) if r.y else None for r in df.select("i", birth_date(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == ["1990-05-31"] * 3 + ["2005-02-01", None, None, None, None]


PEOPLE_SCHEMA = "k long, name string, birth string, shirt string, team string, tokens string"


def keys(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], PEOPLE_SCHEMA)
    return keyed(df, "k", F.col("name"), F.col("birth"), F.col("shirt"), F.col("team"))


def test_cascade(spark):
    left = keys(spark, [(1, "Ann Leewood", "1990-05-30", "7", "FC Alpha Town"), (2, "Bo Marsh", "1991-01-02", "8", "Beta City"), (3, "Bo Marsh", "1985-07-07", "9", "Gamma United"), (4, None, None, None, None), (5, "Cy Dorn", None, "3", "Delta")])
    right = keys(
        spark,
        [(101, "Leewood, A.", "30.05.90", "7", None), (102, "ann leewod", "31.05.1990", None, "Alpha Town FC"), (103, "Bo Marsh", "02.01.1991", None, None), (104, "Bo Marsh", None, None, None), (105, "Nobody Here", "01.01.2001", "1", "Omega"), (106, None, None, None, None), (107, "Cy Dorn", "1999", "3", "Delta")],
    )
    found = match_cascade(left, right)
    got = {r.r: (r.l, r.rule, r.confidence) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {101: 1, 102: 1, 103: 2, 107: 5}  # 104 fits two people
    assert got[103][1:] == ("name birth", 0.5)
    assert match_cascade(left.limit(0), right).count() == 0 and match_cascade(left, right.limit(0)).count() == 0
    doubled = left.unionByName(left.withColumn("id", F.col("id") + 50))
    assert match_cascade(doubled, right).count() == 0  # each report fits two rows


def test_strictest_rule_decides(spark):
    """The report agrees with 1 in name and birth, with 2 in name, team and shirt: the stricter rule wins, and no weaker one is asked."""
    left = keys(spark, [(1, "Ann Leewood", "1990-05-30", None, None), (2, "Ann Leewood", None, "7", "Alpha")])
    right = keys(spark, [(101, "Ann Leewood", "1990-05-30", "7", "Alpha")])
    assert [(r.l, r.rule) for r in match_cascade(left, right).collect()] == [(1, "name birth")]


def test_joins_are_not_left_to_estimates(spark):
    """No join of exploded keys, or with whole sides, may become a broadcast."""
    from idsync.llm.cascade import PASSES, joined, judged

    side = keys(spark, [(1, "Ann Leewood", "1990-05-30", "7", "Alpha")]).withColumn("world", F.lit(0))
    plan = judged(joined(side, side, PASSES[1]), side, side, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cascade_with_slips_in_all_tokens(spark):
    """No name token is equal or sounds equal; birth date with shirt or team finds the pair, if the names are near."""
    left = keys(spark, [(1, "Traiwand Tuchaindedin", "1990-05-30", "7", "Alpha"), (2, "Ba-kyeong Drurt", "1991-01-02", "8", "Beta"), (3, "Zoe Marsh", "1992-03-04", "9", "Gamma")])
    right = keys(spark, [(101, "Trai Tuehaindedin", "1990-05-30", "7", None), (102, "B. rurt", "1991-01-02", None, "Beta"), (103, "Ann Leewood", "1992-03-04", "9", None)])
    assert {(r.l, r.r, r.rule) for r in match_cascade(left, right).collect()} == {(1, 101, "birth shirt"), (2, 102, "birth team")}


def test_precision(spark):
    """Of two pairs that name and birth date resolve one is of one person: (1 + 1) / (2 + 2)."""
    rows = keys(spark, [(1, "Ann Lee", "1990-05-30", "7", "t"), (2, "Ann Lee", "1990-05-30", "7", "t"), (3, "Bo Ray", "1991-05-30", "8", "u"), (4, "Bo Ray", "1991-05-30", "8", "u")])
    tied = rows.withColumn("person", F.when(F.col("id") == 4, "q").otherwise(F.when(F.col("id") == 3, "r").otherwise("p"))).withColumn("first", F.col("id").isin(1, 3))
    left, right = keys(spark, [(7, "Cy Dorn", "1990-05-30", "3", "Delta")]), keys(spark, [(8, "Cy Dorn", "1990-05-30", None, None)])
    assert [(r.l, r.r, r.confidence) for r in match_cascade(left, right, tied).collect()] == [(7, 8, pytest.approx(2 / 4))]


def test_label_sample(spark):
    df = spark.createDataFrame([(i, f"p{i // 3}") for i in range(300)] + [(999, None)], "v long, p string")
    all_, some = label_sample(df, "p", "v"), label_sample(df, "p", "v", 100)
    assert all_.count() == 300 and all_.filter("first").count() == 100
    assert 0 < some.count() < 200 and some.groupBy("p").count().filter("count <> 3").count() == 0
