import random

import pytest

from idsync.llm.components import connected_components, link_groups, plain_number
from pyspark.sql import functions as F


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                root(x)
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


CASES = {
    "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(90)],
    "star": [("hub", f"s{i}") for i in range(200)],
    "self, reversed, repeated, null": [("a", "a"), ("b", "c"), ("c", "b"), ("c", "b"), ("d", None), (None, None), (None, "e")],
    "empty": [],
    "random": [(f"x{random.Random(i).randrange(150)}", f"x{random.Random(-i).randrange(150)}") for i in range(1, 120)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_union_find(spark, name):
    df = spark.createDataFrame([(*p, "junk") for p in CASES[name]], "l string, r string, node string")
    got = {r.node: r.component for r in connected_components(df, "l", "r").collect()}
    assert got == union_find(CASES[name])


def test_ids_as_plain_numbers(spark):
    given = ["12", " 12 ", "0012", "12.0", "12.00", "+12", "0", "000", "x1", "", " ", None, "12.5"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    got = [r.y for r in df.select("i", plain_number(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == ["12"] * 6 + ["0", "0", "x1", None, None, None, "12.5"]


def test_kinds_and_providers_are_apart(spark):
    rows = [("match", "p", "1", "q", "2.0"), ("team", "p", "1", "q", "3"), ("match", "q", " 2", "r", "10"), ("team", "q", "2", None, None), (None, "p", "9", "q", "9")]
    df = spark.createDataFrame(rows, "kind string, lp string, lo string, rp string, ro string")
    got = sorted(tuple(r) for r in link_groups(df, "kind", ("lp", "lo"), ("rp", "ro")).collect())
    assert got == [("match", "p:1", "p:1"), ("match", "q:2", "p:1"), ("match", "r:10", "p:1"), ("team", "p:1", "p:1"), ("team", "q:2", "q:2"), ("team", "q:3", "p:1")]
