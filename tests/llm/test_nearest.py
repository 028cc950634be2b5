from datetime import datetime, timedelta

import pytest

from idsync.llm.nearest import NearestTimeJoin, Side

HOUR = 3_600_000_000
T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "fid long, at timestamp, h string, a string, id string", "rid long, at timestamp, h string, a string, got timestamp, is_left string"


def run(spark, path, left, right, files=1, delay=24 * HOUR, trigger=None):
    spark.createDataFrame([(*r, "x") for r in left], LEFT).coalesce(1).write.parquet(f"{path}/l")
    step = max(1, -(-len(right) // files))
    for k in range(0, max(1, len(right)), step):
        spark.createDataFrame([(*r, "y") for r in right[k : k + step]], RIGHT).coalesce(1).write.mode("append").parquet(f"{path}/r")
    op = NearestTimeJoin(Side(f"{path}/l", "fid", "at", None, ("h", "a")), Side(f"{path}/r", "rid", "at", "got", ("h", "a"), trigger), 6 * HOUR, delay)
    return sorted((r.fid, r.rid) for r in op.run(spark).collect()), op


def brute(left, right):
    out = {}
    for fid, t, *k in left:
        near = [(abs(t - u), rid) for rid, u, h, a, _ in right if t and u and None not in k and [h, a] == k and abs(t - u) <= timedelta(hours=6)]
        if near and fid is not None:
            out[fid] = min([out[fid], min(near)]) if fid in out else min(near)
    return sorted((f, r) for f, (_, r) in out.items())


def test_limits_ties_and_nulls(spark, tmp_path):
    h = lambda x: T0 + timedelta(hours=x)
    left = [(1, h(0), "x", "y"), (2, h(100), "x", "y"), (3, None, "x", "y"), (4, h(0), None, "y"), (5, h(50), "y", "x"), (6, h(200), "x", "y"), (6, h(300), "x", "y")]
    right = [
        (10, h(6), "x", "y", h(6)), (11, h(-6), "x", "y", h(6)),  # equally far, inclusive: the smaller id
        (21, h(101), "x", "y", h(101)), (20, h(101), "x", "y", h(102)), (22, h(99), "x", "y", h(99)),
        (30, None, "x", "y", h(0)), (31, h(0), None, "y", h(0)), (32, h(50), "x", "y", h(50)), (40, h(206.1), "x", "y", h(206)), (41, h(301), "x", "y", h(301)),
    ]
    got, _ = run(spark, tmp_path, left, right)
    assert got == brute(left, right) == [(1, 10), (2, 20), (6, 41)]


@pytest.mark.parametrize("delay", [0, 48])
def test_any_split_gives_the_same(spark, tmp_path, delay):
    """Many files as micro-batches, rows up to days late, one pair of teams with half of all rows."""
    import random

    rnd = random.Random(delay)
    pick = lambda: ("hot", "x") if rnd.random() < 0.5 else (f"t{rnd.randrange(4)}", "x")
    left = [(i, T0 + timedelta(minutes=rnd.randrange(20_000)), *pick()) for i in range(60)]
    right = []
    for i in range(200):
        at = T0 + timedelta(minutes=rnd.randrange(20_000))
        right.append((i, at, *pick(), at + timedelta(minutes=rnd.choice([0, 1, 4000]))))
    right.sort(key=lambda r: r[4])
    got, op = run(spark, tmp_path, left, right, files=4, delay=delay * HOUR, trigger=1)
    assert got == brute(left, right)
    assert op.late if delay == 0 else True


@pytest.mark.parametrize("sides", [(0, 1), (1, 0), (0, 0)])
def test_empty_sides(spark, tmp_path, sides):
    left, right = [(1, T0, "x", "y")][: sides[0]], [(10, T0, "x", "y", T0)][: sides[1]]
    assert run(spark, tmp_path, left, right)[0] == []


H = lambda x: T0 + timedelta(hours=x)
FIRSTS = {
    "unusable": [(90, None, "x", "y", None), (91, H(0), None, "y", None)],
    "readings of others": [(92, H(0), "z", "z", H(0))],
    "late ones": [(93, H(500), "x", "y", H(500))],
    "none": [],
}


@pytest.mark.parametrize("first", FIRSTS)
@pytest.mark.parametrize("lefts_later", [False, True])
def test_first_batches_lose_nothing(spark, tmp_path, first, lefts_later):
    """The first batch holds no reading of use, or no left row at all; one file per batch."""
    left = [(1, H(0), "x", "y"), (2, H(30), "x", "y"), (3, H(499), "x", "y")]
    right = [*FIRSTS[first], (10, H(1), "x", "y", H(1)), (20, H(29), "x", "y", H(29))]
    write(spark, f"{tmp_path}/l", [(9, None, "x", "y")] if lefts_later else left, LEFT)
    if lefts_later:
        write(spark, f"{tmp_path}/l", left, LEFT)
    for r in (FIRSTS[first], right[-2:-1], right[-1:]):
        write(spark, f"{tmp_path}/r", r, RIGHT)
    op = NearestTimeJoin(Side(f"{tmp_path}/l", "fid", "at", None, ("h", "a"), 1), Side(f"{tmp_path}/r", "rid", "at", "got", ("h", "a"), 1), 6 * HOUR, 24 * HOUR)
    assert sorted((r.fid, r.rid) for r in op.run(spark).collect()) == brute(left, right)
    assert op.batches > 1


def write(spark, path, rows, schema):
    spark.createDataFrame([(*r, "x") for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Three runs on one folder, a new operator each; the second adds rows that change what the first found at its end."""
    import random

    rnd = random.Random(7)
    left = [(i, H(rnd.randrange(300)), "hot", "x") for i in range(40)]
    right = [(i, at, "hot", "x", at + timedelta(hours=rnd.choice([0, 1, 60]))) for i, at in enumerate(H(rnd.randrange(300)) for _ in range(120))]
    right.sort(key=lambda r: r[4])
    parts = [(left[:20], right[:30]), (left[20:], right[30:80]), ([], right[80:])]
    for a, b in parts:
        write(spark, f"{tmp_path}/l", a, LEFT)
        write(spark, f"{tmp_path}/r", b, RIGHT)
        op = NearestTimeJoin(Side(f"{tmp_path}/l", "fid", "at", None, ("h", "a")), Side(f"{tmp_path}/r", "rid", "at", "got", ("h", "a"), 1), 6 * HOUR, 24 * HOUR, f"{tmp_path}/state")
        got = sorted((r.fid, r.rid) for r in op.run(spark).collect())
    assert got == brute(left, right)
    assert op.late
