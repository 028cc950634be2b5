import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idsync.llm.packing import differencing, fill_containers, pack


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(50, 90))
def test_no_window_exceeds_the_capacity(sizes, capacity):
    sizes = np.array(sizes, "int64")
    windows = pack(sizes, capacity) if len(sizes) else np.zeros(0, "int64")
    assert len(windows) == len(sizes)
    if len(sizes):
        assert np.bincount(windows, sizes).max() <= capacity


def test_windows_are_nearly_equal():
    sizes = np.random.default_rng(3).integers(1, 100, 400)
    sums = np.bincount(differencing(sizes, 20), sizes, 20)
    assert sums.max() - sums.min() <= 2


def test_containers(spark):
    rows = [(i, (i * 37) % 90, "x") for i in range(300)] + [(1000, 250, "x"), (1001, 200, "x"), (1002, None, "x"), (1003, 0, "x"), (1004, 100, "x")]
    out = fill_containers(spark.createDataFrame(rows, "doc long, tokens int, container_id string"), "doc", "tokens", 100, shard_items=64).toPandas()
    assert out.groupby("container_id").tokens.sum().max() <= 100
    per = out.groupby("doc").tokens.agg(["sum", "count"])
    assert all(per.loc[i, "sum"] == (n or 0) for i, n, _ in rows)
    assert per.loc[1000, "count"] == 3 and per.loc[1001, "count"] == 2 and per.loc[1004, "count"] == 1 and per.loc[1002, "count"] == 1
    assert (per["count"] == 1).sum() == len(rows) - 2
    again = fill_containers(spark.createDataFrame(rows[::-1], "doc long, tokens int, c string"), "doc", "tokens", 100, shard_items=64).toPandas()
    key = ["doc", "piece_no", "container_id", "tokens"]
    assert out.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "doc long, tokens int")
    assert fill_containers(df, "doc", "tokens", 10).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, "doc", "tokens", 0)
