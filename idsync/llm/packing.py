"""Filling containers of fixed capacity with whole texts, by multiway differencing.

An item larger than the capacity is split into full pieces, each a container of its own, and
a remainder. All other pieces are spread over shards of about ``shard_items`` by a hash of
their id, so a shard is a fair sample of the sizes and no task ever holds more. Within
a shard, Karmarkar-Karp differencing keeps partial partitions into k windows and
merges the two with the largest spread, the largest window of one with the smallest of the
other, until one partition is left; k starts at what the sum needs and rises while any
window exceeds the capacity. Waste is at most about one container in a shard.

Defined results: a size of 0 or null is an item of size 0 and still gets a container; every
item comes out whole unless it alone exceeds the capacity; equal sizes merge in order of the
item id, so a result repeats exactly (unless one id has more rows than a shard); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsync.runtime import cut, ship


MOST_PARTITIONS = 20_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item, by k-way differencing."""
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, "int64")
    after = np.full(n, -1, "int64")
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def take(i: int):
        if i in parts:
            return parts.pop(i)
        load, head, tail = np.zeros(k, "int64"), np.full(k, -1, "int64"), np.full(k, -1, "int64")
        load[-1], head[-1], tail[-1] = sizes[i], i, i
        return load, head, tail

    fresh = n
    while len(heap) > 1:
        a, b = take(heapq.heappop(heap)[1]), take(heapq.heappop(heap)[1])
        load, h1, t1 = a
        other, h2, t2 = b[0][::-1], b[1][::-1], b[2][::-1]
        load = load + other
        both = (h1 >= 0) & (h2 >= 0)
        after[t1[both]] = h2[both]
        head, tail = np.where(h1 >= 0, h1, h2), np.where(h2 >= 0, t2, t1)
        order = np.argsort(load, kind="stable")
        load, head, tail = load[order], head[order], tail[order]
        load = load - load[0]
        parts[fresh] = (load, head, tail)
        heapq.heappush(heap, (-int(load[-1]), fresh))
        fresh += 1
    out = np.zeros(n, "int64")
    for window, i in enumerate(take(heap[0][1])[1].tolist()):
        while i >= 0:
            out[i] = window
            i = int(after[i])
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none above ``capacity``; every size is at most the capacity."""
    sizes = sizes.astype("int64")
    k = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    while True:
        windows = differencing(sizes, k)
        over = np.maximum(np.bincount(windows, sizes, k) - capacity, 0).sum()
        if not over:
            return windows
        k += max(1, int(over) // capacity)


def fill_containers(items: DataFrame, key: str, size: str, capacity: int, shard_items: int = 4096) -> DataFrame:
    """(key, piece_no, container_id, size): the container of each item or piece."""
    if capacity < 1 or shard_items < 1:
        raise ValueError("capacity and shard_items must be at least 1")
    ship(items.sparkSession)
    sized = items.select(F.col(key).cast("long").alias("id"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0)).alias("size"))
    full = F.floor(F.col("size") / capacity).cast("long")
    rest = F.col("size") - full * capacity
    count = F.greatest(full + F.when(rest > 0, 1).otherwise(0), F.lit(1))
    pieces = sized.select("id", "size", full.alias("full"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = cut(pieces.select("id", "piece", F.monotonically_increasing_id().alias("row"), F.when(F.col("piece") < F.col("full"), F.lit(capacity)).otherwise(F.col("size") - F.col("full") * capacity).cast("long").alias("size")))
    total, most = pieces.groupBy("id", "piece").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shards = max(1, -(-total // shard_items))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "piece", "size", "row"], kind="stable", ignore_index=True)
        sizes = group["size"].to_numpy()
        whole = sizes >= capacity
        container = np.zeros(len(group), "int64")
        windows = pack(sizes[~whole], capacity) if (~whole).any() else np.zeros(0, "int64")
        container[~whole] = windows
        container[whole] = (windows.max() + 1 if len(windows) else 0) + np.arange(whole.sum())
        return pd.DataFrame({"id": group["id"], "piece_no": group["piece"], "container_id": group["shard"] * (1 << 24) + container, "size": sizes})

    # an id with more rows than a shard holds is spread by row; a number of partitions of its own keeps heavy shards apart
    spread = ["id", "piece", "row"] if most > shard_items else ["id", "piece"]
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64(*spread), F.lit(shards)))
    packed = sharded.repartition(min(shards, MOST_PARTITIONS), "shard").groupBy("shard").applyInPandas(run, "id long, piece_no long, container_id long, size long")
    return packed.select(F.col("id").alias(key), "piece_no", "container_id", F.col("size").alias(size))
