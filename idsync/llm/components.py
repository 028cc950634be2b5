"""Connected components over pairwise links by alternating large-star and small-star rewrites.

Nodes are strings; a component is named by its smallest node in character order. Keys are spelt
once and written; nodes are numbered once in their order, so the rewrites move pairs of numbers
only. An edge points from its larger to its smaller node. Large-star links every edge's larger end to
the smallest node around its smaller end, small-star a node and its smaller neighbours to the smallest
of them; each is one minimum per node, combined before the shuffle, and one equi-join. A hub is
only ever hot on the edge side, which adaptive execution splits; no neighbour list is ever gathered.
After each pair of rewrites the edges are written to the shared folder, and the table before is removed;
the loop ends when the set of edges no longer changes (count and order-free hashes). Components that
are stars with no other edge at any of their nodes can't change any more and leave the loop.

Defined results: null, blank and self links add a node but no edge; repeated and reversed
links count once; no links give an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsync.runtime import remove, stored

MAX_ROUNDS = 200
SPLITS = (0, 3)  # rounds after which settled components leave


def plain_number(value: Column) -> Column:
    """An id as a plain whole number: no blanks, leading zeros, plus sign or zero decimals; other ids only trimmed, blank ones null."""
    value = value.cast("string")
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    digits = F.regexp_extract(text, r"^\+?0*([0-9]+)(?:\.0*)?$", 1)
    plain = (value != "") & ~value.startswith("0") & (F.translate(value, "0123456789", "") == "")  # most are; no pattern needed
    return F.when(plain, value).when(digits != "", digits).when(text != "", text)


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it; repeated edges may come out."""
    low = _lowest(edges).withColumnRenamed("u", "v")
    return edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    low = _lowest(edges)
    moved = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def _unsettled(edges: DataFrame) -> DataFrame:
    """(v): nodes with an edge that isn't one of a star: its larger end has another edge."""
    inner = edges.groupBy("u").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("u").unionByName(edges.select(F.col("v").alias("u"))).distinct()
    odd = edges.join(inner, "u", "left_semi")
    return odd.select("v").unionByName(odd.select(F.col("u").alias("v"))).distinct()


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, n): numbers in the order of the nodes, from a range partitioning and the place in each partition."""
    spread = nodes.repartitionByRange("node").sortWithinPartitions("node")
    return stored(spread.select("node", F.monotonically_increasing_id().alias("n")), "nodes")[0]


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every non-null value of ``left`` and ``right``."""
    spark = links.sparkSession
    pairs, _ = stored(links.select(F.col(left).alias("a"), F.col(right).alias("b")), "links")
    nodes = numbered(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).dropna().distinct())
    linked = pairs.dropna().filter("a <> b").join(nodes.select(F.col("node").alias("a"), F.col("n").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("y")), "b")
    edges, path = stored(linked.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before, settled = _state(edges), []
    for round_ in range(MAX_ROUNDS):
        new, new_path = stored(_small_star(_large_star(edges)), "edges")
        if round_ in SPLITS:
            open_, _ = stored(_unsettled(new), "open")
            settled.append(stored(new.join(open_, "v", "left_anti").select("u", "v"), "settled")[0])
            new, new_path = stored(new.join(open_, "v", "left_semi").select("u", "v"), "edges")
        remove(spark, path)
        edges, path, after = new, new_path, _state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    edges = reduce(lambda a, b: a.unionByName(b), settled, edges)
    named = edges.join(nodes.select(F.col("n").alias("v"), F.col("node").alias("component")), "v").select(F.col("u").alias("n"), "component")
    return nodes.join(named, "n", "left").select("node", F.coalesce("component", "node").alias("component"))


def link_groups(links: DataFrame, kind: str, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """(kind, node_key, group_key): components of provider ids that never cross ``kind``."""

    def key(provider: str, number: str) -> Column:
        whole = plain_number(F.col(number))
        return F.when(F.col(kind).isNotNull() & F.col(provider).isNotNull() & whole.isNotNull(), F.concat(F.col(kind), F.lit("\u0001"), F.col(provider), F.lit(":"), whole))

    grouped = connected_components(links.select(key(*left).alias("l"), key(*right).alias("r")), "l", "r")
    part = lambda c, i: F.split(F.col(c), "\u0001", 2)[i]
    return grouped.select(part("node", 0).alias(kind), part("node", 1).alias("node_key"), part("component", 1).alias("group_key"))
