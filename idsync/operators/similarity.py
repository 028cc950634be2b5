"""Blocked TF-IDF trigram cosine as joins and aggregations.

N and document frequencies are counted per block over both sides, smoothed as
ln((1 + N) / (1 + df)) + 1; the cosine is the sum over shared grams of L2-normalised weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsync.functions.text import ngrams, normalize


def tfidf_edges(left: DataFrame, right: DataFrame, *, block: list[str], left_id: str, left_text: str, right_id: str, right_text: str) -> DataFrame:
    """(block, i, j, similarity) of all pairs of one block that share a trigram."""
    side = lambda df, k, i, t: df.filter(F.col(t).isNotNull()).select(*block, F.lit(k).alias("side"), F.col(i).cast("string").alias("id"), normalize(F.col(t)).alias("text"))
    rows = side(left, 1, left_id, left_text).unionByName(side(right, 2, right_id, right_text))
    total = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("total"))
    grams = rows.select(*block, "side", "id", F.explode(ngrams(F.col("text"))).alias("gram")).groupBy(*block, "gram", "side", "id").agg(F.count(F.lit(1)).alias("tf"))
    often = grams.groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("df"))
    weighed = grams.join(often, [*block, "gram"]).join(total, block)
    weighed = weighed.withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*block, "side", "id")))
    weighed = weighed.withColumn("w", F.col("w") / norm).select(*block, "gram", "side", "id", "w")
    a = weighed.filter("side = 1").select(*block, "gram", F.col("id").alias("i"), F.col("w").alias("wi"))
    b = weighed.filter("side = 2").select(*block, "gram", F.col("id").alias("j"), F.col("w").alias("wj"))
    return a.join(b, [*block, "gram"]).groupBy(*block, "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("similarity"))


def best_partner(edges: DataFrame, block: list[str], least: float) -> DataFrame:
    """Each i's most similar j at or over ``least``; ties go to the smaller j."""
    order = Window.partitionBy(*block, "i").orderBy(F.desc("similarity"), "j")
    limit = max(min(least, 1.0), 0.0)
    return edges.filter(F.col("similarity") >= limit).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def ranked(edges: DataFrame, by: list[str], most: int) -> DataFrame:
    """Edges with their dense rank by similarity within ``by``, up to rank ``most``."""
    return edges.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("similarity")))).filter(F.col("rank") <= most)


def agreeing(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The pairs (i, j) whose records agree in all ``fields`` that the left side has; null agrees with nothing, a field that only the right side lacks is an error."""
    used = [f for f in fields if f in left.columns]
    if missing := [f for f in used if f not in right.columns]:
        raise ValueError(f"the right side lacks {', '.join(missing)}")
    side = lambda df, name: df.select(F.col(key).alias(name), *(F.col(f).alias(f"{f}_{name}") for f in used))
    joined = pairs.join(side(left, "i"), "i").join(side(right, "j"), "j")
    for f in used:
        joined = joined.filter(F.col(f"{f}_i") == F.col(f"{f}_j"))
    return joined.select("i", "j")


def back_join(pairs: DataFrame, left: DataFrame, right: DataFrame, block: list[str], key: str, text: str) -> DataFrame:
    """(block, i, j) of all records that bear the raw texts of ``pairs`` (x on the left, y on the right)."""
    side = lambda df, name, t: df.select(*block, F.col(text).alias(t), F.col(key).alias(name))
    return pairs.join(side(left, "i", "x"), [*block, "x"]).join(side(right, "j", "y"), [*block, "y"]).select(*block, "i", "j")
