"""Incremental upkeep of a unified table from a stream of provider rows.

Each micro-batch is reduced to the latest row per key and merged into the next version of
the table; versions are written whole and named by the batch, so a repeated batch
replaces its own version and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsync.plans.pipeline import upsert
from idsync.runtime import scratch


def latest(rows: DataFrame, key: str, recent: str) -> DataFrame:
    """One row per key: the last by ``recent`` (null first)."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(F.col(recent).alias("_at"), *others)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in others))


class IncrementalTable:
    """A table that a stream keeps up to date."""

    def __init__(self, spark: SparkSession, start: DataFrame, key: str, recent: str, path: str | None = None):
        self.spark, self.key, self.recent = spark, key, recent
        self.root = path or scratch(spark, "increments")
        start.write.mode("overwrite").parquet(f"{self.root}/start")
        self.version = "start"

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version}")

    def _batch(self, rows: DataFrame, epoch: int) -> None:
        if self.version == f"v{epoch}":
            return
        merged = upsert(self.table(), latest(rows, self.key, self.recent), self.key)
        merged.write.mode("overwrite").parquet(f"{self.root}/v{epoch}")
        self.version = f"v{epoch}"

    def drain(self, stream: DataFrame) -> DataFrame:
        """Take in all that the stream has now."""
        query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.table()
