"""Nearest reading in time per entity within a tolerance, as a stateful streaming join.

Both inputs are streams. Each micro-batch adds its rows to the buffers of both sides
(versioned tables in the shared folder, written once per batch and safe to repeat),
advances the watermark (latest arrival so far minus ``delay``), emits every left row whose
horizon ``time + tolerance`` the watermark has passed, and evicts candidates that no
remaining or future left row can reach. The end of the input closes all horizons. Watermark
and number of late rows are a row per batch beside the buffer, written last, so a stream that
stops anywhere goes on from the folder ``path``, and a repeated batch starts from the state before it.

Rows that arrive behind the watermark are not dropped: they go to a late table, and the
left rows they touch (same entity, a cell of time in reach) are matched again against the
sources at the end, so the result is the same for every split into micro-batches, whatever
the first batches hold.

Within a batch nothing is paired: both sides are laid on one time axis per entity and time
cell, and each left row takes the last reading before and the first after it from two
running windows. A cell is a few tolerances wide, so a hot entity is spread over as many
partitions as it has cells; left rows reach at most two cells. Readings of one entity at the
same instant are reduced to the smallest id before the shuffle.

Defined results: null keys or times match nothing; ties in distance go to the smallest
right id; a repeated left id yields one row, the nearest of all its rows; an empty side
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idsync.runtime import exists, remove, scratch, size_of


@dataclass(frozen=True)
class Side:
    """Where a stream comes from (a folder of Parquet files) and which columns it is read by."""

    path: str
    id: str
    time: str
    arrival: str | None
    keys: tuple[str, ...]
    max_bytes_per_trigger: int | None = None
    batches: int | None = None  # instead of a number of bytes: in about so many parts

    def shape(self, df: DataFrame, left: bool) -> DataFrame:
        time = F.unix_micros(F.col(self.time).cast("timestamp"))
        keys = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(self.keys)]
        arrival = F.unix_micros(F.col(self.arrival).cast("timestamp")) if self.arrival else F.lit(None).cast("long")
        shaped = df.select(F.lit(left).alias("is_left"), F.col(self.id).cast("long").alias("id"), time.alias("at"), arrival.alias("arrived"), *keys)
        return shaped.dropna(subset=["id", "at", *(f"k{i}" for i in range(len(keys)))])

    def stream(self, spark: SparkSession, left: bool) -> DataFrame:
        reader = spark.readStream.schema(spark.read.parquet(self.path).schema)
        limit = -(-size_of(spark, self.path) // self.batches) if self.batches else self.max_bytes_per_trigger
        if limit:
            reader = reader.option("maxBytesPerTrigger", str(limit))
        glob = f"{self.path[:-1]}[{self.path[-1]}]"  # as a pattern, the path may be one file or a folder
        return self.shape(reader.parquet(glob), left)

    def table(self, spark: SparkSession, left: bool) -> DataFrame:
        return self.shape(spark.read.parquet(self.path), left)


def cell_of(at: Column, tolerance: int) -> Column:
    return F.floor(at / F.lit(max(4 * tolerance, 1))).cast("long")


def cells_near(tolerance: int) -> Column:
    """A row for each cell within the tolerance of ``at``."""
    return F.explode(F.sequence(cell_of(F.col("at") - tolerance, tolerance), cell_of(F.col("at") + tolerance, tolerance))).alias("cell")


def nearest(rows: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """(id, distance, match) for each left row of ``rows`` with a reading within ``tolerance`` microseconds."""
    left = rows.filter("is_left").select(F.lit(True).alias("is_left"), "id", "at", *keys, cells_near(tolerance))
    right = rows.filter("not is_left").groupBy(*keys, "at").agg(F.min("id").alias("id"))
    right = right.select(F.lit(False).alias("is_left"), "id", "at", *keys, cell_of(F.col("at"), tolerance).alias("cell"))
    reading = F.when(~F.col("is_left"), F.struct("at", "id"))
    before = Window.partitionBy(*keys, "cell").orderBy("at", "is_left").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "cell").orderBy(F.desc("at"), "is_left").rowsBetween(Window.unboundedPreceding, 0)
    near = left.unionByName(right).select(
        "is_left", "id", "at",
        F.last(reading, ignorenulls=True).over(before).alias("b"),
        F.last(reading, ignorenulls=True).over(after).alias("a"),
    ).filter("is_left")
    option: Column = lambda c: F.when(F.abs(F.col(c).at - F.col("at")) <= tolerance, F.struct(F.abs(F.col(c).at - F.col("at")).alias("distance"), F.col(c).id.alias("match")))
    best = near.select("id", F.least(option("b"), option("a")).alias("best")).filter("best is not null")
    return best.groupBy("id").agg(F.min("best").alias("best")).select("id", "best.distance", "best.match")


class NearestTimeJoin:
    """The operator: run both streams to their present end and return (left id, right id).

    ``path`` names a folder of the shared storage that keeps the state; a run on a folder with state goes on from it.
    """

    def __init__(self, left: Side, right: Side, tolerance: int, delay: int, path: str | None = None):
        self.left, self.right, self.tolerance, self.delay, self.root = left, right, tolerance, delay, path
        self.keys = [f"k{i}" for i in range(len(left.keys))]
        self.late = self.batches = 0

    def run(self, spark: SparkSession) -> DataFrame:
        self.root = self.root or scratch(spark, "nearest")
        stream = self.left.stream(spark, True).unionByName(self.right.stream(spark, False))
        query = (
            stream.writeStream.foreachBatch(self._batch)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = self._state(spark)
        if state is None:
            return self._named(nearest(self.left.table(spark, True).unionByName(self.right.table(spark, False)).limit(0), self.keys, self.tolerance))
        self.late, self.batches = state.late, state.epoch + 1
        rows = self._buffer(spark, state.epoch)
        if state.mark is not None:
            rows = rows.filter(self._open(state.mark))
        self._emit(rows, "end")
        found = spark.read.parquet(f"{self.root}/out").select("id", "distance", "match")
        if self.late:
            found = found.unionByName(self._corrections(spark))
            found = found.groupBy("id").agg(F.min(F.struct("distance", "match")).alias("b")).select("id", "b.distance", "b.match")
        return self._named(found)

    def _named(self, found: DataFrame) -> DataFrame:
        return found.select(F.col("id").alias(self.left.id), F.col("match").alias(self.right.id))

    def _state(self, spark: SparkSession, before: int | None = None):
        """The state after the last finished batch (before batch ``before``), or None; one row per batch."""
        if not exists(spark, f"{self.root}/state"):
            return None
        rows = spark.read.schema("epoch long, mark long, late long").parquet(f"{self.root}/state/*")
        return (rows.filter(F.col("epoch") < before) if before is not None else rows).orderBy(F.desc("epoch")).limit(1).first()

    def _buffer(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.parquet(f"{self.root}/buffer/{epoch}").drop("late")

    def _open(self, mark: int) -> Column:
        """Left rows whose horizon the watermark hasn't passed, and readings that such rows can reach."""
        return F.when(F.col("is_left"), F.col("at") + self.tolerance >= mark).otherwise(F.col("at") >= mark - 2 * self.tolerance)

    def _batch(self, rows: DataFrame, epoch: int) -> None:
        spark, tol = rows.sparkSession, self.tolerance
        last = self._state(spark, epoch)
        mark, late = (last.mark, last.late) if last else (None, 0)
        behind = F.lit(False) if mark is None else F.when(F.col("is_left"), F.col("at") + tol < mark).otherwise(F.col("at") < mark)
        added, buffer = rows.withColumn("late", behind), f"{self.root}/buffer/{epoch}"
        if last:
            kept = self._buffer(spark, last.epoch)
            added = added.unionByName((kept.filter(self._open(mark)) if mark is not None else kept).withColumn("late", F.lit(False)))
        added.write.mode("overwrite").parquet(buffer)
        arrived, new = spark.read.parquet(buffer).agg(F.max(F.coalesce("arrived", F.when(~F.col("is_left"), F.col("at")))), F.count_if("late")).first()
        if new:
            spark.read.parquet(buffer).filter("late").write.mode("overwrite").parquet(f"{self.root}/late/epoch={epoch}")
        marks = [m for m in (mark, None if arrived is None else arrived - self.delay) if m is not None]
        ahead = max(marks) if marks else None
        if ahead is not None:
            due = F.when(F.col("is_left"), F.col("at") + tol < ahead).otherwise(F.col("at") < ahead)
            self._emit(self._buffer(spark, epoch).filter(due), str(epoch))
        spark.createDataFrame([(epoch, ahead, late + new)], "epoch long, mark long, late long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/{epoch}")
        remove(spark, f"{self.root}/buffer/{epoch - 2}")  # the one before may be read once more, if this batch is repeated

    def _emit(self, rows: DataFrame, name: str) -> None:
        nearest(rows, self.keys, self.tolerance).write.mode("overwrite").parquet(f"{self.root}/out/epoch={name}")

    def _corrections(self, spark: SparkSession) -> DataFrame:
        late = spark.read.parquet(f"{self.root}/late").select("is_left", "id", "at", "arrived", *self.keys)
        touched = late.select(*self.keys, cells_near(self.tolerance)).distinct()
        in_reach = lambda df: df.withColumn("cell", cell_of(F.col("at"), self.tolerance)).join(touched, [*self.keys, "cell"], "left_semi").drop("cell")
        readings = nearest(in_reach(self.left.table(spark, True)).unionByName(late.filter("not is_left")), self.keys, self.tolerance)
        lefts = nearest(late.filter("is_left").unionByName(in_reach(self.right.table(spark, False))), self.keys, self.tolerance)
        return readings.unionByName(lefts)
