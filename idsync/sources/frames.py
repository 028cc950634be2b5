"""Reading, splitting, uniting and conforming provider tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file as strings, without type inference."""
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON documents (one per file), or with ``multi_line=False`` one object per line, which splits large files."""
    return spark.read.option("multiLine", multi_line).json(path)


def unnest(df: DataFrame, column: str, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """A row for each element of the list ``column``: the columns ``keep`` and ``fields`` (name: path inside the element)."""
    return df.select(*keep, F.explode(column).alias("_e")).select(*keep, *(F.col(f"_e.{path}").alias(name) for name, path in fields.items()))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def id_text(c: Column) -> Column:
    """An id as plain text; numbers lose their zero decimals."""
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def providers_of(long: DataFrame) -> list[str]:
    """The providers that have rows, sorted; there are few of them."""
    return sorted(r[0] for r in long.select("data_provider").dropna().distinct().collect())


def split_by_provider(long: DataFrame, object_type: str, providers: list[str] | None = None) -> dict[str, DataFrame]:
    """One frame per provider with its own id column, in order of their names; without ``providers`` those that have rows."""
    generic, out = f"provider_{object_type}_id", {}
    for p in sorted(providers) if providers is not None else providers_of(long):
        own = long.filter(F.col("data_provider") == p).drop("data_provider")
        out[p] = own.withColumn(generic, id_text(F.col(generic))).withColumnRenamed(generic, f"{p}_{object_type}_id")
    return out


def collect_union(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """All frames under each other, by name."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(*columns) for f in frames])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def coalesce_suffixes(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """For each c with c_x and c_y: c becomes the first that isn't null, the two go."""
    for c in [columns] if isinstance(columns, str) else list(columns):
        if {f"{c}_x", f"{c}_y"} <= set(df.columns):
            df = df.withColumn(c, F.coalesce(f"{c}_x", f"{c}_y")).drop(f"{c}_x", f"{c}_y")
    return df


def clean_suffixes(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """For each c with c_x and c_y: c_x becomes c, c_y goes."""
    for c in [columns] if isinstance(columns, str) else list(columns):
        if {f"{c}_x", f"{c}_y"} <= set(df.columns):
            df = df.drop(f"{c}_y").withColumnRenamed(f"{c}_x", c)
    return df
