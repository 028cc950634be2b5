"""The pipeline around a synchronisation: knock out what is known, flag repeats, choose metadata, name and store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsync.functions.text import normalize
from idsync.runtime import cut


def squish(rows: DataFrame, key: str, others: list[str]) -> DataFrame:
    """One row per non-null ``key``; every other id if the key has just one, else null."""
    only = lambda c: F.when(F.count_distinct(c) <= 1, F.min(c)).alias(c)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*(only(c) for c in others))


def fill_upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates fill what is null in the target and add rows with new keys; nothing is overwritten."""
    others = [c for c in target.columns if c != key]
    new = updates.filter(F.col(key).isNotNull()).select(key, *(F.col(c).alias(f"{c}_new") if c in updates.columns else F.lit(None).alias(f"{c}_new") for c in others))
    keyless = target.filter(F.col(key).isNull())
    joined = target.filter(F.col(key).isNotNull()).join(new, key, "outer")
    return joined.select(key, *(F.coalesce(c, f"{c}_new").alias(c) for c in others)).unionByName(keyless).select(*target.columns)


def drop_known(rows: DataFrame, known: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of which no id is known; one anti-join per provider instead of one join on alternatives."""
    return reduce(lambda df, c: df.join(known.select(c).dropna().distinct(), c, "left_anti"), ids, rows).select(*rows.columns)


def knock_out(preliminary: DataFrame, known: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(open rows, known ids): provider by provider, rows with ids that are already known join the known list and leave."""
    for key in ids:
        hit = preliminary.join(known.select(key).dropna().distinct(), key, "left_semi")
        known = cut(fill_upsert(known, squish(hit, key, [c for c in ids if c != key]), key))
        preliminary = cut(drop_known(preliminary, known, [key]))
    return preliminary, known


def flag_duplicates(rows: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """``is_duplicate``: some id of the row has occurred in an earlier row."""
    later = lambda c: F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy(c).orderBy(*order)) > 1)
    marks = rows.withColumns({f"_dup_{c}": later(c) for c in ids})
    return marks.withColumn("is_duplicate", reduce(lambda a, b: a | b, [F.col(f"_dup_{c}") for c in ids])).drop(*(f"_dup_{c}" for c in ids))


def metadata_priority(rows: DataFrame, priority: dict[str, list[str]]) -> DataFrame:
    """Each field from the first of its columns that has a value."""
    used = [c for columns in priority.values() for c in columns]
    return rows.withColumns({name: F.coalesce(*columns) for name, columns in priority.items()}).drop(*(c for c in used if c not in priority))


def name_prefix(name: Column, length: int = 10) -> Column:
    return F.substring(F.regexp_replace(normalize(name), " ", ""), 1, length)


def durable_ids(new: DataFrame, existing: DataFrame, group: str, name: str, order: list[str], out: str = "durable_id") -> DataFrame:
    """group-prefix-n for each new row; n goes on from the highest that the prefix has."""
    highest = existing.select(F.regexp_extract(out, r"^(.*)-\d+$", 1).alias("_stem"), F.regexp_extract(out, r"-(\d+)$", 1).cast("long").alias("n")).groupBy("_stem").agg(F.max("n").alias("_last"))
    stem = F.concat_ws("-", F.col(group), name_prefix(F.col(name)))
    placed = new.withColumn("_stem", stem).withColumn("_n", F.row_number().over(Window.partitionBy("_stem").orderBy(*order)))
    joined = placed.join(highest, "_stem", "left")
    return joined.withColumn(out, F.concat_ws("-", "_stem", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("string"))).drop("_stem", "_n", "_last")


def upsert(target: DataFrame, updates: DataFrame, key: str, stamp: Column | None = None) -> DataFrame:
    """All columns but the key from the update where there is one; new keys are added.

    With ``stamp``, ``created_at`` is kept and ``updated_at`` set on changed rows.
    """
    others = [c for c in target.columns if c != key and c not in ("created_at", "updated_at")]
    new = updates.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"{c}_new") for c in others))
    joined = target.withColumn("_old", F.lit(True)).join(new, key, "outer")
    columns = [F.when(F.col("_new"), F.col(f"{c}_new")).otherwise(F.col(c)).alias(c) for c in others]
    if stamp is not None:
        columns += [F.when(F.col("_old"), F.col("created_at")).otherwise(stamp).alias("created_at"), F.when(F.col("_new"), stamp).otherwise(F.col("updated_at")).alias("updated_at")]
    return joined.select(key, *columns)


def crosswalk_metrics(crosswalk: DataFrame, metrics: list[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """Per crosswalk row the sum of each provider's metric; providers without the object stay null."""
    out = crosswalk.select(key, *dict.fromkeys(i for _, i, _ in metrics))
    for df, provider_id, metric in metrics:
        out = out.join(df.groupBy(provider_id).agg(F.sum(metric).alias(metric)), provider_id, "left")
    return out


def outer_metrics(frames: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Full outer join of metric tables on the crosswalk key, largest metrics first."""
    joined = reduce(lambda a, b: a.join(b, key, "outer"), frames)
    return joined.orderBy(*(F.desc(c) for c in order), key)


def recode(value: Column, codes: dict, default=None) -> Column:
    """A code for each known value, else the default."""
    return reduce(lambda c, item: c.when(value == F.lit(item[0]), F.lit(item[1])), list(codes.items())[1:], F.when(value == F.lit(next(iter(codes))), F.lit(codes[next(iter(codes))]))).otherwise(F.lit(default))


def extract(provider: DataFrame, lookups: list[tuple[DataFrame, str, str]], columns: list[str]) -> DataFrame:
    """A provider's rows with the unified ids of the objects they refer to: inner joins (lookup, provider's id, unified id)."""
    out = reduce(lambda df, x: df.join(x[0].select(x[1], x[2]).dropna(), x[1]), lookups, provider)
    return out.select(*columns)
