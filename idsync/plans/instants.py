"""Queries over mixed timestamp notations (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsync.operators.timestamps import day_month_order, normalise_timestamps


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_type, record_id, iso_value) of every match and player record with a usable value."""
    matches = spark.read.parquet(f"{sf_dir}/match_records.parquet").select("record_id", "match_date", "kick_off", "venue_zone", "data_provider")
    players = spark.read.parquet(f"{sf_dir}/player_records.parquet").select("record_id", "birth_date", "data_provider")
    orders = day_month_order([(matches, "match_date"), (players, "birth_date")], "data_provider")
    match = normalise_timestamps(matches, "match_date", orders=orders, source="data_provider", clock="kick_off", zone="venue_zone")
    player = normalise_timestamps(players, "birth_date", orders=orders, source="data_provider")
    shown = lambda df, kind: df.filter("iso_value is not null").select(F.lit(kind).alias("record_type"), "record_id", "iso_value")
    return shown(match, "match").unionByName(shown(player, "player"))


QUERIES = {"p6_found": p6_found}
