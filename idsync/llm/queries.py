"""Driver queries of the llm operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsync.llm.bpe import encode, token_counts
from idsync.llm.cascade import keyed, label_sample, match_cascade
from idsync.llm.components import link_groups
from idsync.llm.lookalikes import Canonical, same_looks
from idsync.llm.nearest import NearestTimeJoin, Side
from idsync.llm.packing import fill_containers
from idsync.llm.repetition import banded, repetitive
from idsync.llm.survivors import described, survivors, usable_date, wording
from idsync.llm.variants import CLUBS, PEOPLE, link_variants
from idsync.operators.timestamps import day_month_order, normalise_timestamps
from idsync.runtime import cut

HOUR = 3_600_000_000
TEAMS = ("home_team_id", "away_team_id")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Canonical]:
    """Player and team records, and the canonical form fitted on all their names."""
    players, teams = _read(spark, sf_dir, "player_records"), _read(spark, sf_dir, "team_records")
    return players, teams, Canonical.fit(spark, [(players, "player_name"), (teams, "team_name")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fixture_id, feed_id): the reading nearest to each fixture, at most 6 hours away; readings may come 10 days late."""
    fixtures = Side(f"{sf_dir}/fixture_list.parquet", "fixture_id", "match_date", None, TEAMS)
    readings = Side(f"{sf_dir}/match_feed.parquet", "feed_id", "match_date", "received_at", TEAMS, batches=4)
    return NearestTimeJoin(fixtures, readings, tolerance=6 * HOUR, delay=10 * 24 * HOUR).run(spark)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_type, node_key, group_key): the group of every record on either side of id_links."""
    return link_groups(_read(spark, sf_dir, "id_links"), "object_type", ("left_provider", "left_object_id"), ("right_provider", "right_object_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_type, id_1, id_2): records of one person or team under names that look different."""
    players, teams, canonical = _named(spark, sf_dir)
    orders = day_month_order([(players, "birth_date")], "data_provider")
    players = normalise_timestamps(players, "birth_date", orders=orders, source="data_provider", out="birth")
    players = players.withColumns({"form": canonical.form("player_name"), "nick": canonical.form("player_nickname")})
    people = link_variants(
        players, key="record_id", blocks=["match_id"], source="data_provider", source_id="provider_player_id", form="form", nickname="nick",
        evidence=["birth", "jersey_number", "team_id"], weights=PEOPLE, exact=("birth", "jersey_number"),
    )
    clubs = link_variants(
        teams.withColumn("form", canonical.form("team_name")), key="record_id", blocks=["competition_id", "season_id"], source="data_provider",
        source_id="provider_team_id", form="form", nickname=None, evidence=["ussf_country_id", "team_confederation", "team_gender", "team_age_group"], weights=CLUBS,
    )
    return people.select(F.lit("player").alias("record_type"), "*").unionByName(clubs.select(F.lit("team").alias("record_type"), "*"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, field_name, version_id): the surviving row of each person's field by trust, then recency, then id."""
    return survivors(_read(spark, sf_dir, "squad_versions"), _read(spark, sf_dir, "provider_ranks"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, with the posterior of the surviving value and the number of values judged true."""
    best = described(_read(spark, sf_dir, "squad_versions"), _read(spark, sf_dir, "provider_ranks"))
    return best.withColumn("posterior", F.round("posterior", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_type, id_1, id_2): records of a block whose names look the same and differ as stored."""
    players, teams, canonical = _named(spark, sf_dir)
    people = same_looks(players, "record_id", ["match_id"], "player_name", canonical)
    clubs = same_looks(teams, "record_id", ["competition_id", "season_id"], "team_name", canonical)
    return people.select(F.lit("player").alias("record_type"), "*").unionByName(clubs.select(F.lit("team").alias("record_type"), "*"))


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reg_id, scout_id, rule, confidence): each report with the registry row of its player, if any."""
    registry, reports, labelled = (_read(spark, sf_dir, t) for t in ("player_registry", "scout_reports", "squad_versions"))
    canonical = Canonical.fit(spark, [(registry, "player_name"), (reports, "player_name"), (registry, "team_name"), (reports, "team_name")])
    keys = lambda df, key, team: keyed(df, key, canonical.form("player_name"), F.col("birth_date"), F.col("jersey_number"), team)
    sides = [keys(df, key, canonical.form("team_name")) for df, key in ((registry, "reg_id"), (reports, "scout_id"))]
    labelled = label_sample(labelled.filter(wording(F.col("player_name")).isNotNull()), "person_id", "version_id").withColumn("birth_date", F.when(usable_date(F.col("birth_date")), F.col("birth_date")))
    tied = keys(labelled, "version_id", F.col("team_id")).join(labelled.select(F.col("version_id").alias("id"), F.col("person_id").alias("person"), "first"), "id")
    found = match_cascade(*sides, tied)
    return found.select(F.col("l").alias("reg_id"), F.col("r").alias("scout_id"), "rule", F.round("confidence", 6).alias("confidence"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reg_id, scout_id): registry rows and reports on the same person."""
    return p7_matches(spark, sf_dir).select("reg_id", "scout_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text by byte_bpe_50k."""
    return encode(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece_no, container_id, tokens): every text in containers of 4096 tokens."""
    return fill_containers(token_counts(_read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "tokens", 4096)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents with at least a third of their letters in repeated passages."""
    return repetitive(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id")


def p10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, perplexity, band) of every document with words."""
    return banded(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("perplexity", F.round("perplexity", 6))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_survivors, p4_found, p5_found, p7_found, p7_matches, p8_ids, p9_containers, p10_found, p10_perplexity)}
