"""Driver queries of sources, projections and joins around the engines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsync.functions import text
from idsync.operators.content import Content
from idsync.operators.engine import MatchSyncEngine, PlayerSyncEngine, TeamSyncEngine
from idsync.operators.similarity import agreeing, back_join, ranked
from idsync.plans import oracle, pipeline
from idsync.plans.queries import _long_contents, _read, _team_edges, matches
from idsync.runtime import scratch
from idsync.sources.frames import conform, providers_of, read_csv, read_json, read_parquet, save_table, unnest


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read as strings."""
    path, columns = scratch(spark, "csv"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    _read(spark, sf_dir, "customer").select(*columns).write.option("header", True).csv(path)
    return read_csv(spark, path, columns)


def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a list of items as nested JSON, read and taken apart again."""
    path = scratch(spark, "json")
    items = F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.struct(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("supplier")).alias("part")))
    _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items")).write.json(path)
    return unnest(read_json(spark, path, multi_line=False), "items", {"line": "line", "part_id": "part.id", "supplier": "part.supplier"}, ["l_orderkey"])


def extraction_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders, suppliers = _read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0"), _read(spark, sf_dir, "supplier")
    lookups = [(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "o_custkey"), (suppliers.withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey", "s_nationkey")]
    return pipeline.extract(lines, lookups, ["l_orderkey", "l_linenumber", "o_custkey", "s_nationkey"])


def save_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table, written twice; the second replaces the first."""
    path, rows = scratch(spark, "saved"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    save_table(rows.filter("o_orderkey % 2 = 0"), path, ["o_orderstatus"])
    save_table(rows, path, ["o_orderstatus"])
    return read_parquet(spark, path)


def value_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
    return _read(spark, sf_dir, "orders").select("o_orderkey", pipeline.recode(F.col("o_orderpriority"), codes, 9).alias("code"))


def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.StructType([T.StructField("c_name", T.StringType()), T.StructField("b_team_id", T.StringType()), T.StructField("c_custkey", T.StringType())])
    return conform(_read(spark, sf_dir, "customer"), wanted)


def provider_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers found in the table itself, with their rows of a null name left out; one that has no row is no provider."""
    rows = _read(spark, sf_dir, "player_records").filter("player_nickname is not null")
    return spark.createDataFrame([(p, k) for k, p in enumerate(providers_of(rows))], "provider string, place int")


def outer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders"))
    events = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("events"))
    parts = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count_distinct("l_partkey").alias("parts"))
    out = pipeline.outer_metrics([orders, events, parts], "key", ["orders", "events", "parts"])
    return out.select("key", *(F.col(c).cast("double").alias(c) for c in ("orders", "events", "parts")))


def upsert_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    target = o.filter("o_orderkey % 2 = 0").withColumns({"created_at": old, "updated_at": old})
    out = pipeline.upsert(target, o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("N")), "o_orderkey", now)
    return out.select("o_orderkey", "o_orderstatus", F.date_format("created_at", "yyyy").alias("created"), F.date_format("updated_at", "yyyy").alias("updated"))


def similarity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, block = _team_edges(spark, sf_dir)
    return ranked(edges.withColumn("similarity", F.round("similarity", 6)), [*block, "i"], 3)


def equal_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two providers' records of one name in a match that also agree in shirt and team; null agrees with nothing."""
    rows = _read(spark, sf_dir, "player_records")
    side = lambda p, name: rows.filter(F.col("data_provider") == p).select("match_id", "player_name", F.col("record_id").alias(name))
    pairs = side("provider_a", "i").join(side("provider_b", "j"), ["match_id", "player_name"]).select("i", "j")
    attributes = rows.select("record_id", "jersey_number", "team_id")
    return agreeing(pairs, attributes, attributes, "record_id", ["jersey_number", "team_id"])


def back_join_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of raw names with one normal form, joined back to all records that bear them."""
    rows = _read(spark, sf_dir, "team_records").filter("team_name is not null")
    block = ["competition_id", "season_id"]
    side = lambda p, name: rows.filter(F.col("data_provider") == p).select(*block, F.col("team_name").alias(name), text.normalize(F.col("team_name")).alias("n")).distinct()
    pairs = side("provider_a", "x").join(side("provider_c", "y"), [*block, "n"]).drop("n")
    own = lambda p: rows.filter(F.col("data_provider") == p).select(*block, "record_id", "team_name")
    return back_join(pairs, own("provider_a"), own("provider_c"), block, "record_id", "team_name")


def team_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = ("competition_id", "season_id")
    a, b, _ = _long_contents(spark, sf_dir, "team_records", "team", block, ["team_name"])
    return TeamSyncEngine([a, b], use_competition_context=True).on_equal_names(a, b)


def id_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id columns of a frame: those that contain the type's id, wherever."""
    rows = matches(spark, sf_dir, "a").select("a_match_id", "match_date", F.col("a_match_id").alias("b_match_id_old"), F.col("away_team_id"))
    content = Content("match", "a", rows)
    return content.data.select(*content.id_columns())


def player_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a player row keeps beside the ids."""
    columns = ["player_name", "player_nickname", "birth_date", "team_id", "jersey_number"]
    a, b, _ = _long_contents(spark, sf_dir, "player_records", "player", ("match_id",), columns)
    return PlayerSyncEngine([a, b]).metadata(a).drop("_pos")


def match_sync_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two providers inside competitions and seasons, all blocks in one plan."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("competition_id"), F.year("o_orderdate").cast("string").alias("season_id"))

    def content(p: str) -> Content:
        first = {"a": 0, "b": 10_000_000}[p]
        rows = matches(spark, sf_dir, p).withColumn("o_orderkey", F.col("_row") - first).join(o, "o_orderkey").drop("o_orderkey")
        return Content.of("match", p, rows, block=("competition_id", "season_id"), order_by="_row")

    return MatchSyncEngine([content("a"), content("b")], use_competition_context=True).synchronize().data


QUERIES = {
    f.__name__: f
    for f in (
        csv_scan, json_unnest, extraction_joins, save_and_read, value_recode, conform_schema, provider_list, outer_metrics, upsert_stamped, similarity_ranks, equal_attributes, back_join_texts, team_exact,
        id_columns, player_metadata, match_sync_blocked,
    )
}

_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {block}, data_provider, {id} ORDER BY record_id) AS n FROM {table}) WHERE n = 1"
_TEAMS = _FIRST.format(block="competition_id, season_id", id="provider_team_id", table="team_records")
_PLAYERS = _FIRST.format(block="match_id", id="provider_player_id", table="player_records")
_BLOCKED = oracle.MATCH_SYNC_2.replace("'h' || o_custkey AS", "o_orderpriority || '|' || year(CAST(o_orderdate AS DATE)) || '|h' || o_custkey AS")

ORACLE = {
    "csv_scan": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer",
    "json_unnest": "SELECT l_orderkey, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supplier FROM lineitem",
    "extraction_joins": "SELECT l_orderkey, l_linenumber, o_custkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderkey % 3 <> 0",
    "save_and_read": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "value_recode": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END AS code FROM orders",
    "conform_schema": "SELECT c_name, CAST(NULL AS VARCHAR) AS b_team_id, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer",
    "provider_list": "SELECT data_provider AS provider, CAST(row_number() OVER (ORDER BY data_provider) - 1 AS INT) AS place FROM (SELECT DISTINCT data_provider FROM player_records WHERE player_nickname IS NOT NULL)",
    "outer_metrics": """SELECT key, CAST(orders AS DOUBLE) AS orders, CAST(events AS DOUBLE) AS events, CAST(parts AS DOUBLE) AS parts FROM (SELECT o_custkey AS key, count(*) AS orders FROM orders GROUP BY 1)
      FULL JOIN (SELECT user_id AS key, count(*) AS events FROM events GROUP BY 1) USING (key) FULL JOIN (SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) USING (key)""",
    "upsert_stamped": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '2024' ELSE '2025' END AS created,
      CASE WHEN o_orderkey % 3 = 0 THEN '2025' ELSE '2024' END AS updated FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
    "similarity_ranks": f"{oracle.EDGES} SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY competition_id, season_id, i ORDER BY similarity DESC) AS INT) AS rank FROM edges) WHERE rank <= 3",
    "equal_attributes": """SELECT x.record_id AS i, y.record_id AS j FROM player_records x JOIN player_records y USING (match_id, player_name)
      WHERE x.data_provider = 'provider_a' AND y.data_provider = 'provider_b' AND x.jersey_number = y.jersey_number AND x.team_id = y.team_id""",
    "back_join_texts": f"""WITH n AS ({oracle._NORM}) SELECT competition_id, season_id, x.record_id AS i, y.record_id AS j FROM n x JOIN n y USING (competition_id, season_id, t)
      WHERE x.data_provider = 'provider_a' AND y.data_provider = 'provider_c'""",
    "team_exact": f"""WITH r AS ({_TEAMS}) SELECT competition_id, season_id, x.provider_team_id AS provider_a_team_id, y.provider_team_id AS provider_b_team_id FROM r x JOIN r y USING (competition_id, season_id, team_name)
      WHERE x.data_provider = 'provider_a' AND y.data_provider = 'provider_b'""",
    "id_columns": "SELECT CAST(o_orderkey AS VARCHAR) AS a_match_id, CAST(o_orderkey AS VARCHAR) AS b_match_id_old FROM orders",
    "player_metadata": f"WITH r AS ({_PLAYERS}) SELECT match_id, player_name, player_nickname, jersey_number, team_id, provider_player_id AS provider_a_player_id FROM r WHERE data_provider = 'provider_a'",
    "match_sync_blocked": f"""SELECT split_part(home_team_id, '|', 1) AS competition_id, split_part(home_team_id, '|', 2) AS season_id, match_date, split_part(home_team_id, '|', 3) AS home_team_id, away_team_id,
      a_match_id, b_match_id, provider FROM ({_BLOCKED})""",
}
