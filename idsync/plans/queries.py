"""Driver queries of the core operators, over whole tables.

Two or three providers' views of one thing are derived from the given tables by fixed rules
(ids shifted, some rows left out, dates moved, names written differently).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idsync.functions import dates, text
from idsync.operators.content import POS, Content
from idsync.operators.engine import MatchSyncEngine, PlayerSyncEngine, TeamSyncEngine
from idsync.operators.kernels import cosine_match, fuzzy_match, naive_match
from idsync.operators.similarity import best_partner, tfidf_edges
from idsync.plans import pipeline
from idsync.runtime import ship, tasks
from idsync.sources.frames import clean_suffixes, coalesce_suffixes, collect_union, split_by_provider


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text_query(table: str, key: str, column: str, fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, table).select(key, fn(F.col(column)).alias("value"))

    return query


def _players(column: str, fn):
    return _text_query("player_records", "record_id", column, fn)


def _teams(fn):
    return _text_query("team_records", "record_id", "team_name", fn)


TEXT = {
    "clean_spaces": _players("player_name", text.clean_spaces),
    "remove_accents": _players("player_name", text.remove_accents),
    "non_word_chars": _players("player_name", text.non_word_chars),
    "double_spaces": _players("player_name", text.double_spaces),
    "womens_suffixes": _teams(text.womens_suffixes),
    "youth_suffixes": _teams(text.youth_suffixes),
    "common_suffixes": _teams(text.common_suffixes),
    "common_prefixes": _teams(text.common_prefixes),
    "normalize_text": _players("player_name", text.normalize),
    "normalize_team_names": _teams(text.normalize_team_names),
    "ngrams3": _teams(lambda c: F.array_join(text.ngrams(text.normalize(c)), "|")),
    "token_sets": _teams(lambda c: F.array_join(F.array_sort(text.token_set(text.normalize(c))), "|")),
    "date_parse_any": _text_query("squad_versions", "version_id", "birth_date", lambda c: F.date_format(dates.parse_date(c), "yyyy-MM-dd")),
    "date_shift": _text_query("squad_versions", "version_id", "birth_date", lambda c: dates.shift_date(c, -1)),
    "date_swap": _text_query("squad_versions", "version_id", "birth_date", dates.swap_month_day),
}


# --- matches derived from orders -------------------------------------------------------------


def matches(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    """One provider's matches: every order is a match of two teams on a day."""
    o = _read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    key = F.col("o_orderkey")
    if provider == "b":
        o = o.filter(key % 7 != 0).withColumn("d", F.when(key % 3 == 0, F.expr("date_add(d, cast(o_orderkey % 5 as int) - 2)")).otherwise(F.col("d")))
    if provider == "c":
        o = o.filter(key % 4 != 0).withColumn("d", F.when(key % 5 == 0, F.date_add("d", 1)).otherwise(F.col("d")))
    first = {"a": 0, "b": 10_000_000, "c": 20_000_000}[provider]
    return o.select(
        (key + first).cast("string").alias(f"{provider}_match_id"), F.date_format("d", "yyyy-MM-dd").alias("match_date"),
        F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("home_team_id"), F.concat(F.lit("a"), (key % 20).cast("string")).alias("away_team_id"),
        F.when(key % 11 != 0, F.weekofyear(F.to_date("o_orderdate")).cast("string")).alias("matchday"), (key + first).alias("_row"),
    )


def _match_contents(spark: SparkSession, sf_dir: str, providers: str) -> list[Content]:
    return [Content.of("match", p, matches(spark, sf_dir, p), order_by="_row") for p in providers]


def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = matches(spark, sf_dir, "a"), matches(spark, sf_dir, "b")
    keys = ["match_date", "home_team_id", "away_team_id"]
    return a.join(b.select(*keys, "b_match_id"), keys, "left").select("a_match_id", "b_match_id")


def match_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _match_contents(spark, sf_dir, "ab")
    return MatchSyncEngine([a, b]).on_adjusted_dates(a, b, 1)


def match_matchday(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _match_contents(spark, sf_dir, "ab")
    return MatchSyncEngine([a, b]).on_matchday(a, b)


def remaining_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = match_exact(spark, sf_dir).dropna().select("a_match_id").distinct()
    return matches(spark, sf_dir, "a").join(done, "a_match_id", "left_anti").select("a_match_id")


def match_sync_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MatchSyncEngine(_match_contents(spark, sf_dir, "ab")).synchronize().data


def match_sync_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MatchSyncEngine(_match_contents(spark, sf_dir, "abc")).synchronize().data


# --- frames and contents ---------------------------------------------------------------------


def _two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("label_x"))
    y = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label_y"))
    return x.join(y, "o_orderkey")


def coalesce_suffixes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesce_suffixes(_two_sides(spark, sf_dir), "label")


def clean_suffixes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_suffixes(_two_sides(spark, sf_dir), ["label"])


def split_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's own table of teams, as rows per provider."""
    long = _read(spark, sf_dir, "team_records").select("data_provider", "provider_team_id", "team_name")
    parts = split_by_provider(long, "team", ["provider_c", "provider_a", "provider_b"])
    named = [df.groupBy().agg(F.lit(p).alias("provider"), F.count_distinct(f"{p}_team_id").alias("ids"), F.count(F.lit(1)).alias("rows")) for p, df in parts.items()]
    return collect_union(named, ["provider", "ids", "rows"])


def content_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ab = match_exact(spark, sf_dir)
    c = matches(spark, sf_dir, "c").select((F.col("c_match_id").cast("long") - 10_000_000).cast("string").alias("b_match_id"), "c_match_id")
    return Content("match", "a", ab).merge(Content("match", "b", c)).data.select("a_match_id", "b_match_id", "c_match_id")


def content_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Content("match", "a", matches(spark, sf_dir, "a").select("a_match_id", "match_date"))
    return a.append(matches(spark, sf_dir, "b").select("b_match_id", "match_date")).data.select("a_match_id", "b_match_id", "match_date")


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = _read(spark, sf_dir, "squad_versions").withColumn("provider_a_player_id", F.when(F.col("data_provider") == "provider_a", F.col("provider_player_id")))
    return Content.of("player", "provider_a", players, order_by="version_id").violations()


def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "player_records")
    full = [F.bool_and(F.col(c).isNotNull()).alias(f"{c}_full") for c in ("jersey_number", "team_id", "player_name")]
    return rows.groupBy("match_id").agg(*full)


# --- similarity ------------------------------------------------------------------------------


def _team_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = _read(spark, sf_dir, "team_records").select("competition_id", "season_id", "record_id", "team_name", "data_provider")
    return rows.filter("data_provider = 'provider_a'"), rows.filter("data_provider = 'provider_b'"), ["competition_id", "season_id"]


def _team_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    a, b, block = _team_sides(spark, sf_dir)
    return tfidf_edges(a, b, block=block, left_id="record_id", left_text="team_name", right_id="record_id", right_text="team_name"), block


def tfidf_cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _team_edges(spark, sf_dir)
    return edges.withColumn("similarity", F.round("similarity", 6))


def tfidf_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, block = _team_edges(spark, sf_dir)
    return best_partner(edges.withColumn("similarity", F.round("similarity", 6)), block, 0.75)


def naive_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each normalised text on both sides, joined."""
    a, b, block = _team_sides(spark, sf_dir)
    first = lambda df, name: df.select(*block, text.normalize(F.col("team_name")).alias("t"), "record_id").groupBy(*block, "t").agg(F.min("record_id").alias(name))
    return first(a, "i").join(first(b, "j"), [*block, "t"]).select(*block, "i", "j")


def naive_subset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one block whose token sets contain one another; found through shared tokens, not by pairing all."""
    a, b, block = _team_sides(spark, sf_dir)
    side = lambda df, i: df.select(*block, F.col("record_id").alias(i), text.token_set(text.normalize(F.col("team_name"))).alias("s")).select(*block, i, F.size("s").alias(f"n_{i}"), F.explode("s").alias("token"))
    shared = side(a, "i").join(side(b, "j"), [*block, "token"]).groupBy(*block, "i", "j", "n_i", "n_j").agg(F.count(F.lit(1)).alias("n"))
    return shared.filter((F.col("n") == F.col("n_i")) | (F.col("n") == F.col("n_j"))).select(*block, "i", "j")


def _kernel_query(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        a, b, block = _team_sides(spark, sf_dir)
        side = lambda df: df.select(*(F.concat(b).alias(b) for b in block), F.col("record_id").cast("string").alias("id"), F.col("record_id").alias(POS), F.concat("team_name").alias("team_name"), text.normalize(F.col("team_name")).alias("n"))

        def pairs(x, y):
            import pandas as pd

            if not len(x) or not len(y):
                return pd.DataFrame([], columns=[*block, "i", "j"])
            rows = [[(i, r, n) for i, r, n in zip(d["id"], d["team_name"], d["n"])] for d in (x.sort_values(POS), y.sort_values(POS))]
            keys = x[block].iloc[0].tolist()
            return pd.DataFrame([(*keys, i, j) for i, j in run(*rows)], columns=[*block, "i", "j"])

        left, right = (side(df).repartition(tasks(spark), *block) for df in (a, b))
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(pairs, "competition_id string, season_id string, i string, j string")

    return query


# --- engines ---------------------------------------------------------------------------------


def _long_contents(spark: SparkSession, sf_dir: str, table: str, object_type: str, block: tuple[str, ...], columns: list[str]) -> list[Content]:
    rows = _read(spark, sf_dir, table).select("record_id", "data_provider", f"provider_{object_type}_id", *block, *columns)
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*block, "data_provider", f"provider_{object_type}_id").orderBy("record_id"))).filter("_n = 1").drop("_n")
    parts = split_by_provider(once, object_type, ["provider_a", "provider_b", "provider_c"])
    return [Content.of(object_type, p, df, block=block, order_by="record_id") for p, df in parts.items()]


def team_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams of three providers, for all competitions and seasons at once."""
    block = ("competition_id", "season_id")
    return TeamSyncEngine(_long_contents(spark, sf_dir, "team_records", "team", block, ["team_name"]), use_competition_context=True).synchronize().data


def player_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of three providers, for all matches at once."""
    columns = ["player_name", "player_nickname", "birth_date", "team_id", "jersey_number"]
    return PlayerSyncEngine(_long_contents(spark, sf_dir, "player_records", "player", ("match_id",), columns)).synchronize().data


def mutual_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in which both ids have no other partner."""
    pairs = match_date_window(spark, sf_dir)
    many = lambda c, o: F.size(F.collect_set(o).over(Window.partitionBy(c)))
    return pairs.withColumns({"n": many("a_match_id", "b_match_id"), "m": many("b_match_id", "a_match_id")}).filter("n = 1 and m = 1").select("a_match_id", "b_match_id")


def dedupe_first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per team and season the first id of each provider in order of record_id."""
    rows = _read(spark, sf_dir, "team_records").withColumn("t", text.normalize(F.col("team_name")))
    first = lambda p: F.min(F.when(F.col("data_provider") == p, F.struct("record_id", F.col("provider_team_id").alias("id"))))["id"].alias(f"{p}_team_id")
    return rows.groupBy("competition_id", "season_id", "t").agg(*(first(p) for p in ("provider_a", "provider_b", "provider_c")))


# --- pipeline --------------------------------------------------------------------------------


IDS = ["a_id", "b_id", "c_id"]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link as a crosswalk row of three providers; ids carry their object type."""
    rows = _read(spark, sf_dir, "id_links")
    own = lambda p: F.coalesce(*(F.when(F.col(f"{s}_provider") == f"provider_{p}", F.concat_ws(":", "object_type", text.strip(F.col(f"{s}_object_id")))) for s in ("left", "right")))
    known = lambda p: F.coalesce(*(F.when(F.col(f"{s}_provider") == f"provider_{p}", F.col(f"{s}_object_id")) for s in ("left", "right"))).isNotNull()
    return rows.select("link_id", *(F.when(known(p), own(p)).alias(f"{p}_id") for p in "abc"))


def knockout_squish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.squish(_wide(spark, sf_dir), "a_id", ["b_id", "c_id"])


def knockout_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.squish(_wide(spark, sf_dir), "a_id", ["b_id", "c_id"])
    known = rows.filter(F.length("a_id") % 2 == 0).withColumn("b_id", F.when(F.col("a_id").endswith("1"), F.lit(None)).otherwise(F.col("b_id")))
    return pipeline.fill_upsert(known, rows, "a_id")


def knockout_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir)
    return pipeline.drop_known(rows, rows.filter("link_id % 10 = 0"), IDS)


def knockout_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir)
    known = pipeline.squish(rows.filter("link_id % 10 = 0"), "a_id", ["b_id", "c_id"])
    return pipeline.knock_out(rows.filter("link_id % 10 <> 0"), known, IDS)[1]


def flag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.flag_duplicates(_wide(spark, sf_dir), IDS, ["link_id"])


def metadata_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p: F.max(F.when(F.col("data_provider") == p, F.col("team_name"))).alias(f"name_{p[-1]}")
    rows = _read(spark, sf_dir, "team_records").groupBy("competition_id", "season_id", "team_gender", "ussf_country_id").agg(*(name(f"provider_{p}") for p in "abc"))
    return pipeline.metadata_priority(rows, {"team_name": ["name_b", "name_a", "name_c"]})


def durable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of even key already have ids; the others get the next ones of their stem."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("g"), F.concat(F.lit("Nation "), F.col("c_nationkey")).alias("name"))
    place = F.row_number().over(Window.partitionBy("g", "name").orderBy("c_custkey"))
    old = c.withColumn("durable_id", F.concat_ws("-", "g", pipeline.name_prefix(F.col("name")), place.cast("string"))).filter("c_custkey % 2 = 0")
    return pipeline.durable_ids(c.filter("c_custkey % 2 = 1"), old, "g", "name", ["c_custkey"]).select("c_custkey", "durable_id")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return pipeline.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", -F.col("o_totalprice")), "o_orderkey")


def crosswalk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    crosswalk = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a_id"), (F.col("o_orderkey") % 1000).alias("b_id"))
    qty = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a_id"), F.col("l_quantity").alias("qty"))
    value = _read(spark, sf_dir, "events").select(F.col("user_id").alias("b_id"), F.round("value", 2).cast("decimal(18,2)").alias("value"))
    out = pipeline.crosswalk_metrics(crosswalk, [(qty, "a_id", "qty"), (value, "b_id", "value")], "o_orderkey")
    return out.select("o_orderkey", F.round("qty", 2).alias("qty"), F.col("value").cast("double").alias("value"))


QUERIES = {
    **TEXT,
    "coalesce_suffixes": coalesce_suffixes_query,
    "clean_suffixes": clean_suffixes_query,
    **{f.__name__: f for f in (
        split_providers, content_merge, content_append, schema_violations, column_coverage, match_exact, match_date_window, match_matchday, remaining_anti, match_sync_2, match_sync_3,
        tfidf_cosine_edges, tfidf_top1, naive_exact, naive_subset_candidates, team_sync, player_sync, mutual_unique, dedupe_first_non_null,
        knockout_squish, knockout_upsert, knockout_antijoin, knockout_loop, flag_duplicates, metadata_priority, durable_ids, upsert_merge, crosswalk_metrics,
    )},
    "naive_match": _kernel_query(naive_match),
    "fuzzy_match": _kernel_query(lambda a, b: fuzzy_match(a, b, 0.9)),
    "cosine_assignment": _kernel_query(lambda a, b: cosine_match(a, b, 0.75)),
}
