import pytest
from pyspark.sql import functions as F

from idsync.plans import pipeline
from idsync.sources.frames import clean_suffixes, coalesce_suffixes, collect_union, conform, read_csv, read_json, save_table, split_by_provider
from idsync.streaming.increments import IncrementalTable, latest


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_squish(spark):
    df = spark.createDataFrame([("1", "x", "p"), ("1", "x", None), ("2", "y", "q"), ("2", "z", "q"), (None, "w", "r")], "a string, b string, c string")
    assert rows(pipeline.squish(df, "a", ["b", "c"])) == [("1", "x", "p"), ("2", None, "q")]


def test_fill_upsert(spark):
    target = spark.createDataFrame([("1", "x", None), ("2", None, None), (None, "k", None)], "a string, b string, c string")
    new = spark.createDataFrame([("1", "other", "p"), ("3", "n", None), (None, "drop", None)], "a string, b string, c string")
    assert rows(pipeline.fill_upsert(target, new, "a")) == [("1", "x", "p"), ("2", None, None), ("3", "n", None), (None, "k", None)]


def test_drop_known_and_knock_out(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z"), ("4", None)], "a string, b string")
    known = spark.createDataFrame([("1", None), (None, "z")], "a string, b string")
    assert rows(pipeline.drop_known(df, known, ["a", "b"])) == [("2", "y"), ("4", None)]
    left, all_known = pipeline.knock_out(df, known, ["a", "b"])
    assert rows(left) == [("2", "y"), ("4", None)]
    assert ("1", "x") in rows(all_known)


def test_flags_priority_and_ids(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "q"), (3, None, "q"), (4, None, None)], "n int, a string, b string")
    assert rows(pipeline.flag_duplicates(df, ["a", "b"], ["n"]), "n", "is_duplicate") == [(1, False), (2, True), (3, True), (4, False)]
    names = spark.createDataFrame([(None, "x"), ("y", "z"), (None, None)], "n1 string, n2 string")
    assert rows(pipeline.metadata_priority(names, {"name": ["n1", "n2"]}), "name") == [("x",), ("y",), (None,)]
    new = spark.createDataFrame([("m", "Ann-Marie Löw", 1), ("m", "Annmarie Low", 2), ("f", "Bo", 3)], "g string, name string, i int")
    old = spark.createDataFrame([("m-annmarielo-7",), ("f-x-1",)], "durable_id string")
    assert rows(pipeline.durable_ids(new, old, "g", "name", ["i"]), "i", "durable_id") == [(1, "m-annmarielo-8"), (2, "m-annmarielo-9"), (3, "f-bo-1")]


def test_upsert_with_stamps(spark):
    target = spark.createDataFrame([(1, "x", "t0", "t0"), (2, "y", "t0", "t0")], "k int, v string, created_at string, updated_at string")
    out = pipeline.upsert(target, spark.createDataFrame([(2, None), (3, "z")], "k int, v string"), "k", F.lit("t1"))
    assert rows(out) == [(1, "x", "t0", "t0"), (2, None, "t0", "t1"), (3, "z", "t1", "t1")]


def test_crosswalk_metrics(spark):
    walk = spark.createDataFrame([(1, "a1", "b1"), (2, "a2", None)], "k int, a string, b string")
    one = spark.createDataFrame([("a1", 2.0), ("a1", 3.0)], "a string, x double")
    two = spark.createDataFrame([("b1", 1.0)], "b string, y double")
    assert rows(pipeline.crosswalk_metrics(walk, [(one, "a", "x"), (two, "b", "y")], "k"), "k", "x", "y") == [(1, 5.0, 1.0), (2, None, None)]


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "b"), ("2", "a", "c")], "k string, v_x string, v_y string")
    assert rows(coalesce_suffixes(df, "v"), "k", "v") == [("1", "b"), ("2", "a")]
    assert rows(clean_suffixes(df, ["v", "missing"]), "k", "v") == [("1", None), ("2", "a")]
    assert conform(df.select("k"), df.schema).columns == df.columns
    assert collect_union([df, df], ["k"]).count() == 4
    long = spark.createDataFrame([("p1", 1.0), ("p2", 2.0), ("p1", None)], "data_provider string, provider_team_id double")
    parts = split_by_provider(long, "team", ["p2", "p1"])
    assert list(parts) == ["p1", "p2"] and rows(parts["p1"], "p1_team_id") == [("1",), (None,)]
    save_table(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "x.csv").write_text("a,b\n1,\n2,z\n")
    assert rows(read_csv(spark, str(tmp_path / "x.csv"))) == [("1", None), ("2", "z")]
    (tmp_path / "x.json").write_text('[{"player": {"id": 3}, "kpis": [1, 2]}]')
    assert read_json(spark, str(tmp_path / "x.json")).select("player.id", F.explode("kpis")).count() == 2


def test_incremental_table(spark, tmp_path):
    start = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, at int")
    spark.createDataFrame([(2, "new", 3), (2, "old", 2), (3, "z", 1)], "k int, v string, at int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(start.schema).parquet(str(tmp_path / "in"))
    table = IncrementalTable(spark, start, "k", "at")
    assert rows(table.drain(stream)) == [(1, "x", 1), (2, "new", 3), (3, "z", 1)]
    assert rows(latest(start, "k", "at")) == [(1, "x", 1), (2, "y", 1)]


def test_metrics_recode_extract(spark):
    one, two = spark.createDataFrame([(1, 2.0), (2, 5.0)], "k int, x double"), spark.createDataFrame([(2, 1.0), (3, 4.0)], "k int, y double")
    assert [r.k for r in pipeline.outer_metrics([one, two], "k", ["x", "y"]).collect()] == [2, 1, 3]
    assert rows(one.select(pipeline.recode(F.col("k"), {1: "a"}, "z").alias("c"))) == [("a",), ("z",)]
    teams = spark.createDataFrame([("h", "T1"), (None, "T2")], "home string, home_team_id string")
    matches = spark.createDataFrame([("m1", "h"), ("m2", "g"), ("m3", None)], "m string, home string")
    assert rows(pipeline.extract(matches, [(teams, "home", "home_team_id")], ["m", "home_team_id"])) == [("m1", "T1")]


def test_unnest_and_providers(spark, tmp_path):
    from idsync.sources.frames import providers_of, read_json, split_by_provider, unnest

    (tmp_path / "a.json").write_text('[{"id": 1, "kpis": [{"kpiId": 7, "player": {"id": "x"}}, {"kpiId": 8, "player": null}]}, {"id": 2, "kpis": []}]')
    rows = unnest(read_json(spark, str(tmp_path / "a.json")), "kpis", {"kpi": "kpiId", "player": "player.id"}, ["id"])
    assert sorted(map(tuple, rows.collect())) == [(1, 7, "x"), (1, 8, None)]
    long = spark.createDataFrame([("b", "1.0"), ("a", "2"), (None, "3")], "data_provider string, provider_team_id string")
    assert providers_of(long) == ["a", "b"] and list(split_by_provider(long, "team")) == ["a", "b"]
    assert split_by_provider(long, "team")["b"].collect()[0].b_team_id == "1"


def test_agreeing_and_back_join(spark):
    from idsync.operators.similarity import agreeing, back_join

    left = spark.createDataFrame([(1, "7", "t"), (2, None, "t")], "k long, shirt string, team string")
    right = spark.createDataFrame([(8, "7", "t"), (9, None, "t")], "k long, shirt string, team string")
    pairs = spark.createDataFrame([(1, 8), (2, 9)], "i long, j long")
    assert [tuple(r) for r in agreeing(pairs, left, right, "k", ["shirt", "team"]).collect()] == [(1, 8)]
    assert agreeing(pairs, left.drop("shirt"), right, "k", ["shirt", "team"]).count() == 2
    with pytest.raises(ValueError):
        agreeing(pairs, left, right.drop("shirt"), "k", ["shirt"])
    names = lambda rows: spark.createDataFrame(rows, "b string, k long, name string")
    texts = spark.createDataFrame([("m", "A", "a")], "b string, x string, y string")
    assert sorted(map(tuple, back_join(texts, names([("m", 1, "A"), ("m", 2, "A"), ("n", 3, "A")]), names([("m", 8, "a"), ("m", 9, "a")]), ["b"], "k", "name").collect())) == [("m", 1, 8), ("m", 1, 9), ("m", 2, 8), ("m", 2, 9)]
