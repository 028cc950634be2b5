from itertools import permutations

import pytest
from pyspark.sql import functions as F

from idsync.operators.content import Content, ContractError
from idsync.operators.engine import MatchSyncEngine, PlayerSyncEngine, SyncEngine, TeamSyncEngine
from idsync.operators.matchers import PlayerLayer, Similarity, player_layers

MATCH = "{p}_match_id string, match_date string, home_team_id string, away_team_id string, matchday string, _row long"
PLAYER = "{p}_player_id string, player_name string, player_nickname string, team_id string, jersey_number string, birth_date string, _row long"


def content(spark, kind, p, rows, schema, block=()):
    numbered = [(*r, i) for i, r in enumerate(rows)]
    return Content.of(kind, p, spark.createDataFrame(numbered, schema.format(p=p)), order_by="_row", block=block)


def crosswalk(result, kind, providers="abc"):
    return sorted((tuple(r[f"{p}_{kind}_id"] for p in providers) for r in result.data.collect()), key=str)


def matches(spark, p, rows):
    return content(spark, "match", p, rows, MATCH)


def test_contracts(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "h", "a"), (None, "soon", "h", None)], "a_match_id string, match_date string, home_team_id string, away_team_id string")
    got = {r.check: r.rows for r in Content.of("match", "a", df).violations().collect()}
    assert got == {"a_match_id is null": 1, "match_date is null": 0, "home_team_id is null": 0, "away_team_id is null": 1, "match_date is no date": 1}
    with pytest.raises(ContractError):
        Content.of("match", "a", df).validate()
    with pytest.raises(ContractError):
        Content.of("match", "b", df)
    with pytest.raises(ContractError):
        Content("match", "a", None)
    with pytest.raises(ContractError):
        Content.of("match", "a", df.drop("match_date")).violations()
    assert Content.of("match", "a", df.limit(1)).validate()


def test_numbers_become_text(spark):
    df = spark.createDataFrame([(1, "n", 7)], "a_player_id int, player_name string, team_id int")
    assert dict(Content.of("player", "a", df).data.dtypes)["a_player_id"] == "string"


def test_merge_and_append(spark):
    left = Content("object", "a", spark.createDataFrame([("1", "x", None), ("2", None, "q")], "a_object_id string, b_object_id string, c_object_id string"))
    right = Content("object", "b", spark.createDataFrame([("x", "z"), (None, "w")], "b_object_id string, c_object_id string"))
    assert sorted(tuple(r) for r in left.merge(right).data.select("a_object_id", "b_object_id", "c_object_id").collect()) == [("1", "x", "z"), ("2", None, "q")]
    assert left.merge(None) is left and left.append(None) is left
    assert left.append(right).data.count() == 4
    with pytest.raises(ContractError):
        left.merge(Content("team", "b", spark.createDataFrame([("1",)], "b_team_id string")))
    with pytest.raises(ContractError):
        left.append(Content("team", "b", spark.createDataFrame([("1",)], "b_team_id string")))
    with pytest.raises(ContractError):
        right.merge(Content("object", "d", spark.createDataFrame([("1",)], "d_object_id string")))


def test_engine_checks(spark):
    c = matches(spark, "a", [("1", "2024-01-01", "h", "a", "1")])
    for bad in ([], "x", [1]):
        with pytest.raises(ContractError):
            MatchSyncEngine(bad)
    with pytest.raises(ContractError):
        SyncEngine([c], ["x"], " ")
    with pytest.raises(ContractError):
        TeamSyncEngine([c])
    with pytest.raises(ContractError):
        MatchSyncEngine([c], use_competition_context=True)
    with pytest.raises(NotImplementedError):
        SyncEngine([c, c], ["x"], "match").synchronize()
    assert MatchSyncEngine([c]).synchronize() is c


def test_match_passes(spark):
    a = matches(spark, "a", [("1", "2024-01-01", "h", "a", "1"), ("2", "2024-02-01", "h", "a", "2"), ("3", "2024-03-01", "h", "a", "3"), ("4", "2024-05-01", "x", "y", None), ("5", "Jan 2, 2025", "q", "r", "9")])
    b = matches(spark, "b", [("11", "2024-01-01", "h", "a", "1"), ("12", "2024-02-02", "h", "a", "2"), ("13", "2024-03-20", "h", "a", "3"), ("14", "2024-07-01", "x", "y", None), ("15", "2025-01-02", "q", "r", "8")])
    got = crosswalk(MatchSyncEngine([a, b]).synchronize(), "match", "ab")
    assert got == [("1", "11"), ("2", "12"), ("3", "13"), ("4", "14"), ("5", "15")]


def test_date_windows(spark):
    a = matches(spark, "a", [("1", "2024-01-01", "h", "a", "1")])
    b = matches(spark, "b", [("11", "2024-01-04", "h", "a", "2")])
    assert len(crosswalk(MatchSyncEngine([a, b]).synchronize(), "match", "ab")) == 2
    assert crosswalk(MatchSyncEngine([a, b], date_window="documented").synchronize(), "match", "ab") == [("1", "11")]


@pytest.mark.parametrize("order", list(permutations("abc"))[::2])
def test_three_providers_in_any_order(spark, order):
    rows = {"a": [("1", "2024-01-01", "h", "a", "1")], "b": [("5", "2024-06-01", "p", "q", "4")], "c": [("9", "2024-01-01", "h", "a", "1")]}
    result = MatchSyncEngine([matches(spark, p, rows[p]) for p in order]).synchronize()
    assert sorted(tuple(r[f"{p}_match_id"] or "" for p in "abc") for r in result.data.collect()) == [("", "5", ""), ("1", "", "9")]


def test_blocks_are_kept_apart(spark):
    schema = MATCH + ", league string"
    rows = lambda p, day: content(spark, "match", p, [(f"{p}1", day, "h", "a", "1", 0, "L1"), (f"{p}2", "2024-01-09", "h", "a", "2", 1, "L2")], MATCH.replace("_row long", "n long, league string, _row long"), ("league",))
    got = MatchSyncEngine([rows("a", "2024-01-01"), rows("b", "2024-01-02")]).synchronize()
    assert sorted((r.league, r.a_match_id, r.b_match_id) for r in got.data.collect()) == [("L1", "a1", "b1"), ("L2", "a2", "b2")] and schema


def teams(spark, p, names):
    return content(spark, "team", p, [(f"{p}{i}", n) for i, n in enumerate(names)], "{p}_team_id string, team_name string, _row long")


def test_teams(spark):
    a, b = teams(spark, "a", ["Bay FC", "Alpha Rovers", "Gamma"]), teams(spark, "b", ["Alpha Rover", "Bay FC"])
    got = TeamSyncEngine([a, b]).synchronize()
    assert sorted((r.team_name, r.a_team_id, r.b_team_id) for r in got.data.collect()) == [("Alpha Rovers", "a1", "b0"), ("Bay FC", "a0", "b1"), ("Gamma", "a2", None)]


def players(spark, p, rows, block=()):
    return content(spark, "player", p, [(f"{p}{i}", *r) for i, r in enumerate(rows)], PLAYER, block)


def test_player_layers(spark):
    a = players(spark, "a", [("Tae Kim", "Kim", "t", "22", "1990-01-01"), ("Tae Kim", "Kim", "t", "26", "1991-01-01"), ("Maria Guadalupe Sanchez", "Mary", "u", "7", "1992-03-04"), ("Solo", "Solo", "v", "1", "1980-01-01")])
    b = players(spark, "b", [("Tae Kim", "Kim", "t", "26", "1991-01-01"), ("Tae Kim", "Kim", "t", "22", "1990-01-01"), ("Maria Sanchez", "Mari", "u", "8", "1992-03-05")])
    got = PlayerSyncEngine([a, b]).synchronize()
    assert sorted((r.a_player_id or "", r.b_player_id or "") for r in got.data.collect()) == [("a0", "b1"), ("a1", "b0"), ("a2", "b2"), ("a3", "")]


def test_unreliable_shirts_leave_the_key(spark):
    a = players(spark, "a", [("Ann Lee", None, "t", None, None)])
    b = players(spark, "b", [("Ann Lee", None, "t", "4", None), ("Zoe Wu", None, "t", "5", None)])
    got = PlayerSyncEngine([a, b]).synchronize().data.collect()
    assert sorted((r.player_name, r.jersey_number, r.a_player_id, r.b_player_id) for r in got) == [("Ann Lee", None, "a0", "b0"), ("Zoe Wu", None, None, "b1")]


def test_players_in_blocks_with_a_provider_missing(spark):
    schema = PLAYER.replace("_row long", "game string, _row long")
    rows = lambda p, games: Content.of("player", p, spark.createDataFrame([(f"{p}{i}", "Ann Lee", None, "t", "4", None, g, i) for i, g in enumerate(games)], schema.format(p=p)), order_by="_row", block=("game",))
    got = PlayerSyncEngine([rows("a", ["g", "h"]), rows("b", ["g", "i"]), rows("c", ["g", "h", "i"])]).synchronize()
    assert sorted((r.game, r.a_player_id, r.b_player_id, r.c_player_id) for r in got.data.collect()) == [("g", "a0", "b0", "c0"), ("h", "a1", None, "c1"), ("i", None, "b1", "c2")]


def test_methods_on_any_object(spark):
    schema = "{p}_object_id string, object_name string, _row long"
    a = content(spark, "object", "a", [("1", "Alpha Rovers"), ("2", "Gamma United"), ("3", None)], schema)
    b = content(spark, "object", "b", [("4", "Gamma Untied"), ("5", "Rovers"), ("6", None)], schema)
    engine = SyncEngine([a, b], ["object_name"], "object", verbose=True)
    run = lambda m, t=0.75: sorted(tuple(r) for r in engine.similar_pairs(a, b, ("object_name", "object_name"), m, t).collect())
    assert run(Similarity.COSINE, 0.3) == [("1", "5"), ("2", "4")]
    assert run(Similarity.NAIVE) == [("1", "5")] and run(Similarity.FUZZY, 0.91) == [("2", "4")]
    for bad in (("object_name",), ("x", "object_name"), ("object_name", "x")):
        with pytest.raises(ContractError):
            engine.similar_pairs(a, b, bad)


def test_one_layer(spark):
    a = players(spark, "a", [("Ann Lee", None, "t", "1", "1990-05-04"), ("Bo Ray", None, "t", "2", "1990-01-02")])
    b = players(spark, "b", [("Ann Lee", None, "t", "9", "1990-05-03"), ("Bo Ray", None, "t", "8", "1990-02-01")])
    engine = PlayerSyncEngine([a, b])
    run = lambda **k: sorted(tuple(r) for r in engine.pairs_by_layer(a, b, PlayerLayer("x", **k)).collect())
    assert run() == [] and run(date_shift=-1) == [("a0", "b0")] and run(swap_month_day=True) == [("a1", "b1")] and run(date_shift=-3) == []
    assert run(date_shift=None, equal=("team_id",)) == [("a0", "b0"), ("a1", "b1")] and run(date_shift=None, equal=("jersey_number",)) == []


def test_default_layers():
    assert len(player_layers(True, True)) == 26 and len(player_layers(False, True)) == 10
    assert player_layers(False, False)[-1].equal == ("team_id",)
    assert PlayerLayer("x", Similarity.FUZZY).threshold == 0.75


def test_empty_provider(spark):
    a = matches(spark, "a", [("1", "2024-01-01", "h", "a", "1")])
    b = matches(spark, "b", [("2", "2024-01-01", "h", "a", "1")])
    empty = b.with_data(b.data.filter(F.lit(False)))
    assert crosswalk(MatchSyncEngine([a, empty]).synchronize(), "match", "ab") == [("1", None)]
    assert crosswalk(MatchSyncEngine([a.with_data(a.data.filter(F.lit(False))), b]).synchronize(), "match", "ab") == [(None, "2")]


def _people(spark, p, rows, columns="player_id string, player_name string, team_id string"):
    df = spark.createDataFrame(rows, columns).withColumnRenamed("player_id", f"{p}_player_id")
    return Content.of("player", p, df)


def test_fields_the_first_side_lacks_are_not_checked(spark):
    """Without shirts and birth dates on the left, name and team are enough; what only the right side lacks is an error."""
    a = _people(spark, "a", [("1", "Ann Leewood", "t"), ("2", "Bo Marsh", "t")])
    b = _people(spark, "b", [("7", "Ann Leewood", "t", "5", None), ("8", "Marsh Bo", "t", "6", None)], "player_id string, player_name string, team_id string, jersey_number string, birth_date string")
    layer = PlayerLayer("shirt and team", date_shift=None, equal=("jersey_number", "team_id"))
    engine = PlayerSyncEngine([a, b])
    assert [tuple(r) for r in engine.pairs_by_layer(a, b, layer).collect()] == [("1", "7")]
    with pytest.raises(ContractError):
        PlayerSyncEngine([b, a]).pairs_by_layer(b, a, layer)


def test_matchers_need_a_value(spark):
    a, b = _people(spark, "a", [("1", None, "t")]), _people(spark, "b", [("7", "Ann Leewood", "t")])
    with pytest.raises(ContractError):
        PlayerSyncEngine([a, b]).similar_pairs(a, b, ("player_name", "player_name"))


def test_plan_grows_with_providers_only(spark):
    """The rests of all providers come from the same rows: the size of the plan is linear in their number."""
    sizes = []
    for n in (2, 3, 4):
        contents = [Content.of("match", f"p{k}", spark.createDataFrame([(f"m{k}", "2024-01-01", "h", "a")], f"p{k}_match_id string, match_date string, home_team_id string, away_team_id string")) for k in range(n)]
        plan = MatchSyncEngine(contents).synchronize().data
        assert plan.count() == 1
        sizes.append(plan._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[2] - sizes[1] <= 1.5 * (sizes[1] - sizes[0]) + 5
