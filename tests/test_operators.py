"""Small vectors of the ordered-state operators, joins, groups and the catalog."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as sc
from tickloom.operators import asof, joins, kills
from tickloom.operators import windows as win
from tickloom.plans import catalog, queries
from tickloom.query import LogQuery
from tickloom.session import Engine


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_velocity_lags_one_row(spark):
    data = [(0, 1, 0.0, 0.0), (1, 2, 10.0, 5.0), (2, 1, 1.0, 2.0), (3, 2, 12.0, 4.0), (4, 1, 4.0, 7.0), (5, 2, 15.0, 1.0)]
    df = spark.createDataFrame(data, "tick int, steamid long, X float, Y float")
    got = win.velocity(df, ["steamid"], ["tick"], {"vx": "X", "vy": "Y"}).orderBy("tick").select("vx", "vy").collect()
    assert [tuple(r) for r in got] == [(None, None)] * 4 + [(64.0, 128.0), (128.0, -64.0)]


def test_rounds(spark):
    data = [(1, 10, "end"), (2, 100, "start"), (3, 250, "freeze"), (4, 900, "end"), (5, 950, "end"), (6, 1000, "start"), (7, 1100, "start"), (8, 1500, "end")]
    df = spark.createDataFrame([("a", *r) for r in data], "file string, seq int, tick int, name string")
    n = F.col("name")
    got = rows(win.rounds(df, ["file"], ["seq"], "tick", n == "start", n == "freeze", n == "end"), "round")
    assert got == [("a", 1, 0, 0, 10, 100), ("a", 2, 100, 250, 900, 1000), ("a", 3, 901, 901, 950, 1000), ("a", 4, 1100, 1100, 1500, None)]
    numbered = spark.createDataFrame([("a", 1, 5, "start", 0), ("a", 2, 5, "end", 9), ("a", 3, 8, "end", 7), ("a", 4, 9, "end", 0), ("a", 5, 20, "end", 0)], "file string, seq int, tick int, name string, no int")
    got = rows(win.rounds(numbered, ["file"], ["seq"], "tick", n == "start", n == "freeze", n == "end", number="no", extra=["seq"]).select("round", "start_tick", "end_tick", "seq"), "end_tick")
    assert got == [(7, 6, 8, 3), (2, 10, 20, 5)]


def test_impact_is_the_first_victims(spark):
    shots = spark.createDataFrame([("p", 1, 100)], "who string, seq long, tick long")
    pairs = spark.createDataFrame([("p", 1, 5, 101, False, 90), ("p", 1, 6, 103, True, 10), ("p", 1, 7, 102, True, 40)], "who string, seq long, r_seq long, r_tick long, kill boolean, damage int")
    assert joins.shots_with_hits(shots, pairs, ["who"], "tick", "seq", "kill", "damage").first()["impact"] == 102
    assert joins.shots_with_hits(shots, pairs, ["who"], "tick", "seq").first()["impact"] == 101


def test_two_logs_never_meet(spark):
    ticks = spark.createDataFrame([(f, t, 7, f"n{f}", float(x), 1) for f, x in (("a", 0), ("b", 500)) for t in (1, 2, 3)], "file string, tick int, steamid long, name string, X float, alive int")
    events = spark.createDataFrame([("a", 4, "player_death", 7), ("b", 2, "player_death", 7)], "file string, tick int, name string, userid long")
    rules = spark.createDataFrame([("a", 1, 10), ("b", 3, 20)], "file string, tick int, limit int")
    log = Engine(spark).from_tables(ticks=ticks, events=events, rules=rules)
    assert rows(log.event("player_death", ["X"], ["limit"]).select("file", "user_X", "limit"), "file") == [("a", 0.0, 10), ("b", 500.0, None)]
    assert {r["velocity_X"] for r in log.ticks(LogQuery(columns=["velocity_X"])).collect()} == {None, 0.0}
    assert log.ticks(LogQuery(states={"alive": 1})).count() == 6
    with pytest.raises(ValueError):
        Engine(spark).from_tables(ticks=ticks, events=events.drop("file")).event("player_death", ["X"])


def test_places_over_ranges(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'Hot' when id % 50 = 1 then null else concat('k', id % 700) end as name")
    for down in (True, False):
        col = F.lower("name").desc() if down else F.lower("name").asc()
        want = [r["id"] for r in df.orderBy(col, "id").collect()]
        assert [r["id"] for r in catalog.sort(df, "name", ["id"], down, rank="place").orderBy("place").collect()] == want


def test_checkpoints_of_two_logs(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("a", 1)], "file string, tick int")
    points = spark.createDataFrame([("a", 3), ("a", 5), ("b", 9)], "file string, tick int")
    assert rows(joins.nearest_before(df, points, "tick", ["file"]), "file", "tick") == [("a", 1, None), ("a", 5, 5), ("b", 5, None)]


@pytest.mark.parametrize(
    "shots, hits, want",
    [
        ([(1, 100, False)], [(2, 102)], [(1, 2)]),
        ([(1, 100, False)], [(2, 103)], []),
        ([(1, 100, False), (2, 101, False)], [(3, 102)], [(1, 3)]),
        ([(1, 100, True), (2, 150, False)], [(3, 151)], [(1, 3)]),
        ([(1, 100, True)], [(2, 160), (3, 161)], [(1, 2), (1, 3)]),
    ],
)
def test_greedy_hits(spark, shots, hits, want):
    s = spark.createDataFrame([("p", *r) for r in shots], "who string, seq long, tick long, grenade boolean")
    h = spark.createDataFrame([("p", *r) for r in hits], "who string, seq long, tick long")
    got = joins.greedy_hits_mixed(s, h, ["who"], "tick", "seq", F.col("grenade")).select("seq", "r_seq")
    assert rows(got, "r_seq") == want


def test_was_sold(spark):
    def run(events):
        df = spark.createDataFrame([("p", t, n) for t, n in events], "who string, tick long, name string")
        return [r["was_sold"] for r in win.was_sold(df, ["who"], "tick", F.col("name") == "buy", F.col("name") == "sell").orderBy("tick").collect()]

    assert run([(10, "buy"), (20, "sell"), (30, "buy")]) == [True, False]
    assert run([(10, "buy"), (20, "sell")]) == [False]
    assert run([(10, "buy"), (20, "buy"), (30, "sell")]) == [False, False]


@pytest.mark.parametrize(
    "victims, ticks, want",
    [("a", "1", "SINGLE"), ("ab", "12", "DOUBLE"), ("aa", "12", None), ("aba", "123", "TRIPLE"), ("abc", "111", "MULTI"), ("abcd", "1234", "QUAD"), ("abca", "1234", None), ("abcde", "12345", "ACE"), ("abcdef", "123456", None)],
)
def test_collection_types(spark, victims, ticks, want):
    df = spark.createDataFrame([("k", 1, int(t), v, "CT") for v, t in zip(victims, ticks)], "killer string, round int, tick int, victim string, victim_team string")
    got = kills.collections(df, ["killer", "round"], "tick", "victim", "killer", "victim_team", ["victim"]).collect()
    assert [r["type"] for r in got] == ([want] if want else [])


def test_bot_and_team_kills(spark):
    df = spark.createDataFrame([("k", 1, "T", "CT", "a", True), ("l", 1, "T", "CT", "a", False), ("l", 2, "T", "T", "b", None)], "killer string, tick int, killer_team string, victim_team string, victim string, bot boolean")
    kept = kills.no_team_kills(df)
    assert kept.count() == 2
    assert [r["killer"] for r in kills.collections(kept, ["killer"], "tick", "victim", "killer", "victim_team", ["victim"], bot="bot").collect()] == ["l"]


def test_position_falls_back_one_tick(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (2, 10)], "steamid long, tick int")
    right = spark.createDataFrame([(1, 9, 1.0), (1, 10, 2.0), (1, 19, 3.0), (1, 29, 4.0), (1, 30, 5.0), (1, 30, 6.0)], "steamid long, tick int, x double")
    assert rows(asof.exact_or_before(left, right, ["steamid"], "tick", "x"), "steamid", "tick") == [(1, 10, 2.0), (1, 20, 3.0), (1, 30, None), (2, 10, None)]


def test_asof_ties_and_strict(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y")], "k string, t int, v string")
    assert rows(asof.asof_join(left, right, ["k"], "t", ["v"]), "k", "t") == [("a", 5, "x"), ("a", 10, "y"), ("b", 1, None)]
    assert rows(asof.asof_join(left, right, ["k"], "t", ["v"], strict=True), "k", "t") == [("a", 5, None), ("a", 10, "y"), ("b", 1, None)]
    assert rows(asof.asof_join(left, right, ["k"], "t", ["v"], tolerance=2), "k", "t") == [("a", 5, "x"), ("a", 10, None), ("b", 1, None)]


@pytest.mark.parametrize("xs, kept", [([0, 1, 2, 2, 2, 2], 4), ([5, 5, 5, 5], 4), ([1, 1], 2)])
def test_rest_pruned(spark, xs, kept):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "e int, tick int, x double")
    assert win.rest_pruned(df, ["e"], ["tick"], ["x"]).count() == kept


def test_runs_and_look_ahead(spark):
    df = spark.createDataFrame([(1, i, w, f) for i, (w, f) in enumerate(zip("aaabbbbb", [0, 1, 1, 1, 1, 1, 1, 1]))], "p int, tick int, weapon string, inspecting int")
    assert [r["tick"] for r in win.switches(df, ["p"], ["tick"], "weapon", 3).collect()] == [3]
    steady = lambda n, d: [r["tick"] for r in win.steady_ahead(d, ["p"], ["tick"], F.col("inspecting") == 1, "weapon", F.lit(False), n).collect()]
    assert steady(2, df) == [1] and steady(3, df) == [] and steady(2, df.where("tick < 2")) == []


def test_state_filter_ends_the_tick(spark):
    ticks = spark.createDataFrame([(1, 7, "a", 1), (1, 8, "b", 0), (1, 9, "c", 1), (2, 7, "a", 1)], "tick int, steamid long, name string, alive int")
    log = Engine(spark).from_tables(ticks=ticks)
    assert rows(log.ticks(LogQuery(states={"alive": 1})).select("tick", "steamid"), "tick") == [(1, 7), (2, 7)]
    assert log.ticks(LogQuery(states={"alive": 1}, state_mode="row")).count() == 3
    assert log.ticks(LogQuery(players=[7], ticks=[2])).count() == 1
    with pytest.raises(KeyError):
        log.voice()


def test_event_gets_state_of_roles(spark):
    ticks = spark.createDataFrame([(1, 7, 50), (5, 7, 40)], "tick int, steamid long, health int")
    events = spark.createDataFrame([(4, "player_death", 7, None), (6, "player_death", 8, 7)], "tick int, name string, attacker long, userid long")
    got = Engine(spark).from_tables(ticks=ticks, events=events).event("player_death", ["health"])
    assert rows(got.select("tick", "attacker_health", "user_health"), "tick") == [(4, 50, None), (6, None, 40)]


def test_merge_keeps_tags(spark):
    old = spark.createDataFrame([("p", "m", 14, "bookmark", 50, 1), ("q", "m", 1, "", 5, 0)], "steam_id string, demo_name string, round int, tag string, start int, tick_data int")
    new = spark.createDataFrame([("p", "m", 14, "", 100, 0), ("r", "m", 2, "x", 9, 0)], old.schema)
    got = rows(catalog.merge(old, new, ["steam_id", "demo_name", "round"]), "steam_id")
    assert got == [("p", "m", 14, "bookmark", 100, 0), ("q", "m", 1, "", 5, 0), ("r", "m", 2, "x", 9, 0)]
    held = catalog.merge(old, new, ["steam_id", "demo_name", "round"], protected=["start", "tick_data"], guard="tick_data")
    assert rows(held.where("steam_id = 'p'"))[0][4:] == (50, 1)


def test_catalog_files_search_and_selection(spark, tmp_path):
    df = spark.createDataFrame([("ACE", "x", 1, "Alpha"), ("QUAD", "x", 2, "beta"), ("ACE", "y", 3, "Gamma")], "type string, folder string, n int, name string")
    catalog.write(df, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert catalog.enabled_only(back, ["ACE"], ["x", "y"]).count() == 2 and catalog.enabled_only(back, [], ["x"]).count() == 0
    assert [r["n"] for r in catalog.search(back, "alp, !a", ["name"]).orderBy("n").collect()] == [1]
    assert catalog.search(back, "beta, !beta", ["name"]).count() == 3
    assert [r["name"] for r in catalog.sort(back, "name", ["n"], descending=False).collect()] == ["Alpha", "beta", "Gamma"]
    assert catalog.with_tick_data(back, "with").count() == 0
    paths = spark.createDataFrame([("/a/One.dem.gz",), ("/b/two.dem",), ("/c/two.dem",), ("/d/v1.2.dem",)], "demo_path string")
    filters = spark.createDataFrame([("one.dem", [1]), ("two.dem", [2]), ("/c/two.dem", [3]), ("v1.2", [4])], "path string, collections array<int>")
    assert rows(catalog.resolved(filters, paths), "demo_path") == [("/a/One.dem.gz", [1]), ("/c/two.dem", [3]), ("/d/v1.2.dem", [4])]


def test_invalid_rows(spark):
    df = spark.createDataFrame([("ACE", "76561198000000001", 3, [1], [1]), ("X", "12", 99, [1, 2], [1])], "type string, steam_id string, round int, a array<int>, b array<int>")
    assert [len(r["problems"]) for r in catalog.invalid(df, ["type"], {"round": (0, 60)}, ["a", "b"]).collect()] == [4]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(sc.text_list(F.lit("[1; 2;x]"))) == [1, 2]
    assert value(sc.tag_added(F.lit("[a]"), "b")) == "[a, b]" and value(sc.tag_removed(F.lit("[a, b]"), "a")) == "[b]"
    assert value(sc.seconds_text(F.lit(16))) == "0.2s" and value(sc.percent_text(F.lit(0.5))) == "50.0%"
    assert value(sc.handle_index(F.lit(0xFFFFFF))) is None and value(sc.handle_index(F.lit(0x4003))) == 3
    assert value(sc.button_names(F.lit(5))) == ["FIRE", "DUCK"]
    assert value(sc.canonical_name(F.lit("C:\\x\\My.Match.DEM.gz"))) == "my.match" and value(sc.stem(F.lit("/a/v1.2.dem"))) == "v1.2"
    assert value(sc.reason_text(F.lit("7"))) == "bomb_defused" and value(sc.winner_of_reason(F.lit(9))) == "T"
    assert value(sc.to_i32(F.lit("4294967296"))) is None and value(sc.to_i32(F.lit("12"))) == 12
    assert value(joins.inventory_mask(F.array(F.lit(1), F.lit(4), F.lit(1)), F.lit(True))) == 18
    assert value(joins.spotted_ids(F.lit(5), F.create_map(F.lit(1), F.lit(70), F.lit(3), F.lit(72)))) == [70, 72]
    x, y, z = sc.shot_direction(F.lit(0.0), F.lit(90.0))
    assert abs(value(y) - 1) < 1e-9 and abs(value(x)) < 1e-9 and value(z) == 0


def test_windows_of_state(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 20, 2.0), (2, 15, 3.0), (2, 40, 4.0)], "k int, tick int, v double")
    assert rows(joins.window_seed(df, ["k"], "tick", 10, 30), "k", "tick") == [(1, 10, 1.0), (1, 20, 2.0), (2, 15, 3.0)]
    flash = spark.createDataFrame([(1, 0, None), (1, 10, 640), (1, 74, None), (1, 80, -1), (1, 90, None)], "p int, tick int, dur int")
    got = win.state_until_reset(flash, ["p"], ["tick"], F.coalesce(F.col("dur") == -1, F.lit(False)), F.when(F.col("dur") > 0, F.col("tick") + F.col("dur")), "tick", "left")
    assert [r["left"] for r in got.orderBy("tick").collect()] == [None, 10.0, 9.0, None, None]


def test_catalog_updates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "n int, tag string, size int")
    new = spark.createDataFrame([(1, 7), (2, 8)], "n int, size int")
    assert rows(catalog.updated(df, new, ["n"], ["size"]), "n") == [(1, "a", 7), (2, "b", 8)]
    assert rows(catalog.filled_where_null(df, new, ["n"], ["size"]), "n") == [(1, "a", 7), (2, "b", 5)]
    assert rows(catalog.tick_data_enabled(df, new.where("n = 2"), ["n"]).select("n", "tick_data"), "n") == [(1, 0), (2, 1)]
    assert catalog.migrated(df, {"size": "long", "path": "string"}).columns == ["size", "path", "n", "tag"]


def test_gaps_go_on_over_parts(spark):
    """The gaps of a whole group, also those between its parts, and of a group whose first part has one row."""
    rows = [("a", t, float(t)) for t in (3, 4, 9, 30, 31)] + [("b", 5, 0.0), ("b", 25, None), (None, 1, 1.0), (None, 11, 4.0)]
    df = spark.createDataFrame(rows, "k string, t long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r["k"]: (r["ticks_between"], r["n"]) for r in kills.gaps_text(df, ["k"], "t", ["x", "y", "z"], width=4).collect()}
    assert got == {"a": ("1;5;21;1", 4), "b": ("20", 0), None: ("10", 1)}
    assert kills.gaps_text(df.where("k = 'a'"), ["k"], "t", ["x", "y", "z"], width=4).first()["move_between"] == "1.000000;5.000000;21.000000;1.000000"


def test_collection_gaps_are_a_labels(spark):
    """One row per label, with one gap less than vectors."""
    got = queries.QUERIES["collection_gaps"](spark, "/root/testdata/sf0.001")
    labels = queries.points(spark, "/root/testdata/sf0.001").groupBy("label").count()
    assert sorted((r["label"], r["n"] + 1) for r in got.collect()) == sorted(map(tuple, labels.collect()))
