"""Reports, weapons, registries and catalog rows on rows that the tables do not have."""


from pyspark.sql import functions as F

from tickloom.functions import weapons
from tickloom.operators import reports
from tickloom.plans import catalog
from tickloom.query import LogDataset, LogQuery, Registry, friendly_name
from tickloom.sources import sinks


def col(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_weapons(spark):
    assert col(spark, ["ak47", " WEAPON_AWP ", "weapon_m4a1_silencer", "stick", None, ""], "string", weapons.weapon_id) == [7, 9, 60, 0, 0, 0]
    assert col(spark, [None, -3, 0, 34], "int", lambda v: weapons.weapon_id_or(v, F.lit("mp5sd"))) == [23, 23, 23, 34]
    assert col(spark, ["CInferno", "CHEGrenadeProjectile", "CWeapon"], "string", weapons.is_utility_class) == [True, True, False]
    assert col(spark, ["decoy_started", "player_hurt", "player_hurts", "a_decoy_"], "string", weapons.is_utility_event) == [True, True, False, False]
    assert col(spark, [17825793, -1, None], "int", lambda v: weapons.original_owner(v, F.lit(-2))) == [str((17825793 << 32) + 2**32 - 2), str(2**64 - 2), None]


def test_registry(spark):
    ticks = spark.createDataFrame([(1, 7, "a", 90, [1.5, -20.0]), (1, 8, "b", 0, [2.5, 0.0]), (2, 7, "a", 80, None)], "tick int, steamid long, name string, m_iHealth int, angles array<double>")
    derived = {"pitch": (["angles"], lambda: F.col("angles")[0]), "yaw": (["angles"], lambda: F.col("angles")[1]), "is_alive": (["health"], lambda: F.col("m_iHealth") > 0), "turn": (["yaw", "is_alive"], lambda: F.when(F.col("is_alive"), F.col("yaw")))}
    log = LogDataset({"ticks": lambda: ticks}, Registry({"health": "m_iHealth"}, derived))
    got = log.ticks(LogQuery(columns=["health", "Weapon.pitch", "turn"]))
    assert got.columns == ["tick", "steamid", "name", "health", "Weapon.pitch", "turn"]
    assert sorted(tuple(r)[3:] for r in got.where("tick = 1").collect()) == [(0, 2.5, None), (90, 1.5, -20.0)]
    alive = log.ticks(LogQuery(columns=["health"], states={"is_alive": True}, state_mode="row"))
    assert sorted(r["health"] for r in alive.collect()) == [80, 90]
    assert log.ticks(LogQuery(columns=["unknown"])).columns == ["tick", "steamid", "name"]
    some = log.ticks(LogQuery(columns=["health"], players=ticks.where("name = 'b'").select("steamid"), ticks=[1]))
    assert [r["health"] for r in some.collect()] == [0]
    assert [friendly_name(p) for p in ("CCSPlayerPawn.m_iHealth", "CCSPlayerController.CCSPlayerController_ActionTrackingServices.m_iKills", "m_bHasHelmet", "m_flVelocityModifier", "X", "m_szLastPlaceName", "m_hActiveWeapon")] == ["health", "kills", "has_helmet", "velocity_modifier", "x", "last_place_name", "active_weapon"]
    assert LogDataset({}).public(spark.createDataFrame([("item_sold", 1, 2), ("x", 3, 4)], "name string, userid int, tick int")).collect() == [("x", 4)]


def test_reports(spark):
    deaths = spark.createDataFrame([("a", 1, 7, 9, "ak47", None), ("a", 2, None, 9, "ak47", False), ("a", 3, 7, 9, " ", False), ("a", 4, 7, 9, "awp", True)], "file string, tick int, steamid long, victim long, weapon string, warmup boolean")
    assert [r["tick"] for r in reports.kill_rows(deaths).collect()] == [1]
    kills = spark.createDataFrame([(1, 7, 100), (2, 7, 200), (3, 8, 100)], "kill int, who long, tick int")
    ticks = spark.createDataFrame([(7, 99, False, 1.0, 1), (7, 101, False, None, None), (7, 102, False, None, 5), (7, 200, True, 9.0, 9), (7, 203, False, 8.0, 8), (8, 100, False, None, None)], "steamid long, tick int, alive boolean, force double, bone int")
    assert [tuple(r) for r in reports.ragdoll_impacts(kills, ticks, [], "who", "kill", ["force", "bone"]).collect()] == [(1, 7, 100, None, 5)]
    boxes = spark.createDataFrame([(1, 2.0, 3.0), (1, None, 99.0), (1, float("nan"), -99.0), (1, float("inf"), 0.0), (1, -1.0, 5.0), (2, None, None)], "k int, x double, y double")
    assert sorted(map(tuple, reports.bounds(boxes, ["k"]).collect()), key=str) == [(1, -1.0, 2.0, 3.0, 5.0), (2, None, None, None, None)]
    voice = spark.createDataFrame([(1, i, bytes([i])) for i in range(5)] + [(2, 0, None)], "who int, n int, bytes binary")
    assert sorted((r["who"], r["part"], r["packets"], bytes(r["data"])) for r in reports.voice_chunks(voice, ["who"], ["n"], chunk=2).collect()) == [(1, 0, 2, b"\0\1"), (1, 1, 2, b"\2\3"), (1, 2, 1, b"\4"), (2, 0, 1, b"")]
    inputs = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, None), (1, 4, True), (2, 1, False)], "pawn int, tick int, fire boolean")
    assert sorted(map(tuple, reports.press_edges(inputs, ["pawn"], F.col("fire")).collect())) == [(1, 1), (1, 4)]
    events = spark.createDataFrame([("a", 5, 1, "round_start", 2.5), ("a", 3, 1, "other", 1.0), ("a", 9, 1, "round_start", 7.0), ("b", 1, 1, "other", 4.0)], "file string, tick int, seq int, name string, game_time double")
    assert sorted(map(tuple, reports.game_start(events, ["file"]).collect())) == [("a", 2.5), ("b", 0.0)]
    rows = spark.createDataFrame([("a", 10, -1), ("b", 10, 5), ("c", 10, None)], "file string, at long, own long")
    headers = spark.createDataFrame([("a", "4"), ("b", "bad")], "file string, server_start_tick string")
    assert sorted(map(tuple, reports.local_ticks(rows, headers, ["file"], ["at", "own"]).collect()), key=str) == [("a", 6, -1), ("b", 10, 5), ("c", 10, None)]
    aim = reports.aim_windows(ticks.select("steamid", "tick"), kills.withColumn("who", F.when(F.col("kill") != 3, F.col("who"))), [], "who", "kill", 2)
    assert sorted((r["clip_id"], r["tick"]) for r in aim.collect()) == [(1, 99), (2, 200)]


def test_arrays_with_offsets(spark):
    shots = spark.createDataFrame([(1, 20, "b", [(7, 30), (8, 40)]), (1, 10, "a", None), (1, 30, "c", [(9, 50)]), (2, 5, "d", [])], "clip int, tick int, weapon string, hits array<struct<victim:int,damage:int>>")
    got = {r["clip"]: r for r in sinks.nested_csr(shots, ["clip"], "tick", ["weapon"], "hits", ["victim", "damage"]).collect()}
    assert tuple(got[1])[1:] == ([10, 20, 30], ["a", "b", "c"], [0, 0, 2, 3], [7, 8, 9], [30, 40, 50])
    assert tuple(got[2])[1:] == ([5], ["d"], [0, 0], [], [])


def test_catalog_rows(spark):
    df = spark.createDataFrame([(" One.DEM ", " x ", [" a", "", "b "], "t", [3, 1, 2], ["c", "a", "b"])], "demo string, killer string, weapons array<string>, side string, ticks array<int>, who array<string>")
    row = catalog.sanitised(df, ["killer"], ["weapons"], demo="demo", teams=["side"], parallel=["ticks", "who"]).first()
    assert (row["demo"], row["killer"], row["weapons"], row["ticks"], row["who"]) == ("one", "x", ["a", "b"], [1, 2, 3], ["a", "b", "c"])
    assert col(spark, [[5, 5], [5, 6], [5], [5, 5, 5], None], "array<int>", lambda v: catalog.same_tick(v, 2)) == [True, False, False, False, None]
    assert col(spark, [[5, 5, 6, 5], [5, 5, 6, 6], []], "array<int>", lambda v: catalog.same_tick(v, 3)) == [True, False, False]
    assert col(spark, ["C:\\demos\\cup\\a.dem", "/base/x/a.dem", "a.dem", None], "string", lambda v: catalog.relative_folder(v, "/base/")) == ["cup/", "x/a.dem", "", None]
    assert col(spark, ["a|b"], "string", lambda v: catalog.collection_key(F.lit(1), v, F.lit(None), F.lit(2), F.lit(3))) == ["1|a|b||2|3"]
    demos = spark.createDataFrame([("a", 2), ("a", 2), ("b", 2), ("c", None)], "demo_name string, col_total int")
    assert sorted(map(tuple, catalog.completeness(demos).collect())) == [("a", 2, 2, True), ("b", 1, 2, False), ("c", 1, 0, False)]
    assert not catalog.completeness(demos.drop("col_total")).where("complete").count()
    assert sorted(map(tuple, catalog.weapon_totals(spark.createDataFrame([("ak47; awp",), (" awp ; awp",)], "w string"), "w").collect())) == [("ak47", 1, 0), ("awp", 3, 1)]
    saved = catalog.prefer_saved(spark.createDataFrame([(1, "full"), (2, "full")], "k int, path string"), spark.createDataFrame([(1, "b"), (1, "a")], "k int, path string"), ["k"])
    assert sorted(map(tuple, saved.collect())) == [(1, "a", True), (2, "full", False)]


def test_checksums_of_any_length(spark):
    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    data = [b"", b"a", None, bytes(range(256)) * 3, b"foobar", b"\0", None, b"zz"]
    rows = spark.createDataFrame(list(enumerate(data)), "i int, b binary").coalesce(1)
    assert {r["i"]: r["checksum"] for r in sinks.fnv1a(rows, "b").collect()} == {i: None if d is None else plain(d) for i, d in enumerate(data)}
    assert sinks.fnv1a(rows.where("b IS NULL"), "b").select("checksum").distinct().collect() == [(None,)]


def test_roster_without_a_list(spark):
    from tickloom.operators import entities

    players = spark.createDataFrame([(1, "a", 2, 5), (1, "b", 2, 9), (2, "c", 1, 9)], "steamid long, name string, team_num int, tick int")
    infos = spark.createDataFrame([(7, "z", 3)], "steamid long, name string, team_num int")
    assert entities.roster(infos, players).collect() == [(7, "z", 3)]
    assert entities.roster(infos.limit(0), players).collect() == [(1, "b", 2)]


def test_presses_of_one_tick_all_count(spark):
    rows = [(1, 1, 3, True), (1, 1, 1, True), (1, 1, 2, False), (1, 2, 5, False), (1, 2, 4, True), (1, None, 0, True), (1, 3, 6, True)]
    inputs = spark.createDataFrame(rows, "pawn int, tick int, seq int, fire boolean")
    got = reports.press_edges(inputs, ["pawn"], F.col("fire"), ["tick", "seq"], every=True)
    assert sorted(r["tick"] for r in got.collect()) == [1, 1, 3]
