"""Replay lanes on rows that the tables do not have."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import replay
from tickloom.operators import windows as win
from tickloom.plans import replay_queries  # noqa: F401  it registers its queries
from tickloom.plans.queries import QUERIES


def test_numbers_and_indexes(spark):
    players = spark.range(300).select(F.lit("a").alias("log"), (1000 - F.col("id")).alias("steamid")).unionByName(spark.createDataFrame([("a", None), ("b", 5), ("b", 5)], "log string, steamid long"))
    numbered = replay.numbered(players, ["log"])
    assert numbered.count() == 301
    df = spark.createDataFrame([("a", 701, None), ("a", 1000, 5), ("b", 5, 701), ("c", 5, 5)], "log string, killer long, victim long")
    got = replay.indexed(df, numbered, ["log"], {"killer": "i", "victim": "j"})
    assert sorted((r["log"], r["killer"], r["i"], r["j"]) for r in got.collect()) == [("a", 701, 0, 255), ("a", 1000, 255, 255), ("b", 5, 0, 255), ("c", 5, 255, 255)]


def test_modifiers(spark):
    rows = [(1, True, None, 2), (2, False, 1, -1), (3, None, 0, 0), (4, None, -1, None)]
    got = replay.with_modifiers(spark.createDataFrame(rows, "i int, headshot boolean, noscope int, penetrated int")).orderBy("i")
    assert [(r["flags"], r["known"], r["penetrated"]) for r in got.collect()] == [(17, 17, 2), (4, 5, None), (0, 20, 0), (0, 0, None)]
    # a field that only says yes or no has no count of surfaces
    only = replay.with_modifiers(spark.createDataFrame([(True,)], "penetrated boolean")).first()
    assert (only["flags"], only["known"], only["penetrated"]) == (16, 16, None)


def test_kills_know_who_is_in_the_air(spark):
    kills = spark.createDataFrame([("a", 10, 1, 2), ("a", 20, 1, 2), ("a", 30, 1, None)], "log string, tick long, k long, v long")
    deaths = spark.createDataFrame([("a", 10, 1, 2, 1, True, None), ("a", 10, 1, 2, 2, False, True), ("a", 20, 2, 1, 3, True, True)], "log string, tick long, k long, v long, seq long, headshot boolean, attacker_is_airborne boolean")
    ticks = spark.createDataFrame(
        [("a", 10, 1, 1, True, False), ("a", 9, 2, 1, True, True), ("a", 19, 1, 1, True, True), ("a", 20, 1, 2, True, None), ("a", 20, 2, 1, False, True), ("a", 28, 1, 1, True, True)],
        "log string, tick long, steamid long, seq long, alive boolean, airborne boolean",
    )
    got = replay.enriched_kills(kills, deaths, ticks, ["log"], "k", "v", "seq").orderBy("tick").collect()
    # 10: the last death counts, its word on the killer too, the victim was seen the tick before; 20: the tick's own row does not know; 30: no row is near enough
    assert [(r["tick"], r["flags"], r["known"], r["penetrated"]) for r in got] == [(10, 96, 97, None), (20, 0, 0, None), (30, 0, 0, None)]


def plain_world(rows):
    out, was, state, place = [], False, None, None
    for tick, present, owner, x, pvs in rows:
        world = present and owner is None
        ends = not present or (was and not world)
        if not world and not ends:
            was = False
            continue
        if world and was and state == (x, pvs):
            continue
        speed = (x - place[1]) / (tick - place[0]) if place and x is not None and tick > place[0] else None
        out.append((tick, 2 if ends else 0 if was else 1, speed))
        place = (tick, x) if x is not None else place
        state, was = (x, pvs), world
    return out


def test_world_weapons_like_a_loop(spark):
    rnd, lives = random.Random(3), {}
    for life in range(40):
        ticks = sorted(rnd.choices(range(30), k=14))
        lives[life] = [(t, rnd.random() < 0.8, rnd.choice([None, None, None, 7]), rnd.choice([None, 1.0, 1.0, 4.0]), rnd.choice([0, 0, 1])) for t in ticks]
    rows = [(0, life, seq, *row) for life, some in lives.items() for seq, row in enumerate(some)]
    df = spark.createDataFrame(rows, "clip_id long, life_id long, seq long, tick long, present boolean, owner long, x double, pvs_state int").withColumn("owner_handle", F.lit(0xFFFFFF))
    got = replay.world_weapon_deltas(df, xyz=["x"]).orderBy("life_id", "tick", "seq").collect()
    for life, some in lives.items():
        assert [(r["tick"], r["operation"], r["vx"]) for r in got if r["life_id"] == life] == plain_world(some)


def test_lives_and_inventories(spark):
    clips = spark.createDataFrame([(1, "a", 0, 9), (2, "a", 5, 20)], "clip_id long, log string, start long, end long")
    columns = "log string, tick long, seq long, entity int, serial int, owner long, owner_handle long, active boolean, present boolean, slot int, clip int, reserve int, position int"
    row = lambda tick, seq, entity, owner, clip: ("a", tick, seq, entity, 1, owner, None, None, True, 200, clip, 40_000, 3)
    shots = spark.createDataFrame([row(6, 1, 9, 5, 30), row(6, 1, 9, 5, 30), row(7, 2, 4, 5, 30), row(8, 3, 9, 5, 30), row(12, 4, 9, None, 30), row(13, 5, 9, None, 29)], columns)
    lives = replay.weapon_lives(shots, clips, ["log"], 8)
    assert sorted({(r["clip_id"], r["entity"], r["life_id"]) for r in lives.collect()}) == [(1, 4, 2), (1, 9, 1), (2, 4, 2), (2, 9, 1)]
    players = replay.numbered(spark.createDataFrame([("a", 5)], "log string, steamid long"), ["log"])
    got = replay.inventory_deltas(lives, players, ["log"]).orderBy("clip_id", "life_id", "tick").collect()
    assert [(r["clip_id"], r["life_id"], r["tick"], r["owner_index"], r["flags"], r["slot"], r["clip"], r["reserve"]) for r in got] == [
        (1, 1, 6, 0, 1, None, 30, None), (1, 2, 7, 0, 1, None, 30, None), (2, 1, 6, 0, 1, None, 30, None), (2, 1, 12, 255, 8, None, 30, None), (2, 1, 13, 255, 8, None, 29, None), (2, 2, 7, 0, 1, None, 30, None),
    ]


def test_clips_of_one_id_are_disjoint(spark):
    clips = spark.createDataFrame([(1, "a", 0, 9), (1, "a", 0, 9), (1, "a", 5, 12), (1, "a", 6, 7), (1, "b", 5, 12), (1, "a", 20, 21), (2, "a", 5, 4)], "clip_id long, log string, start long, end long")
    got = replay.disjoint(clips, ["log"]).select("clip_id", "log", "start", "end")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0, 9), (1, "a", 10, 12), (1, "a", 20, 21), (1, "b", 5, 12)]
    shots = spark.createDataFrame([("a", 6, 1, 9, 1), ("a", 6, 1, 9, 1), ("a", 11, 2, 4, 1), ("a", 6, 0, 4, 1)], "log string, tick long, seq long, entity int, serial int")
    lives = replay.weapon_lives(shots, clips, ["log"], 8)
    assert sorted((r["clip_id"], r["tick"], r["seq"], r["life_id"]) for r in lives.collect()) == [(1, 6, 0, 1), (1, 6, 1, 2), (1, 11, 2, 1)]
    assert replay.weapon_lives(shots, clips, ["log"], 8, per_task=2).rdd.getNumPartitions() == 4  # more clips, more tasks


@pytest.mark.parametrize("name", ["inventory_deltas", "shake_states", "world_weapon_deltas"])
def test_pairs_of_clip_and_snapshot_are_sent_once(spark, name):
    """From the join with the clips on there is one exchange, by clip, even where no side of a join is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        planned = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = planned[: planned.index("__start")]
    assert above.count("Exchange ") == 1 and "Join" not in above.rsplit("\n", 1)[0]


def test_entities_stand_once(spark):
    rows = [(1, "spawn", 1.0, False), (2, "spawn", 1.01, False), (3, "delete", 1.0, True), (4, "spawn", 1.0, False), (5, "update", 1.0, False), (6, "delete", 1.0, False), (7, "spawn", 1.0, None), (8, "spawn", None, None), (9, "delete", 1.0, None), (12, "spawn", 1.0, None)]
    df = spark.createDataFrame([("a", t, t, "door", x, o, d) for t, o, x, d in rows], "log string, tick long, seq long, kind string, x double, operation string, dormant boolean")
    assert [r["tick"] for r in replay.standing_once(df, ["log"], "kind", ["x"]).orderBy("tick").collect()] == [1, 3, 5, 6, 7, 8, 9, 12]
    clips = spark.createDataFrame([(1, "a", 5, 9), (2, "a", 9, 5), (3, "b", 0, 99)], "clip_id long, log string, start long, end long")
    got = replay.clip_entities(df, clips, ["log"], "kind", ["x"], 4).orderBy("seq").collect()
    assert [(r["clip_id"], r["seq"], r["tick"]) for r in got] == [(1, 1, 5), (1, 5, 5), (1, 6, 6), (1, 7, 7), (1, 8, 8), (1, 9, 9)]


def test_events_with_places_and_inputs(spark):
    clips = spark.createDataFrame([(1, "a", 0, 9)], "clip_id long, log string, start long, end long")
    events = spark.createDataFrame(
        [("a", 1, "decoy_started", 1.0, 2.0, 2047), ("a", 2, "decoy_started", float("nan"), 2.0, 5), ("a", 3, "inferno_startburn", float("inf"), 2.0, 5), ("a", 4, "smokegrenade_detonate", 1.0, 2.0, 5), ("a", 5, "other", 1.0, 2.0, 5), ("a", 10, "decoy_started", 1.0, 2.0, 5), ("a", 6, "hegrenade_detonate", None, 2.0, 5)],
        "log string, tick long, name string, x double, y double, entityid long",
    ).withColumn("z", F.lit(0.0))
    assert sorted((r["tick"], r["kind"], r["entityid"]) for r in replay.detonations(events, clips, ["log"], 4).collect()) == [(1, 5, None), (4, 3, 5)]
    assert replay.detonations(events.where("false"), clips, ["log"], 4).count() == 0
    players = spark.createDataFrame([("a", 7, 0)], "log string, steamid long, index int")
    raw = spark.createDataFrame([("a", 1, "fire_bullets", 7, 1.0, None, 3), ("a", 2, "fire_bullets", None, 1.0, 2.0, None)], "log string, tick long, name string, user_steamid long, ox double, oy double, seed int")
    got = replay.inputs(raw, clips, players, ["log"], [["ox", "oy"], ["seed"]], 4).orderBy("tick").collect()
    assert [(r["presence"], r["ox"], r["seed"], r["player_index"]) for r in got] == [(2, None, 3, 0), (1, 1.0, None, 255)]
    assert [r["c"] for r in spark.createDataFrame([("CFuncBrush",), ("CWeaponDoor",), ("CWorld",)], "n string").select(replay.world_class(F.col("n")).alias("c")).collect()] == [True, False, False]


def test_sources_states_meta_and_faults(spark):
    kills = spark.createDataFrame([(1, "a", 10, 7), (2, "a", 50, 7)], "kill long, log string, tick long, victim long")
    ticks = spark.createDataFrame([("a", 10, 7, True, 1, [1.0]), ("a", 11, 7, False, None, [2.0]), ("a", 12, 7, False, 1, [float("nan")]), ("a", 53, 7, False, 1, [3.0])], "log string, tick long, steamid long, alive boolean, bone int, origin array<double>")
    assert [(r["kill"], r["source_tick"], r["origin"]) for r in replay.death_sources(kills, ticks, ["log"], "victim", "kill", ["bone"], "origin").collect()] == [(1, 12, None)]
    rows = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, None), (5, 1, None), (6, 1, None)], "tick long, seq long, scoped boolean").withColumn("steamid", F.lit(1))
    got = replay.player_states(rows, ["steamid"], {4: F.col("scoped")}, []).orderBy("tick").collect()
    assert [(r["tick"], r["flags"], r["known"]) for r in got] == [(1, 4, 4), (3, 0, 0), (5, 0, 0)]
    clips = spark.createDataFrame([(1, "a", 9, 0), (2, "b", 9, 64)], "clip_id long, log string, killer long, pad int")
    players = spark.createDataFrame([("a", 9, 1, "n", "Unknown", "3"), ("a", 8, 0, None, "2", None)], "log string, steamid long, index int, name string, team string, seen_team string")
    meta = {r["clip_id"]: json.loads(r["meta"]) for r in replay.clip_meta(clips, players, ["log"], "killer", ["clip_id"], "pad").collect()}
    assert meta[1] == {"clip_id": 1, "killer_index": 1, "padding": -1, "players": [{"index": 0, "steamid": "8", "team": "T"}, {"index": 1, "steamid": "9", "name": "n", "team": "CT"}]}
    assert meta[2] == {"clip_id": 2, "killer_index": 255, "padding": 64, "players": []}
    arrays = spark.createDataFrame([(1, [1, 2], [0, 1, 3], [1, 2, 3]), (2, [1], [0, 2, 1], [1]), (3, None, None, None), (4, [], [0], []), (5, [], [], [])], "clip int, v array<int>, o array<int>, w array<int>")
    faults = [r["faults"] for r in replay.array_faults(arrays, ["v"], F.size("v"), "o", ["w"]).orderBy("clip").collect()]
    assert faults == [
        [],
        ["number of offsets", "offsets fall"],
        ["size of v", "number of offsets", "first offset", "end of w"],
        [],
        ["number of offsets", "first offset", "end of w"],
    ]


def test_timeline_clocks_and_sounds(spark):
    h = lambda entity, serial: (serial << 14) | entity
    writes = spark.createDataFrame([("a", 5, 1, 7, h(3, 2)), ("a", 6, 2, 7, h(3, 2)), ("a", 7, 3, 7, h(3, 4)), ("a", 9, 4, 7, None), ("a", 12, 5, 7, h(3, 2))], "log string, tick long, seq long, steamid long, handle long")
    lives = spark.createDataFrame([("a", 3, 2, "knife", 1, 1), ("a", 3, 2, None, 10, 1), ("b", 3, 4, "other", 1, 1)], "log string, entity int, serial long, class string, tick long, seq long")
    assert [(r["tick"], r["class"]) for r in replay.weapon_timeline(writes, lives, ["log"]).orderBy("tick").collect()] == [(5, "knife"), (7, None), (9, None), (12, None)]
    clips = spark.createDataFrame([(1, "a", 0, 9)], "clip_id long, log string, start long, end long")
    ticks = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 2.0), ("a", 2, 2.0), ("a", 2, 3.0), ("a", 3, float("inf")), ("a", 4, None), ("a", 12, 1.0)], "log string, tick long, game_time double")
    assert sorted((r["tick"], r["game_time"], r["conflict"]) for r in replay.clocks(ticks, clips, ["log"], 4).collect()) == [(1, 2.0, False), (2, None, True)]
    shakes = spark.createDataFrame([(1, 1, 1, 1, True, 2.0), (1, 1, 1, 2, True, 3.0), (1, 1, 2, 3, True, 3.0), (1, 1, 3, 4, False, 3.0), (1, 1, 4, 5, True, float("nan")), (1, 2, 1, 6, False, 1.0)], "clip_id long, life_id long, tick long, seq long, present boolean, last_shake double")
    assert sorted((r["life_id"], r["tick"], r["last_shake"]) for r in replay.shake_states(shakes).collect()) == [(1, 1, 3.0), (1, 3, None), (2, 1, None)]
    sounds = spark.createDataFrame([("a", 1, 30, 0), ("a", 2, 10, 1), ("a", 3, 10, 1), ("a", 11, 0, 0)], "log string, tick long, frame_offset long, message_index long")
    assert sorted((r["tick"], r["place"] > 1, r["repeated"]) for r in replay.audio_records(sounds, clips, ["log"], 4).collect()) == [(1, True, False), (2, False, True), (3, False, True)]


def test_velocity_counts_ticks_that_are_not_asked_for(spark):
    df = spark.createDataFrame([(t, 7, float(x), ok) for t, x, ok in ((1, 0, True), (2, 1, True), (3, 99, None), (4, 3, True), (5, 99, False), (6, 7, True))], "tick long, steamid long, x double, ok boolean")
    ticks = spark.createDataFrame([(2,), (5,), (6,), (6,)], "tick long")
    got = win.velocity_history(df, ["steamid"], ["tick"], {"vx": "x"}, ticks, F.col("ok")).orderBy("tick").collect()
    # the rows before 6 are those of 4 and 2
    assert [(r["tick"], r["vx"]) for r in got] == [(2, None), (6, 128.0)]
