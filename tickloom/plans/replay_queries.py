"""Queries of replay lanes over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay
from ..operators import windows as win
from ..sources import sinks
from .clip_queries import CLIPS, WIDTH, clips_of
from .queries import lane, query

LOG = ["log"]
LOGS = (
    CLIPS
    + """, c AS (SELECT clip_id, start, "end", steamid // 3 AS log FROM clips), l AS (SELECT *, steamid // 3 AS log, steamid // 3 * 3 + (k * 31 + seq) % 4 AS victim FROM lane),
    p AS (SELECT log, steamid, row_number() OVER (PARTITION BY log ORDER BY steamid) - 1 AS index FROM (SELECT DISTINCT log, steamid FROM l)),
    d AS (SELECT *, CASE WHEN k % 7 > 0 THEN k % 3 = 0 END AS headshot, k % 5 - 1 AS penetrated FROM l WHERE name = 'error')
"""
)


def logs(spark, sf):
    """The lane cut into logs of three players each, their clips, their players; some victims are none of the log's."""
    df = lane(spark, sf).withColumns({"log": F.floor(F.col("steamid") / 3), "victim": F.floor(F.col("steamid") / 3) * 3 + (F.col("k") * 31 + F.col("seq")) % 4})
    return df, clips_of(spark, sf).withColumn("log", F.floor(F.col("steamid") / 3)).drop("steamid"), replay.numbered(df, LOG)


def deaths_of(df):
    return df.where("name = 'error'").withColumns({"headshot": F.when(F.col("k") % 7 > 0, F.col("k") % 3 == 0), "penetrated": F.col("k") % 5 - 1})


@query(
    LOGS
    + """SELECT clip_id, seq, coalesce(a.index, 255) AS killer_index, coalesce(v.index, 255) AS victim_index, (CASE WHEN headshot THEN 1 ELSE 0 END) + (CASE WHEN penetrated > 0 THEN 16 ELSE 0 END) AS flags,
    (CASE WHEN headshot IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN penetrated >= 0 THEN 16 ELSE 0 END) AS known, CASE WHEN penetrated >= 0 THEN penetrated END AS penetrated
    FROM c JOIN d ON c.log = d.log AND d.tick BETWEEN c.start AND c."end" LEFT JOIN p a ON a.log = d.log AND a.steamid = d.steamid LEFT JOIN p v ON v.log = d.log AND v.steamid = d.victim -- lane"""
)
def clip_kills(spark, sf):
    df, clips, players = logs(spark, sf)
    got = replay.clip_kills(deaths_of(df), clips, players, LOG, "steamid", "victim", WIDTH, salts=4)
    return got.select("clip_id", "seq", "killer_index", "victim_index", "flags", "known", "penetrated")


@query(
    LOGS
    + """, b AS (SELECT seq, log, tick // 400000 AS bin, steamid, victim + (k % 4 = 0)::INT AS victim FROM l WHERE name = 'error'),
    s AS (SELECT log, tick // 400000 AS bin, steamid, victim, arg_max(struct_pack(h := headshot, p := penetrated), seq) AS s FROM d GROUP BY ALL),
    air AS (SELECT log, tick // 400000 AS bin, steamid, arg_max(k % 4, seq) AS a FROM l WHERE k % 10 > 0 GROUP BY ALL),
    w AS (SELECT b.seq, s.s, CASE WHEN n.a IS NOT NULL THEN n.a ELSE o.a END AS ka, CASE WHEN m.a IS NOT NULL THEN m.a ELSE q.a END AS va FROM b LEFT JOIN s USING (log, bin, steamid, victim)
        LEFT JOIN air n ON n.log = b.log AND n.bin = b.bin AND n.steamid = b.steamid LEFT JOIN air o ON o.log = b.log AND o.bin = b.bin - 1 AND o.steamid = b.steamid
        LEFT JOIN air m ON m.log = b.log AND m.bin = b.bin AND m.steamid = b.victim LEFT JOIN air q ON q.log = b.log AND q.bin = b.bin - 1 AND q.steamid = b.victim)
    SELECT seq, (CASE WHEN s.h THEN 1 ELSE 0 END) + (CASE WHEN s.p > 0 THEN 16 ELSE 0 END) + (CASE WHEN ka = 2 THEN 32 ELSE 0 END) + (CASE WHEN va = 2 THEN 64 ELSE 0 END) AS flags,
    (CASE WHEN s.h IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN s.p >= 0 THEN 16 ELSE 0 END) + (CASE WHEN ka > 0 THEN 32 ELSE 0 END) + (CASE WHEN va > 0 THEN 64 ELSE 0 END) AS known, CASE WHEN s.p >= 0 THEN s.p END AS penetrated FROM w -- lane"""
)
def enriched_kills(spark, sf):
    df = logs(spark, sf)[0].withColumn("tick", F.floor(F.col("tick") / 400_000))
    kills = df.where("name = 'error'").withColumn("victim", F.col("victim") + (F.col("k") % 4 == 0).cast("int")).select("seq", "log", "tick", "steamid", "victim")
    ticks = df.withColumns({"alive": F.col("k") % 10 > 0, "airborne": F.when(F.col("k") % 4 > 0, F.col("k") % 4 == 2)})
    return replay.enriched_kills(kills, deaths_of(df), ticks, LOG, "steamid", "victim", "seq").select("seq", "flags", "known", "penetrated")


@query(
    LOGS
    + """, dead AS (SELECT * FROM l WHERE k % 2 = 0 AND k % 6 > 0)
    SELECT d.seq, arg_min(x.tick, (x.tick, x.seq)) AS source_tick FROM d JOIN dead x ON x.log = d.log AND x.steamid = d.steamid AND x.tick BETWEEN d.tick AND d.tick + 900000 GROUP BY d.seq -- lane"""
)
def death_sources(spark, sf):
    df = logs(spark, sf)[0]
    ticks = df.withColumns({"alive": F.col("k") % 2 > 0, "bone": F.when(F.col("k") % 6 > 0, F.col("k")), "origin": F.array("value", F.lit(1.0), F.lit(2.0))})
    return replay.death_sources(df.where("name = 'error'"), ticks, LOG, "steamid", "seq", ["bone"], "origin", slack=900_000).select("seq", "source_tick")


SNAPSHOTS = """, n AS (SELECT log, tick, seq, k % 3 AS entity, steamid % 2 AS serial, CASE WHEN k % 5 > 2 THEN steamid END AS owner, CASE WHEN k % 11 = 0 THEN 5 WHEN k % 11 < 8 THEN 16383 END AS handle,
        CASE WHEN k % 4 > 0 THEN k % 4 = 1 END AS active, name <> 'view' AS present, k * 2 AS slot, k % 2 AS ammo, CASE WHEN k % 13 > 0 THEN k % 3 + 0.5::DOUBLE END AS x FROM l),
    r AS (SELECT clip_id, n.* FROM c JOIN n ON c.log = n.log AND tick BETWEEN start AND "end"),
    f AS (SELECT clip_id, entity, serial, row_number() OVER (PARTITION BY clip_id ORDER BY began, entity, serial) AS life_id FROM (SELECT clip_id, entity, serial, min((tick, seq)) AS began FROM r GROUP BY ALL)),
    lives AS (SELECT r.*, life_id, owner IS NULL AND (handle IS NULL OR handle = 16383) AS unowned FROM r JOIN f USING (clip_id, entity, serial))
"""


def lives_of(spark, sf, owners=False):
    df, clips, players = logs(spark, sf)
    k = F.col("k")
    shots = df.select(
        "log", "tick", "seq", (k % 3).alias("entity"), (F.col("steamid") % 2).alias("serial"), F.when(k % 5 > 2, F.col("steamid")).alias("owner"), F.when(k % 11 == 0, 5).when(k % 11 < 8, 16383).alias("owner_handle"),
        F.when(k % 4 > 0, k % 4 == 1).alias("active"), (F.col("name") != "view").alias("present"), (k * 2).alias("slot"), (k % 2).alias("clip"), F.lit(None).cast("int").alias("reserve"), F.lit(None).cast("int").alias("position"),
        F.when(k % 13 > 0, k % 3 + 0.5).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), (k % 2).alias("pvs_state"),
    )
    shots = replay.indexed(shots, players, LOG, {"owner": "owner_index"}) if owners else shots
    # longer clips, so that lives have several rows
    return replay.weapon_lives(shots, clips.withColumn("end", F.col("end") + 10_000_000), LOG, 10_000_000), players


LONGER = LOGS.replace('SELECT clip_id, start, "end", steamid // 3 AS log', 'SELECT clip_id, start, "end" + 10000000 AS "end", steamid // 3 AS log')


@query(
    LONGER
    + SNAPSHOTS
    + """, s AS (SELECT clip_id, life_id, tick, seq, CASE WHEN owner IS NULL THEN 255 ELSE p.index END AS owner_index, CASE WHEN slot < 128 THEN slot END AS slot, ammo AS clip,
        (CASE WHEN owner IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN active THEN 2 ELSE 0 END) + (CASE WHEN active IS NOT NULL THEN 4 ELSE 0 END) + (CASE WHEN unowned THEN 8 ELSE 0 END) + (CASE WHEN present THEN 0 ELSE 16 END) AS flags
        FROM lives LEFT JOIN p ON p.log = lives.log AND p.steamid = owner)
    SELECT clip_id, life_id, seq, owner_index, flags, slot, clip FROM s WINDOW w AS (PARTITION BY clip_id, life_id ORDER BY tick, seq)
    QUALIFY row_number() OVER w = 1 OR (owner_index, flags, clip, coalesce(slot, -1)) IS DISTINCT FROM lag((owner_index, flags, clip, coalesce(slot, -1))) OVER w -- lane"""
)
def inventory_deltas(spark, sf):
    lives, players = lives_of(spark, sf, owners=True)
    return replay.inventory_deltas(lives, players, LOG).select("clip_id", "life_id", "seq", "owner_index", "flags", "slot", "clip")


@query(
    LONGER
    + SNAPSHOTS
    + """, a AS (SELECT *, present AND unowned AS world, coalesce(lag(present AND unowned) OVER w, false) AS was, (coalesce(x, -1), ammo) IS NOT DISTINCT FROM lag((coalesce(x, -1), ammo)) OVER w AS same
        FROM lives WINDOW w AS (PARTITION BY clip_id, life_id ORDER BY tick, seq)),
    e AS (SELECT *, CASE WHEN NOT present OR (was AND NOT world) THEN 2 WHEN was THEN 0 ELSE 1 END AS operation FROM a WHERE (world OR NOT present OR was) AND NOT (world AND was AND same)),
    v AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN struct_pack(t := tick, x := x) END IGNORE NULLS) OVER (PARTITION BY clip_id, life_id ORDER BY tick, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM e)
    SELECT clip_id, life_id, seq, operation, round(CASE WHEN tick > o.t THEN (x - o.x) / (tick - o.t) * 1000000 END, 3) AS vx FROM v -- lane"""
)
def world_weapon_deltas(spark, sf):
    got = replay.world_weapon_deltas(lives_of(spark, sf)[0])
    return got.select("clip_id", "life_id", "seq", "operation", F.round(F.col("vx") * 1_000_000, 3).alias("vx"))


EVENTS = tuple(replay.DETONATIONS)


@query(
    LOGS
    + """SELECT clip_id, seq, k % 5 + 1 AS kind, CASE WHEN k % 9 > 0 THEN k END AS entityid FROM c JOIN l ON c.log = l.log AND tick BETWEEN start AND "end" WHERE k % 7 < 5 AND k % 8 > 0 -- lane"""
)
def detonations(spark, sf):
    df, clips, _ = logs(spark, sf)
    k = F.col("k")
    named = df.withColumns({
        "name": F.when(k % 7 < 5, F.element_at(F.array(*map(F.lit, EVENTS)), (k % 5 + 1).cast("int"))).otherwise("weapon_fire"),
        "x": F.when(k % 8 > 0, F.col("value")).otherwise(F.when(k % 16 > 0, float("nan"))), "y": F.lit(0.0), "z": F.lit(0.0),
        "entityid": F.when(k % 9 > 0, k).when(k % 2 > 0, -1).otherwise(2047),
    })
    return replay.detonations(named, clips, LOG, WIDTH).select("clip_id", "seq", "kind", "entityid")


@query(
    LOGS
    + """SELECT clip_id, seq, coalesce(p.index, 255) AS player_index FROM c JOIN l ON c.log = l.log AND tick BETWEEN start AND "end" LEFT JOIN p ON p.log = l.log AND p.steamid = CASE WHEN k % 3 > 0 THEN l.steamid ELSE l.victim END
    WHERE name = 'click' -- lane"""
)
def bullet_impacts(spark, sf):
    df, clips, players = logs(spark, sf)
    events = df.withColumns({"name": F.when(F.col("name") == "click", "bullet_impact"), "user_steamid": F.when(F.col("k") % 3 > 0, F.col("steamid")), "attacker_steamid": F.col("victim"), "x": F.col("value"), "y": F.lit(0.0), "z": F.lit(0.0)})
    return replay.impacts(events, clips, players, LOG, WIDTH).select("clip_id", "seq", "player_index")


@query(
    LOGS
    + """SELECT clip_id, seq, p.index AS player_index, (CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END) + 4 AS presence, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN k END AS px
    FROM c JOIN l ON c.log = l.log AND tick BETWEEN start AND "end" JOIN p ON p.log = l.log AND p.steamid = l.steamid WHERE name = 'purchase' -- lane"""
)
def fire_inputs(spark, sf):
    df, clips, players = logs(spark, sf)
    k = F.col("k")
    events = df.withColumns({"px": F.when(k % 2 == 0, k), "py": F.when(k % 3 == 0, k), "seed": F.when(k % 5 == 0, k)})
    got = replay.inputs(events, clips, players, LOG, [["px", "py"], ["seed"], ["value"]], WIDTH, user="steamid", name="purchase")
    return got.select("clip_id", "seq", "player_index", "presence", "px")


@query(
    CLIPS
    + """, o AS (SELECT steamid, tick, seq, k % 10 AS x, CASE k % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'spawn' END AS operation, k % 8 = 0 AS dormant FROM lane),
    m AS (SELECT *, lag(operation) OVER (PARTITION BY steamid, x ORDER BY tick, seq) AS before FROM o WHERE operation = 'spawn' OR (operation = 'delete' AND NOT dormant)),
    s AS (SELECT * FROM m WHERE operation = 'spawn' AND before IS DISTINCT FROM 'spawn')
    SELECT clip_id, seq, greatest(tick, start) AS tick FROM clips c JOIN s ON c.steamid = s.steamid AND tick <= "end" UNION ALL
    SELECT clip_id, seq, tick FROM clips c JOIN o ON c.steamid = o.steamid AND tick BETWEEN start AND "end" WHERE operation <> 'spawn' -- lane"""
)
def clip_entities(spark, sf):
    k = F.col("k")
    operation = F.when(k % 4 == 0, "delete").when(k % 4 == 1, "update").otherwise("spawn")
    deltas = lane(spark, sf).select("steamid", "tick", "seq", F.lit("door").alias("kind"), (k % 10).alias("x"), F.lit(0.0).alias("y"), operation.alias("operation"), (k % 8 == 0).alias("dormant"))
    return replay.clip_entities(deltas, clips_of(spark, sf), ["steamid"], "kind", ["x", "y"], WIDTH).select("clip_id", "seq", "tick")


@query(
    """, s AS (SELECT seq, steamid, tick // 4000000 AS bin, (CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN name = 'view' THEN 4 ELSE 0 END) AS flags, 4 + (CASE WHEN k % 6 <> 1 THEN 2 ELSE 0 END) AS known FROM lane)
    SELECT seq, flags, known FROM s WINDOW w AS (PARTITION BY steamid ORDER BY bin, seq) QUALIFY lag(bin) OVER w IS NULL OR (flags, known) IS DISTINCT FROM lag((flags, known)) OVER w OR bin - lag(bin) OVER w > 1 -- lane"""
)
def player_states(spark, sf):
    df = lane(spark, sf).withColumn("tick", F.floor(F.col("tick") / 4_000_000))
    flags = {2: F.when(F.col("k") % 6 != 1, F.col("k") % 3 == 0), 4: F.col("name") == "view"}
    return replay.player_states(df, ["steamid"], flags, []).select("seq", "flags", "known")


@query(
    LOGS
    + """, g AS (SELECT log, count(*) AS players, min_by(CASE WHEN steamid % 4 = 0 THEN 'T' WHEN steamid % 4 = 1 THEN 'CT' WHEN steamid % 3 = 0 THEN 'CT' ELSE '?' END, steamid) AS first_team FROM p GROUP BY log)
    SELECT clip_id, coalesce(p.index, 255) AS killer_index, CASE WHEN clip_id % 3 = 0 THEN -1 ELSE clip_id % 3 END AS padding, coalesce(players, 0) AS players, first_team FROM clips LEFT JOIN p ON p.log = clips.steamid // 3 AND p.steamid = clips.steamid LEFT JOIN g ON g.log = clips.steamid // 3 -- lane"""
)
def clip_meta(spark, sf):
    df, _, players = logs(spark, sf)
    s = F.col("steamid")
    told = players.withColumns({"name": F.concat(F.lit("player"), s), "team": F.when(s % 4 == 0, " 2 ").when(s % 4 == 1, "Counter-Terrorist").otherwise("Unknown"), "seen_team": F.when(s % 3 == 0, "CT")})
    clips = clips_of(spark, sf).withColumns({"log": F.floor(s / 3), "padding": F.col("clip_id") % 3})
    meta = F.from_json("meta", "killer_index long, padding long, players array<struct<team string>>").alias("m")
    got = replay.clip_meta(clips, told, LOG, "steamid", ["clip_id", "start", "end"], "padding").select("clip_id", meta)
    return got.select("clip_id", "m.killer_index", "m.padding", F.size("m.players").cast("long").alias("players"), F.get("m.players", F.lit(0))["team"].alias("first_team"))


@query("SELECT steamid, CASE WHEN steamid % 3 = 0 THEN 'size of value' WHEN steamid % 3 = 1 THEN 'end of a,end of b' ELSE '' END AS faults FROM lane GROUP BY ALL")
def array_faults(spark, sf):
    df = lane(spark, sf).withColumn("held", F.array_repeat(F.struct(F.col("k").alias("a"), F.col("seq").alias("b")), F.col("k") % 3 + 1))
    arrays = sinks.nested_csr(df, ["steamid"], "seq", ["value"], "held", ["a", "b"])
    s = F.col("steamid") % 3
    torn = arrays.withColumns({"value": F.when(s == 0, F.slice("value", 2, 1_000_000)).otherwise(F.col("value")), "offsets": F.when(s == 1, F.transform("offsets", lambda x, i: F.when(i > 0, x + 1).otherwise(x))).otherwise(F.col("offsets"))})
    got = replay.array_faults(torn, ["value"], F.size("seq"), "offsets", ["a", "b"])
    return got.select("steamid", F.array_join("faults", ",").alias("faults"))


@query(
    """, h AS (SELECT seq, tick, steamid, k % 6 + (k % 3) * 16384 AS handle FROM lane WHERE name <> 'signup'),
    w AS (SELECT * FROM h QUALIFY handle IS DISTINCT FROM lag(handle) OVER (PARTITION BY steamid ORDER BY tick, seq)),
    y AS (SELECT k % 6 AS entity, tick, seq, seq % 3 AS serial, CASE WHEN k % 5 > 0 THEN 'class' || (k % 4) END AS class FROM lane WHERE name = 'signup')
    SELECT w.seq, w.handle, CASE WHEN w.handle // 16384 = y.serial THEN y.class END AS class FROM w ASOF LEFT JOIN y ON w.handle % 16384 = y.entity AND (w.tick, w.seq) >= (y.tick, y.seq) -- lane"""
)
def weapon_timeline(spark, sf):
    df = lane(spark, sf).withColumn("log", F.lit(0))
    k = F.col("k")
    writes = df.where("name <> 'signup'").select("log", "seq", "tick", "steamid", (k % 6 + (k % 3) * 16384).alias("handle"))
    lifecycle = df.where("name = 'signup'").select("log", (k % 6).alias("entity"), "tick", "seq", (F.col("seq") % 3).alias("serial"), F.when(k % 5 > 0, F.concat(F.lit("class"), k % 4)).alias("class"))
    return replay.weapon_timeline(writes, lifecycle, LOG).select("seq", "handle", "class")


@query(
    LOGS
    + """, m AS (SELECT clip_id, tick // 10 AS tick, min(k % 2) AS a, max(k % 2) AS b FROM c JOIN l ON c.log = l.log AND tick // 10 BETWEEN start // 10 AND "end" // 10 WHERE k % 9 > 0 GROUP BY ALL)
    SELECT clip_id, tick, (CASE WHEN a = b THEN a END)::DOUBLE AS game_time, a <> b AS conflict FROM m -- lane"""
)
def clip_clocks(spark, sf):
    df, clips, _ = logs(spark, sf)
    ten = lambda c: F.floor(F.col(c) / 10)
    ticks = df.withColumns({"tick": ten("tick"), "game_time": F.when(F.col("k") % 9 > 0, (F.col("k") % 2).cast("double")).otherwise(float("nan"))})
    return replay.clocks(ticks, clips.withColumns({"start": ten("start"), "end": ten("end")}), LOG, WIDTH // 10).select("clip_id", "tick", "game_time", "conflict")


@query(
    LONGER
    + SNAPSHOTS
    + """, t AS (SELECT clip_id, life_id, tick, arg_max(coalesce(CASE WHEN present THEN x END, -1), seq) AS v FROM lives GROUP BY ALL)
    SELECT clip_id, life_id, tick, CASE WHEN v >= 0 THEN v END AS x FROM t QUALIFY v IS DISTINCT FROM lag(v) OVER (PARTITION BY clip_id, life_id ORDER BY tick) -- lane"""
)
def shake_states(spark, sf):
    return replay.shake_states(lives_of(spark, sf)[0], "x").select("clip_id", "life_id", "tick", "x")


@query(
    LOGS
    + """SELECT clip_id, seq, row_number() OVER (PARTITION BY clip_id ORDER BY k % 10, seq // 2, seq) - 1 AS place, count(*) OVER (PARTITION BY clip_id, k % 10, seq // 2, seq) > 1 AS repeated
    FROM c JOIN l ON c.log = l.log AND tick BETWEEN start AND "end" -- lane"""
)
def audio_records(spark, sf):
    df, clips, _ = logs(spark, sf)
    sounds = df.withColumns({"frame_offset": F.col("k") % 10, "message_index": F.floor(F.col("seq") / 2)})
    return replay.audio_records(sounds, clips, LOG, WIDTH, ["frame_offset", "message_index", "seq"]).select("clip_id", "seq", "place", "repeated")


@query(
    """, v AS (SELECT tick, seq, round(CAST(64 * (lag(v, 1) OVER w - lag(v, 2) OVER w) AS DOUBLE), 2) AS vx FROM (SELECT *, round(value * 4) / 4 AS v FROM lane WHERE k % 8 > 0) WINDOW w AS (PARTITION BY steamid ORDER BY tick, seq))
    SELECT seq, vx FROM v WHERE tick IN (SELECT tick FROM lane WHERE k % 3 = 0) -- lane"""
)
def velocity_history(spark, sf):
    df = lane(spark, sf).withColumn("v", F.round(F.col("value") * 4) / 4)
    got = win.velocity_history(df, ["steamid"], ["tick", "seq"], {"vx": "v"}, df.where("k % 3 = 0").select("tick"), F.col("k") % 8 > 0)
    return got.select("seq", F.round(F.col("vx").cast("double"), 2).alias("vx"))
