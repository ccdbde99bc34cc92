"""Queries of reports, weapons, registries and catalog rows over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import weapons
from ..operators import reports
from ..query import LogQuery, Registry
from ..session import Engine
from ..sources import sinks
from . import catalog
from .queries import POINTS, lane, points, query, table


@query("""SELECT s.seq AS clip_id, l.seq, l.value FROM (SELECT * FROM lane WHERE name = 'click') s JOIN lane l ON l.steamid = s.steamid AND l.tick BETWEEN s.tick - 300000 AND s.tick""")
def aim_windows(spark, sf):
    df = lane(spark, sf)
    hurts = df.where("name = 'click'").select(F.col("steamid").alias("attacker"), "tick", F.col("seq").alias("event"))
    return reports.aim_windows(df, hurts, [], "attacker", "event", 300_000).select("clip_id", "seq", "value")


NAMES = ("hegrenade", "molotov", "inferno", "ak47")


@query("SELECT steamid, CASE k % 4 WHEN 0 THEN 'he' ELSE 'fire' END AS kind, sum(k)::BIGINT AS damage, count(*) AS hits FROM lane WHERE k % 4 < 3 GROUP BY ALL")
def utility_damage(spark, sf):
    hurts = lane(spark, sf).withColumn("weapon", F.element_at(F.array(*map(F.lit, NAMES)), F.col("k") % 4 + 1))
    return reports.utility_damage(hurts, ["steamid"], damage="k")


@query(", d AS (SELECT *, tick // 640000 AS bin FROM lane) SELECT DISTINCT steamid, bin, value FROM d WHERE bin IN (SELECT bin FROM d WHERE name = 'signup' AND k < 10) -- lane")
def equipment_at_events(spark, sf):
    df = lane(spark, sf).withColumn("bin", F.floor(F.col("tick") / 640_000))
    return reports.at_events(df, df.where("name = 'signup' AND k < 10"), [], ["value"], on="bin").select("steamid", "bin", "value").distinct()


@query(", d AS (SELECT *, steamid % 7 AS log, tick // 6400000 AS bin FROM lane) SELECT log, bin, steamid, seq FROM d JOIN (SELECT log, max(bin) AS bin FROM d WHERE name = 'error' GROUP BY log) USING (log, bin) -- lane")
def codes_at_last_event(spark, sf):
    df = lane(spark, sf).withColumns({"log": F.col("steamid") % 7, "bin": F.floor(F.col("tick") / 6_400_000)})
    return reports.at_last_event(df, df.where("name = 'error'"), ["log"], ["seq"], on="bin").select("log", "bin", "steamid", "seq")


@query(
    """SELECT e.seq, round((e.tick - s.tick) / 64, 4) AS into_round FROM (SELECT * FROM lane WHERE name = 'error') e ASOF LEFT JOIN (SELECT DISTINCT steamid, tick FROM lane WHERE name = 'signup') s ON e.steamid = s.steamid AND e.tick >= s.tick"""
)
def time_into_round(spark, sf):
    df = lane(spark, sf).withColumn("game_time", F.col("tick") / 64)
    got = reports.time_into(df.where("name = 'error'"), df.where("name = 'signup'").select("steamid", "tick", "game_time").distinct(), ["steamid"], "game_time")
    return got.select("seq", F.round("into", 4).alias("into_round"))


@query("SELECT seq, steamid, tick FROM lane WHERE name = 'error' AND k % 5 = 2")
def chicken_kills(spark, sf):
    kind = F.when(F.col("k") % 5 == 2, "chicken").otherwise("other")
    return reports.of_kind(lane(spark, sf).withColumn("othertype", kind), "error", "othertype", "chicken").select("seq", "steamid", "tick")


@query(
    """SELECT e.seq, 'zone' || (s.k % 3) AS site FROM (SELECT * FROM lane WHERE name = 'purchase') e ASOF LEFT JOIN (SELECT steamid, tick, arg_max(k, seq) AS k FROM lane WHERE name = 'view' GROUP BY ALL) s ON e.steamid = s.steamid AND e.tick >= s.tick"""
)
def site_of_event(spark, sf):
    """An event with its player's last place, through the dataset's event query."""
    df = lane(spark, sf)
    ticks = df.where("name = 'view'").groupBy("steamid", "tick").agg(F.concat(F.lit("zone"), (F.max_by("k", "seq") % 3).cast("string")).alias("last_place_name"))
    log = Engine(spark).from_tables(events=df, ticks=ticks)
    return log.event("purchase", player=["last_place_name"], roles={"steamid": "user"}).select("seq", F.col("user_last_place_name").alias("site"))


@query(
    """, n AS (SELECT *, (row_number() OVER (PARTITION BY steamid ORDER BY tick, seq) - 1) // 16 AS part FROM lane WHERE name <> 'error')
    SELECT steamid, part, count(*)::INTEGER AS packets, string_agg(name, '' ORDER BY tick, seq) AS data FROM n GROUP BY steamid, part -- lane"""
)
def voice_per_player(spark, sf):
    voice = lane(spark, sf).where("name <> 'error'").withColumn("bytes", F.col("name").cast("binary"))
    return reports.voice_chunks(voice, ["steamid"], ["tick", "seq"], chunk=16).withColumn("data", F.col("data").cast("string"))


@query(POINTS + "SELECT label, round(min(x), 4) AS min_x, round(max(x), 4) AS max_x, round(min(y), 4) AS min_y, round(max(y), 4) AS max_y FROM p GROUP BY label")
def bounding_box(spark, sf):
    return reports.bounds(points(spark, sf), ["label"]).select("label", *[F.round(c, 4).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("SELECT seq FROM lane WHERE name = 'error' AND k IS NOT NULL AND k <= 80 AND steamid % 9 <> 0")
def kill_rows(spark, sf):
    df = lane(spark, sf).where("name = 'error'")
    deaths = df.select("seq", "steamid", F.col("k").alias("victim"), F.when(F.col("steamid") % 9 != 0, "ak47").otherwise(" ").alias("weapon"), (F.col("k") > 80).alias("warmup"))
    return reports.kill_rows(deaths).select("seq")


@query("SELECT steamid, coalesce(arg_min(CASE WHEN name = 'signup' AND k < 20 THEN tick / 64 END, CASE WHEN name = 'signup' AND k < 20 THEN (tick, seq) END), 0) AS \"offset\" FROM lane GROUP BY steamid")
def game_start(spark, sf):
    starts = F.when((F.col("name") == "signup") & (F.col("k") < 20), "round_start").otherwise("other")
    return reports.game_start(lane(spark, sf).withColumn("name", starts).withColumn("game_time", F.col("tick") / 64), ["steamid"])


@query("SELECT seq, CASE WHEN k - 30 >= 0 THEN k - 30 - CASE WHEN steamid % 3 = 0 THEN 0 ELSE steamid END ELSE k - 30 END AS server_tick FROM lane")
def local_ticks(spark, sf):
    df = lane(spark, sf).withColumn("server_tick", F.col("k").cast("long") - 30)
    headers = df.where("steamid % 3 <> 0").select("steamid", F.col("steamid").cast("string").alias("server_start_tick")).distinct()
    return reports.local_ticks(df, headers, ["steamid"], ["server_tick"]).select("seq", "server_tick")


@query(
    """, d AS (SELECT steamid, tick, arg_max(k, seq) AS force FROM lane WHERE name = 'view' AND k > 20 GROUP BY ALL)
    SELECT e.seq, arg_min(d.force, d.tick) AS force FROM (SELECT * FROM lane WHERE name = 'error') e JOIN d ON d.steamid = e.steamid AND d.tick BETWEEN e.tick AND e.tick + 2000000 GROUP BY e.seq -- lane"""
)
def ragdoll_impacts(spark, sf):
    df = lane(spark, sf)
    ticks = df.where("name = 'view'").groupBy("steamid", "tick").agg(F.max_by(F.when(F.col("k") > 20, F.col("k")), F.when(F.col("k") > 20, F.col("seq"))).alias("force")).withColumn("alive", F.lit(False))
    kills = df.where("name = 'error'").select("steamid", "tick", "seq", F.col("steamid").alias("victim_id"))
    return reports.ragdoll_impacts(kills.drop("steamid"), ticks, [], "victim_id", "seq", ["force"], slack=2_000_000).select("seq", "force")


@query("SELECT steamid, tick FROM (SELECT steamid, tick, k % 2 = 1 AS now, coalesce(lag(k % 2 = 1) OVER (PARTITION BY steamid ORDER BY tick), false) AS before FROM lane) WHERE now AND NOT before")
def press_edges(spark, sf):
    # the SQL leaves rows of one tick in the order of the table, which is that of seq
    return reports.press_edges(lane(spark, sf), ["steamid"], F.col("k") % 2 == 1, ["tick", "seq"], every=True).select("steamid", "tick")


@query("SELECT o_orderkey, coalesce((SELECT min(c_nationkey) FROM customer c WHERE c.c_custkey = o_custkey AND c_acctbal >= 0), (SELECT min(c_nationkey) FROM customer c WHERE c.c_mktsegment = o_orderpriority), 4) AS idx FROM orders")
def player_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("who"))
    c = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("who"), F.col("c_nationkey").alias("idx"))
    return reports.player_index(o, c, [], "id", "who", "idx", 4).select("o_orderkey", "idx")


@query(
    """SELECT seq, CASE k % 4 WHEN 0 THEN 44 WHEN 1 THEN 46 WHEN 2 THEN 48 ELSE 7 END AS by_name, CASE WHEN k % 3 = 1 THEN k WHEN k % 7 = 0 THEN 0 ELSE CASE k % 4 WHEN 0 THEN 44 WHEN 1 THEN 46 WHEN 2 THEN 48 ELSE 7 END END AS id FROM lane"""
)
def weapon_ids(spark, sf):
    k = F.col("k")
    name = F.concat(F.lit(" Weapon_"), F.element_at(F.array(*map(F.lit, NAMES)), k % 4 + 1))
    return lane(spark, sf).select("seq", weapons.weapon_id(name).alias("by_name"), weapons.weapon_id_or(F.when(k % 3 == 1, k).when(k % 3 == 2, 0), F.when(k % 7 == 0, "unknown").otherwise(name)).alias("id"))


@query("SELECT seq, CAST(((k - 50) & 4294967295)::HUGEINT * 4294967296 + steamid AS VARCHAR) AS owner, name = 'view' AS thrown FROM lane")
def original_owner(spark, sf):
    event = F.when(F.col("name") == "view", "smokegrenade_detonate").otherwise("round_end")
    return lane(spark, sf).select("seq", weapons.original_owner((F.col("k") - 50).cast("int"), F.col("steamid")).alias("owner"), weapons.is_utility_event(event).alias("thrown"))


@query("SELECT tick, steamid, name, k AS health, k > 0 AND k <= 90 AS fit, (k > 0 AND k <= 90) AND value > 50 AS ready FROM lane WHERE k > 0 AND k <= 90")
def friendly_names(spark, sf):
    """Names of the caller for columns, derived columns over derived ones, and a state filter by such a name."""
    derived = {"fit": (["health"], lambda: F.col("k").between(1, 90)), "ready": (["Weapon.fit", "value"], lambda: F.col("fit") & (F.col("value") > 50))}
    log = Engine(spark, Registry({"health": "k"}, derived)).from_tables(ticks=lane(spark, sf))
    return log.ticks(LogQuery(columns=["Weapon.health", "fit", "ready"], states={"Weapon.fit": True}, state_mode="row")).withColumnRenamed("Weapon.health", "health")


@query("SELECT seq, k AS user_k, name FROM lane WHERE name <> 'error'")
def public_events(spark, sf):
    """Events without the raw ids and the helper event."""
    df = lane(spark, sf).select("seq", F.when(F.col("name") == "error", "item_sold").otherwise(F.col("name")).alias("name"), F.col("steamid").alias("userid"), F.col("value").alias("attacker_pawn"), F.col("k").alias("user_k"))
    return Engine(spark).from_tables(events=df).public(df)


@query(
    """, r AS (SELECT steamid, tick // 5529600 AS day, seq, name, CASE WHEN k % 3 > 0 THEN list_transform(range(k % 3), lambda i: k + i) ELSE [] END AS hits FROM lane)
    SELECT steamid, day, array_to_string(list(seq ORDER BY seq), ',') AS seqs, array_to_string(list(sizes ORDER BY seq), ',') AS ends, array_to_string(flatten(list(hits ORDER BY seq)), ',') AS hits
    FROM (SELECT *, sum(len(hits)) OVER (PARTITION BY steamid, day ORDER BY seq) AS sizes FROM r) GROUP BY steamid, day -- lane"""
)
def fire_arrays(spark, sf):
    """Shots of a user's day as parallel arrays, and the hits of each shot flat with offsets."""
    k = F.col("k")
    hits = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0), k % 3 - 1), lambda i: F.struct((k + i).alias("hit"))))
    rows = lane(spark, sf).select("steamid", F.floor(F.col("tick") / 5529600).cast("long").alias("day"), "seq", "name", hits.alias("hits"))
    got = sinks.nested_csr(rows, ["steamid", "day"], "seq", ["name"], "hits", ["hit"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return got.select("steamid", "day", text(F.col("seq")).alias("seqs"), text(F.slice("offsets", 2, F.size("seq"))).alias("ends"), text(F.col("hit")).alias("hits"))


# catalog rows
@query("""SELECT l_returnflag AS type, l_linestatus AS folder, count(*) AS collections, count(DISTINCT l_suppkey) AS demos, count(DISTINCT l_partkey) AS players FROM lineitem GROUP BY ALL""")
def manifest(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("folder"), F.col("l_suppkey").alias("demo_name"), F.col("l_partkey").alias("steam_id"))
    read = F.from_json("manifest", "collections long, demos long, players long")
    return catalog.manifest(df).select("type", "folder", read["collections"].alias("collections"), read["demos"].alias("demos"), read["players"].alias("players"))


@query("SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS expected, count(*) >= max(l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey")
def demo_completeness(spark, sf):
    return catalog.completeness(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END) AS key FROM lineitem")
def collection_keys(spark, sf):
    flag = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    key = catalog.collection_key(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), flag)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("key"))


@query(
    """, g AS (SELECT steamid, tick // 5529600 AS day, list(tick ORDER BY tick, name) AS ticks, list(name ORDER BY tick, name) AS names FROM lane GROUP BY ALL)
    SELECT steamid, day, array_to_string(ticks, ',') AS ticks, array_to_string(names, ',') AS names, len(ticks) = 2 AND ticks[1] = ticks[2] AS twice FROM g -- lane"""
)
def sanitised_collections(spark, sf):
    df = lane(spark, sf).withColumn("day", F.floor(F.col("tick") / 5529600).cast("long"))
    mixed = F.sort_array(F.collect_list(F.struct(F.xxhash64("seq"), "tick", F.concat(F.lit(" "), "name", F.lit(" ")).alias("name"))))
    rows = df.groupBy("steamid", "day").agg(mixed.alias("r")).select("steamid", "day", F.col("r")["tick"].alias("ticks"), F.col("r")["name"].alias("names"))
    got = catalog.sanitised(rows, [], ["names"], parallel=["ticks", "names"])
    return got.select("steamid", "day", F.array_join(F.transform("ticks", lambda t: t.cast("string")), ",").alias("ticks"), F.array_join("names", ",").alias("names"), catalog.same_tick(F.col("ticks"), 2).alias("twice"))


@query(r"SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substring(url, 9) ELSE CASE WHEN regexp_extract(url, '([^/]+)/[^/]*$', 1) = '' THEN '' ELSE regexp_extract(url, '([^/]+)/[^/]*$', 1) || '/' END END AS folder FROM pages")
def relative_folder(spark, sf):
    return table(spark, sf, "pages").select("page_id", catalog.relative_folder(F.col("url"), "https://").alias("folder"))


@query("SELECT o_orderkey, o_custkey, coalesce((SELECT min(l_shipdate)::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'), o_orderpriority) AS path, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS saved FROM orders")
def saved_rounds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("path"))
    saved = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("string").alias("path"))
    return catalog.prefer_saved(o, saved, ["o_orderkey"])
