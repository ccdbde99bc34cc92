"""Queries over the driver's tables, one per operator, each with the SQL it must agree with.

`events` stands for a lane of a log: tick counts 64ths of a second from a fixed day, seq is the event's id, steamid the user, name the type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import asof, entities, joins, kills, reports
from ..operators import windows as win
from ..query import LogQuery
from ..session import Engine
from ..sources import replaylog
from . import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = LANE + sql if " lane" in sql else sql
        return f

    return register


LANE = """WITH lane AS (
    SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 64 / 1e6) AS BIGINT) AS tick, event_id AS seq,
           user_id AS steamid, event_type AS name, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lane(spark: SparkSession, sf: str) -> DataFrame:
    """events as (tick, seq, steamid, name, value, k)."""
    e = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    return e.select(
        F.floor(micros * 64 / 1e6).cast("long").alias("tick"), F.col("event_id").alias("seq"), F.col("user_id").alias("steamid"), F.col("event_type").alias("name"), "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as points: the first three components, scaled."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 100).alias(c) for i, c in enumerate("xyz")])


POINTS = "WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings) "


# projections and filters
@query("SELECT steamid, tick, value FROM lane")
def ticks_projection(spark, sf):
    return Engine(spark).from_tables(ticks=lane(spark, sf)).ticks(LogQuery(columns=["value"])).select("steamid", "tick", "value")


@query("SELECT seq, tick FROM lane WHERE tick % 100 IN (1, 7, 50)")
def tick_in_filter(spark, sf):
    df = lane(spark, sf)
    wanted = df.where((F.col("tick") % 100).isin(1, 7, 50)).select("tick")
    return Engine(spark).from_tables(ticks=df).ticks(LogQuery(columns=["seq"], ticks=wanted)).select("seq", "tick")


@query("SELECT seq, steamid FROM lane WHERE steamid IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def player_in_filter(spark, sf):
    wanted = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("steamid"))
    return Engine(spark).from_tables(ticks=lane(spark, sf)).ticks(LogQuery(columns=["seq"], players=wanted)).select("seq", "steamid")


@query("SELECT seq, name FROM lane WHERE name IN ('click', 'error')")
def event_name_filter(spark, sf):
    found = Engine(spark).from_tables(events=lane(spark, sf)).events(["click", "error"])
    return found["click"].unionByName(found["error"]).select("seq", "name")


@query("SELECT DISTINCT name FROM lane")
def event_names(spark, sf):
    return Engine(spark).from_tables(events=lane(spark, sf)).event_names()


@query("SELECT seq FROM (SELECT seq, sum(CASE WHEN value < 95 THEN 0 ELSE 1 END) OVER (PARTITION BY tick // 230400 ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS bad FROM lane) WHERE bad = 0")
def prop_state_abort(spark, sf):
    df = lane(spark, sf).withColumn("hour", F.floor(F.col("tick") / 230400))
    return win.aborted(df, ["hour"], ["tick", "seq"], F.col("value") < 95).select("seq")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red widget') OR NOT contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')")
def search_terms(spark, sf):
    return catalog.search(table(spark, sf, "part"), "Red Widget, !brand#1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F')")
def catalog_type_folder(spark, sf):
    df = table(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "type", "l_linestatus": "folder"})
    return catalog.enabled_only(df, ["A", "R"], ["F"]).select("l_orderkey", "l_linenumber")


@query("SELECT seq FROM lane WHERE name <> 'signup' AND NOT coalesce(k > 90, false)")
def warmup_filter(spark, sf):
    return kills.no_warmup(lane(spark, sf).withColumn("warm", F.col("k") > 90), "warm").where("name <> 'signup'").select("seq")


# carried state and as-of joins
@query("SELECT seq, last_value(CASE WHEN name = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY steamid ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS state FROM lane")
def state_locf(spark, sf):
    df = lane(spark, sf)
    return asof.carried(df, ["steamid"], ["tick", "seq"], {"state": F.when(F.col("name") == "view", F.col("value"))}).select("seq", "state")


@query("SELECT e.seq, s.value AS state FROM (SELECT * FROM lane WHERE name = 'purchase') e ASOF LEFT JOIN (SELECT steamid, tick, arg_max(value, seq) AS value FROM lane WHERE name = 'view' GROUP BY ALL) s ON e.steamid = s.steamid AND e.tick >= s.tick")
def event_asof_state(spark, sf):
    df = lane(spark, sf)
    views = df.where("name = 'view'").groupBy("steamid", "tick").agg(F.max_by("value", "seq").alias("state"))
    return asof.asof_join(df.where("name = 'purchase'"), views, ["steamid"], "tick", ["state"]).select("seq", "state")


@query(
    "SELECT e.seq, CASE WHEN e.tick - s.tick <= 500000 THEN s.value END AS state FROM (SELECT * FROM lane WHERE name = 'purchase') e ASOF LEFT JOIN (SELECT steamid, tick, arg_max(value, seq) AS value FROM lane WHERE name = 'view' GROUP BY ALL) s ON e.steamid = s.steamid AND e.tick >= s.tick"
)
def asof_tolerance(spark, sf):
    df = lane(spark, sf)
    views = df.where("name = 'view'").groupBy("steamid", "tick").agg(F.max_by("value", "seq").alias("state"))
    return asof.asof_join(df.where("name = 'purchase'"), views, ["steamid"], "tick", ["state"], tolerance=500000).select("seq", "state")


@query(
    """, s AS (SELECT steamid, tick // 64000 AS t, CASE WHEN count(DISTINCT k) = 1 THEN min(k) END AS k FROM lane WHERE name = 'view' GROUP BY ALL)
    SELECT e.seq, CASE WHEN a.t IS NOT NULL THEN a.k ELSE b.k END AS k FROM (SELECT *, tick // 64000 AS t FROM lane WHERE name = 'click') e
    LEFT JOIN s a ON a.steamid = e.steamid AND a.t = e.t LEFT JOIN s b ON b.steamid = e.steamid AND b.t = e.t - 1 -- lane"""
)
def kill_position(spark, sf):
    df = lane(spark, sf).withColumn("t", F.floor(F.col("tick") / 64000).cast("long"))
    return asof.exact_or_before(df.where("name = 'click'").select("seq", "steamid", "t"), df.where("name = 'view'").select("steamid", "t", "k"), ["steamid"], "t", "k").select("seq", "k")


@query(
    """, s AS (SELECT * FROM lane WHERE name = 'view'), h AS (SELECT steamid, arg_min(k, tick) AS k FROM lane WHERE name = 'error' GROUP BY ALL)
    SELECT e.seq, coalesce((SELECT arg_max(s.k, (s.tick, s.seq)) FROM s WHERE s.steamid = e.steamid AND (s.tick < e.tick OR (s.tick = e.tick AND s.seq <= e.seq))), h.k) AS k
    FROM (SELECT * FROM lane WHERE name = 'purchase') e LEFT JOIN h ON h.steamid = e.steamid -- lane"""
)
def side_timeline(spark, sf):
    df = lane(spark, sf)
    left, samples = df.where("name = 'purchase'").select("seq", "steamid", "tick"), df.where("name = 'view'").select("steamid", "tick", "seq", "k")
    hints = df.where("name = 'error'").select("steamid", "tick", F.col("k").alias("hint"))
    return asof.latest_or_first_hint(left, samples, hints, ["steamid"], "tick", "k", "hint", "seq").select("seq", "k")


# windows
@query("SELECT seq, round(CAST(64 * (lag(v, 1) OVER w - lag(v, 2) OVER w) AS DOUBLE), 2) AS vx FROM (SELECT *, round(value * 4) / 4 AS v FROM lane) WINDOW w AS (PARTITION BY steamid ORDER BY tick, seq)")
def velocity_lag_pair(spark, sf):
    df = lane(spark, sf).withColumn("v", F.round(F.col("value") * 4) / 4)
    return win.velocity(df, ["steamid"], ["tick", "seq"], {"vx": "v"}).select("seq", F.round(F.col("vx").cast("double"), 2).alias("vx"))


@query("SELECT seq, coalesce(tick - lag(tick) OVER (PARTITION BY steamid ORDER BY tick, seq), 0) AS gap FROM lane")
def since_last_event(spark, sf):
    return win.since_last(lane(spark, sf), ["steamid"], ["tick", "seq"], "tick", "gap").select("seq", "gap")


@query(
    """, r AS (SELECT *, sum(b) OVER (PARTITION BY steamid ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN name IS NOT DISTINCT FROM lag(name) OVER (PARTITION BY steamid ORDER BY tick, seq) THEN 0 ELSE 1 END AS b FROM lane)),
    n AS (SELECT *, count(*) OVER (PARTITION BY steamid, run) AS len FROM r), p AS (SELECT *, lag(run) OVER w AS pr, lag(len) OVER w AS pl FROM n WINDOW w AS (PARTITION BY steamid ORDER BY tick, seq))
    SELECT seq, CAST(pl AS BIGINT) AS previous_length FROM p WHERE run <> pr AND pl >= 2 -- lane"""
)
def run_switch(spark, sf):
    return win.switches(lane(spark, sf), ["steamid"], ["tick", "seq"], "name", 2).select("seq", "previous_length")


@query(
    """, w AS (SELECT seq, value > 50 AS up, coalesce(lag(value > 50) OVER o, false) AS before, count(*) OVER f AS n, min(k % 2) OVER f AS lo, max(k % 2) OVER f AS hi, max((name = 'error')::INT) OVER f AS err
    FROM lane WINDOW o AS (PARTITION BY steamid ORDER BY tick, seq), f AS (PARTITION BY steamid ORDER BY tick, seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT seq FROM w WHERE up AND NOT before AND n = 3 AND lo = hi AND err = 0 -- lane"""
)
def lookahead_frame(spark, sf):
    df = lane(spark, sf).withColumn("weapon", F.col("k") % 2)
    return win.steady_ahead(df, ["steamid"], ["tick", "seq"], F.col("value") > 50, "weapon", F.col("name") == "error", 3).select("seq")


@query(
    """, m AS (SELECT seq, steamid, row_number() OVER w - 1 AS i, abs(q - lag(q) OVER w) >= 0.01 AS moved FROM (SELECT *, k // 30 AS q FROM lane) WINDOW w AS (PARTITION BY steamid ORDER BY tick, seq)),
    x AS (SELECT *, max(i) FILTER (moved) OVER (PARTITION BY steamid) AS l, count(*) OVER (PARTITION BY steamid) AS n FROM m) SELECT seq FROM x WHERE n < 3 OR l IS NULL OR i <= l + 1 -- lane"""
)
def rest_prune(spark, sf):
    df = lane(spark, sf).withColumn("q", F.floor(F.col("k") / 30))
    return win.rest_pruned(df, ["steamid"], ["tick", "seq"], ["q"]).select("seq")


@query("SELECT seq, steamid FROM lane QUALIFY row_number() OVER (PARTITION BY steamid ORDER BY tick, seq) = 1")
def first_connect(spark, sf):
    return win.first_per_key(lane(spark, sf), ["steamid"], ["tick", "seq"]).select("seq", "steamid")


@query(
    """, g AS (SELECT *, sum((name = 'signup')::INT) OVER (PARTITION BY steamid ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS life FROM lane),
    e AS (SELECT *, max(CASE WHEN name = 'error' THEN tick + k * 6400 END) OVER (PARTITION BY steamid, life ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS until FROM g)
    SELECT seq, CASE WHEN until IS NOT NULL THEN greatest(0.0::DOUBLE, (until - tick) / 64) END AS remaining FROM e -- lane"""
)
def flash_state(spark, sf):
    ends = F.when(F.col("name") == "error", F.col("tick") + F.col("k") * 6400)
    return win.state_until_reset(lane(spark, sf), ["steamid"], ["tick", "seq"], F.col("name") == "signup", ends, "tick", "remaining").select("seq", "remaining")


@query("SELECT seq FROM lane WINDOW w AS (PARTITION BY steamid ORDER BY tick, seq) QUALIFY name IS DISTINCT FROM lag(name) OVER w OR row_number() OVER w = 1")
def sparse_states(spark, sf):
    return win.changes_only(lane(spark, sf), ["steamid"], ["tick", "seq"], ["name"]).select("seq")


@query("SELECT seq, least(abs(a - p), 360 - abs(a - p)) AS turn FROM (SELECT seq, a, coalesce(lag(a) OVER (PARTITION BY steamid ORDER BY tick, seq), a) AS p FROM (SELECT *, CAST(k * 37 % 360 AS DOUBLE) AS a FROM lane))")
def mouse_turn(spark, sf):
    df = lane(spark, sf).withColumn("yaw", (F.col("k") * 37 % 360).cast("double"))
    return win.wrapped_turn(df, ["steamid"], ["tick", "seq"], "yaw", "turn").select("seq", "turn")


@query("SELECT seq FROM lane WINDOW w AS (PARTITION BY steamid ORDER BY tick, seq) QUALIFY name = 'click' AND lead(name) OVER w = 'view' AND lead(name, 2) OVER w = 'purchase'")
def purchase_triples(spark, sf):
    return win.triples(lane(spark, sf), ["steamid"], ["tick", "seq"], "name", ["click", "view", "purchase"], "k").select("seq")


ROUNDS = """, e AS (SELECT steamid, tick AS end_tick, seq, lag(tick) OVER (PARTITION BY steamid ORDER BY tick, seq) AS prev FROM lane WHERE name = 'purchase'),
b AS (SELECT e.*, coalesce((SELECT max(s.tick) FROM lane s WHERE s.steamid = e.steamid AND s.name = 'signup' AND s.tick > coalesce(e.prev, -1) AND s.tick <= e.end_tick), e.prev + 1, 0) AS start_tick,
    (SELECT min(s.tick) FROM lane s WHERE s.steamid = e.steamid AND s.name = 'signup' AND s.tick > e.end_tick) AS next_start FROM e),
z AS (SELECT b.*, coalesce((SELECT max(f.tick) FROM lane f WHERE f.steamid = b.steamid AND f.name = 'error' AND f.tick >= b.start_tick AND f.tick <= b.end_tick), b.start_tick) AS freeze_tick FROM b WHERE start_tick < end_tick),
rounds AS (SELECT steamid, CAST(row_number() OVER (PARTITION BY steamid ORDER BY end_tick, seq) AS INTEGER) AS round, start_tick, freeze_tick, end_tick, next_start FROM z)
"""


def _rounds(df: DataFrame) -> DataFrame:
    n = F.col("name")
    return win.rounds(df, ["steamid"], ["tick", "seq"], "tick", n == "signup", n == "error", n == "purchase")


@query(ROUNDS + "SELECT steamid, round, start_tick, freeze_tick, end_tick FROM rounds -- lane")
def rounds_build(spark, sf):
    return _rounds(lane(spark, sf)).drop("next_start")


@query(ROUNDS + "SELECT * FROM rounds -- lane")
def next_round_start(spark, sf):
    return _rounds(lane(spark, sf))


@query(
    ROUNDS
    + """, c AS (SELECT l.seq, l.tick, r.*, row_number() OVER (PARTITION BY l.seq ORDER BY r.round) AS n FROM lane l LEFT JOIN rounds r ON l.steamid = r.steamid AND l.tick BETWEEN r.start_tick AND r.end_tick WHERE l.name IN ('click', 'view'))
    SELECT seq, coalesce(round, 1) AS round, coalesce(start_tick, tick) AS start_tick, coalesce(end_tick, tick + 1000) AS end_tick, CASE WHEN round IS NULL THEN tick + 450 ELSE freeze_tick END AS freeze_tick FROM c WHERE n = 1 -- lane"""
)
def event_round_interval(spark, sf):
    df = lane(spark, sf)
    return joins.in_round(df.where(F.col("name").isin("click", "view")), _rounds(df), ["steamid"], "tick", "seq").select("seq", "round", "start_tick", "end_tick", "freeze_tick")


@query("SELECT seq, next_view FROM (SELECT l.seq, l.name, (SELECT min(v.tick) FROM lane v WHERE v.steamid = l.steamid AND v.name = 'view' AND v.tick > l.tick) AS next_view FROM lane l) WHERE name = 'click'")
def next_after(spark, sf):
    return win.first_after(lane(spark, sf), ["steamid"], "tick", {"next_view": F.col("name") == "view"}).where("name = 'click'").select("seq", "next_view")


@query(
    "SELECT seq, coalesce(sell < buy, false) AS was_sold FROM (SELECT l.seq, (SELECT min(v.tick) FROM lane v WHERE v.steamid = l.steamid AND v.name = 'error' AND v.tick > l.tick) AS sell, (SELECT min(v.tick) FROM lane v WHERE v.steamid = l.steamid AND v.name = 'purchase' AND v.tick > l.tick) AS buy FROM lane l WHERE l.name = 'purchase')"
)
def was_sold(spark, sf):
    n = F.col("name")
    return win.was_sold(lane(spark, sf), ["steamid"], "tick", n == "purchase", n == "error").select("seq", "was_sold")


# shots and hits
WIDTH = 200_000
HITS = f""", p AS (SELECT s.steamid, s.seq, s.tick, h.seq AS r_seq, h.tick AS r_tick, row_number() OVER (PARTITION BY h.seq ORDER BY s.seq) AS n
FROM (SELECT * FROM lane WHERE name = 'click') s JOIN (SELECT * FROM lane WHERE name = 'view') h ON s.steamid = h.steamid AND h.tick >= s.tick AND h.tick < s.tick + {WIDTH}), hits AS (SELECT * FROM p WHERE n = 1)
"""


def _hits(df: DataFrame) -> DataFrame:
    return joins.greedy_hits(df.where("name = 'click'"), df.where("name = 'view'"), ["steamid"], "tick", "seq", WIDTH)


@query(HITS + "SELECT seq, r_seq, r_tick FROM hits -- lane")
def greedy_window_hits(spark, sf):
    return _hits(lane(spark, sf)).select("seq", "r_seq", "r_tick")


@query(
    HITS
    + """, e AS (SELECT s.steamid, s.seq, count(h.seq) AS n_hits FROM (SELECT * FROM lane WHERE name = 'click') s LEFT JOIN hits h ON h.seq = s.seq AND h.steamid = s.steamid GROUP BY ALL)
    SELECT steamid, count(*) AS shots, sum((n_hits > 0)::INT)::BIGINT AS hits, sum((n_hits = 0)::INT)::BIGINT AS misses, round(avg((n_hits > 0)::INT), 6) AS hit_rate FROM e GROUP BY steamid -- lane"""
)
def hit_rate(spark, sf):
    df = lane(spark, sf)
    shots = joins.shots_with_hits(df.where("name = 'click'"), _hits(df), ["steamid"], "tick", "seq")
    return joins.hit_rates(shots, ["steamid"]).withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"SELECT seq FROM lane e WHERE name = 'error' AND EXISTS (SELECT 1 FROM lane s WHERE s.name = 'click' AND s.steamid = e.steamid AND e.tick BETWEEN s.tick AND s.tick + {WIDTH})")
def orphan_semi(spark, sf):
    df = lane(spark, sf)
    return joins.orphans(df.where("name = 'error'"), df.where("name = 'click'"), ["steamid"], "tick", WIDTH).select("seq")


# groups
@query(
    """, x AS (SELECT steamid, tick // 5529600 AS day, tick // 230400 AS hour, k % 7 AS victim FROM lane WHERE name IN ('view', 'click')), h AS (SELECT *, count(*) OVER (PARTITION BY steamid, day, hour) AS same FROM x),
    g AS (SELECT steamid, day, count(*) AS n, count(DISTINCT victim) AS v, max(same) AS most FROM h GROUP BY ALL), t AS (SELECT steamid, day, n AS n_kills, CASE WHEN most >= 3 THEN 'MULTI' WHEN n = 5 AND v = 5 THEN 'ACE' WHEN n = 4 AND v = 4 THEN 'QUAD' WHEN n = 3 THEN 'TRIPLE' WHEN n = 2 AND v = 2 THEN 'DOUBLE' WHEN n = 1 THEN 'SINGLE' END AS type FROM g)
    SELECT steamid, day, n_kills, type FROM t WHERE type IS NOT NULL -- lane"""
)
def kill_collections(spark, sf):
    df = lane(spark, sf).where(F.col("name").isin("view", "click"))
    df = df.select("steamid", F.floor(F.col("tick") / 5529600).cast("long").alias("day"), F.floor(F.col("tick") / 230400).cast("long").alias("hour"), (F.col("k") % 7).alias("victim"), F.lit("T").alias("victim_team"), F.col("steamid").alias("killer_name"))
    return kills.collections(df, ["steamid", "day"], "hour", "victim", "killer_name", "victim_team", ["victim"]).select("steamid", "day", "n_kills", "type")


@query(POINTS + ", c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM p GROUP BY label) SELECT p.label, any_value(n) AS n, round(max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))), 4) AS radius FROM p JOIN c ON p.label = c.label GROUP BY p.label")
def radius_centroid(spark, sf):
    return kills.radius(points(spark, sf), ["label"], ["x", "y", "z"]).select("label", "n", F.round("radius", 4).alias("radius"))


@query(POINTS + ", s AS (SELECT label, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2) AS d FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, round(coalesce(sum(d), 0), 4) AS path_length FROM s GROUP BY label")
def path_length(spark, sf):
    return kills.path_length(points(spark, sf), ["label"], ["vec_id"], ["x", "y", "z"]).withColumn("path_length", F.round("path_length", 4))


@query("SELECT steamid, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(name, seq) AS first_name, arg_max(value, seq) AS last_value FROM lane GROUP BY steamid")
def first_last_by_entity(spark, sf):
    return kills.first_last(lane(spark, sf), ["steamid"], "seq", ["name"], ["value"])


@query("SELECT player, zone, sum(kills)::BIGINT AS kills, sum(deaths)::BIGINT AS deaths FROM (SELECT steamid AS player, name AS zone, 1 AS kills, 0 AS deaths FROM lane UNION ALL SELECT k, name, 0, 1 FROM lane) GROUP BY ALL")
def zone_kda(spark, sf):
    return kills.zone_counts(lane(spark, sf).withColumn("victim", F.col("k").cast("long")), "steamid", "victim", "name")


@query("SELECT steamid, max(tick) AS tick, arg_max(value, seq) AS value FROM lane GROUP BY steamid HAVING count(*) > 1")
def scoreboard_last(spark, sf):
    return lane(spark, sf).groupBy("steamid").agg(F.max("tick").alias("tick"), F.max_by("value", "seq").alias("value"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("SELECT tick // 5529600 AS round, count(*) AS kills FROM lane WHERE name = 'purchase' GROUP BY ALL")
def kills_per_round(spark, sf):
    return reports.per_round(lane(spark, sf).where("name = 'purchase'"), F.floor(F.col("tick") / 5529600).cast("long"))


@query("SELECT steamid, k AS victim, max((name = 'error')::INT) AS killed, round(sum(value), 4) AS damage, CAST(row_number() OVER (PARTITION BY steamid ORDER BY max((name = 'error')::INT) DESC, round(sum(value), 4) DESC, k) AS INTEGER) AS rank FROM lane GROUP BY steamid, k")
def victim_ranking(spark, sf):
    df = lane(spark, sf).withColumn("killed", F.col("name") == "error")
    each = df.groupBy("steamid", F.col("k").alias("victim"), "killed").agg(F.sum("value").alias("part"))
    summed = each.groupBy("steamid", "victim").agg(F.max("killed").alias("killed"), F.round(F.sum("part"), 4).alias("damage"))
    return kills.ranked_victims(summed, ["steamid"], "victim", "killed", "damage")


# catalog
@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def map_totals(spark, sf):
    return catalog.group_totals(table(spark, sf, "orders"), "o_orderpriority")


@query("SELECT count(*) AS n, count(DISTINCT o_orderdate) AS demos, count(DISTINCT o_custkey) AS players FROM orders")
def manifest_totals(spark, sf):
    return catalog.totals(table(spark, sf, "orders"), "o_orderdate", "o_custkey")


@query(
    """WITH o AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber) AS w FROM lineitem GROUP BY ALL), u AS (SELECT unnest(w) AS weapon FROM o)
    SELECT weapon, n, coalesce(exclusive, 0) AS exclusive FROM (SELECT weapon, count(*) AS n FROM u GROUP BY ALL) LEFT JOIN (SELECT w[1] AS weapon, count(*) AS exclusive FROM o WHERE len(list_distinct(w)) = 1 GROUP BY ALL) USING (weapon)"""
)
def weapon_totals(spark, sf):
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), ";").alias("weapons"))
    return catalog.weapon_totals(orders, "weapons")


@query("SELECT l_linestatus AS folder, count(DISTINCT l_suppkey) AS demos, sum((l_returnflag = 'A')::INT)::BIGINT AS enabled, count(*) AS n FROM lineitem GROUP BY ALL")
def folder_stats(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("folder"), F.col("l_suppkey").alias("demo_name"), (F.col("l_returnflag") == "A").alias("enabled"))
    return catalog.folder_stats(df)


@query("SELECT label, round(median(x), 6) AS altitude, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (" + POINTS.replace("WITH p AS (", "").rstrip()[:-1] + ") GROUP BY label")
def median_altitude(spark, sf):
    return reports.altitude(points(spark, sf), ["label"], "x").select("label", *[F.round(c, 6).alias(c) for c in ("altitude", "low", "high")])


@query("SELECT name, count(*) AS n, sum(k)::BIGINT AS bytes, min(tick) AS first_tick, max(tick) AS last_tick FROM lane GROUP BY name")
def census(spark, sf):
    frames = lane(spark, sf).select(F.lit("log").alias("file"), F.col("name").alias("kind"), "tick", F.col("k").alias("size"))
    return replaylog.census(frames).select(F.col("kind").alias("name"), "n", "bytes", "first_tick", "last_tick")


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY lower(s_name) DESC, s_suppkey) AS INTEGER) AS place FROM supplier")
def sort_15(spark, sf):
    return catalog.sort(table(spark, sf, "supplier"), "s_name", ["s_suppkey"], rank="place").select("s_suppkey", "place")


@query(
    """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'late' END AS tag, o_totalprice + 1 AS price FROM orders WHERE o_orderstatus = 'F'),
    o AS (SELECT o_orderkey, o_orderpriority AS tag, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F' OR o_orderdate < DATE '2000-01-01')
    SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL OR n.tag = '' THEN o.tag ELSE n.tag END AS tag, round(coalesce(n.price, o.price), 2) AS price FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""
)
def catalog_merge(spark, sf):
    """Every order: finished ones are new, and old too if placed before 2000; all others are old."""
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderstatus <> 'F' OR o_orderdate < DATE '2000-01-01'").select("o_orderkey", F.col("o_orderpriority").alias("tag"), F.col("o_totalprice").alias("price"))
    new = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("late").alias("tag"), (F.col("o_totalprice") + 1).alias("price"))
    return catalog.merge(old, new, ["o_orderkey"]).withColumn("price", F.round("price", 2))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def missing_assets(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing(table(spark, sf, "orders"), big, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def enable_found(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.tick_data_enabled(table(spark, sf, "orders").select("o_orderkey"), big, ["o_orderkey"]).where("tick_data = 1").select("o_orderkey")


@query("SELECT o.o_orderkey, o.o_custkey, l.l_linenumber, c.c_name FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F'")
def clip_asset_source(spark, sf):
    collections = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("demo_name"), F.col("o_orderkey").alias("collection_num"))
    assets = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("collection_num"), "l_linenumber").join(collections, "collection_num")
    sources = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("demo_name"), "c_name")
    return catalog.clips(collections, assets, sources).select(F.col("collection_num").alias("o_orderkey"), F.col("demo_name").alias("o_custkey"), "l_linenumber", "c_name")


@query("SELECT DISTINCT steamid, name FROM lane")
def union_dedupe(spark, sf):
    df = lane(spark, sf).select("steamid", "name")
    return df.unionByName(df).dropDuplicates()


@query("SELECT steamid, name FROM lane EXCEPT ALL SELECT steamid, name FROM lane WHERE k > 50")
def except_all(spark, sf):
    df = lane(spark, sf)
    return df.select("steamid", "name").exceptAll(df.where("k > 50").select("steamid", "name"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return catalog.unique(table(spark, sf, "part"), ["p_brand"])


@query("SELECT DISTINCT trim(p_brand) AS tag FROM part WHERE trim(p_brand) <> ''")
def distinct_tags(spark, sf):
    return catalog.distinct_tags(table(spark, sf, "part").withColumnRenamed("p_brand", "tag"))


# scalars
@query("SELECT seq, (k & 1) <> 0 AS fire, (k & 2) <> 0 AS jump, (k & 4) <> 0 AS duck, (k & 8) <> 0 AS forward FROM lane")
def button_bits(spark, sf):
    return lane(spark, sf).select("seq", *[sc.button(F.col("k"), b).alias(b.lower()) for b in ("FIRE", "JUMP", "DUCK", "FORWARD")])


@query("SELECT seq, CAST(k * 512 - 16384 + floor(value) AS DOUBLE) AS x FROM lane")
def cell_coord(spark, sf):
    return lane(spark, sf).select("seq", sc.cell_coord(F.col("k"), F.floor("value")).cast("double").alias("x"))


@query(POINTS + "SELECT vec_id, round(sqrt(x*x+y*y+z*z), 4) AS d FROM p")
def distance3d(spark, sf):
    zero = F.lit(0.0)
    return points(spark, sf).select("vec_id", F.round(sc.distance3d(F.col("x"), F.col("y"), F.col("z"), zero, zero, zero), 4).alias("d"))


@query(POINTS + "SELECT vec_id, CASE WHEN x >= 0 THEN round(sqrt(y*y+z*z), 4) END AS distance, CASE WHEN x >= 0 THEN round(x, 4) END AS along FROM p")
def ray_offset(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    off, along = sc.ray_offset((zero, zero, zero), (one, zero, zero), (F.col("x"), F.col("y"), F.col("z")))
    return points(spark, sf).select("vec_id", F.round(off, 4).alias("distance"), F.round(along, 4).alias("along"))


def _case(col: str, names: dict) -> str:
    return f"CASE {' '.join(f'WHEN {col} = {k} THEN {chr(39)}{v}{chr(39)}' for k, v in names.items())} ELSE CAST({col} AS VARCHAR) END"


@query(f"SELECT seq, {_case('(k % 6)', sc.COLORS)} AS color, {_case('(k % 11)', sc.HIT_GROUPS)} AS hit, {_case('(k % 22)', sc.REASONS)} AS reason, {_case('(k % 22)', sc.WINNERS)} AS winner FROM lane")
def name_maps(spark, sf):
    k = F.col("k")
    return lane(spark, sf).select("seq", sc.player_color(k % 6).alias("color"), sc.hit_group(k % 11).alias("hit"), sc.win_reason(k % 22).alias("reason"), sc.winner_of_reason(k % 22).alias("winner"))


@query("SELECT page_id, regexp_replace(lower(list_extract(string_split(url, '/'), -1)), '(\\.dem)?(\\.gz|\\.zst|\\.bz2)?$', '') AS name FROM pages")
def canonical_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.canonical_name(F.col("url")).alias("name"))


@query("SELECT steamid, tick // 5529600 AS day, string_agg(CAST(k AS VARCHAR), ';' ORDER BY tick, seq) AS ks, printf('%.1fs', max(tick) / 64) AS seconds FROM lane GROUP BY steamid, day")
def text_lists(spark, sf):
    """Lists of a user's day: no list grows with the log."""
    listed = F.sort_array(F.collect_list(F.struct("tick", "seq", "k")))
    return lane(spark, sf).groupBy("steamid", F.floor(F.col("tick") / 5529600).cast("long").alias("day")).agg(sc.list_text(F.transform(listed, lambda x: x["k"])).alias("ks"), sc.seconds_text(F.max("tick")).alias("seconds"))


@query("SELECT seq, (CASE WHEN k > 10 THEN 1 ELSE 0 END) + (CASE WHEN k <= 90 THEN 2 ELSE 0 END) AS known, (CASE WHEN k > 50 THEN 1 ELSE 0 END) + (CASE WHEN k <= 90 AND value > 50 THEN 2 ELSE 0 END) AS flags FROM lane")
def three_valued_flags(spark, sf):
    df = lane(spark, sf).withColumns({"a": F.when(F.col("k") > 10, F.col("k") > 50), "b": F.when(F.col("k") <= 90, F.col("value") > 50)})
    return kills.kill_flags(df, ["a", "b"]).select("seq", "known", "flags")


@query("SELECT seq, tick / 64 AS game_time FROM lane")
def game_time(spark, sf):
    return lane(spark, sf).select("seq", sc.game_time(F.col("tick")).alias("game_time"))


@query("SELECT seq, CAST(greatest(-32768, least(32767, round(value * 512))) AS INTEGER) AS q FROM (SELECT seq, round(value) AS value FROM lane)")
def quantise(spark, sf):
    return lane(spark, sf).select("seq", sc.quantised(F.round("value"), 512).alias("q"))


@query(
    """, d AS (SELECT seq, tick // 5529600 AS day, name, steamid % 2 AS side, tick FROM lane WHERE name IN ('purchase', 'error')),
    a AS (SELECT *, sum((side = 0)::INT) OVER w AS dead0, sum((side = 1)::INT) OVER w AS dead1 FROM d WINDOW w AS (PARTITION BY day ORDER BY tick, seq ROWS UNBOUNDED PRECEDING))
    SELECT day, CAST(max(dead0) AS BIGINT) AS dead0, CAST(max(dead1) AS BIGINT) AS dead1, min(seq) FILTER (dead0 = 4 AND dead1 < 4) AS first_clutch FROM a GROUP BY day -- lane"""
)
def clutch_1vx(spark, sf):
    df = lane(spark, sf).where(F.col("name").isin("purchase", "error")).withColumn("day", F.floor(F.col("tick") / 5529600).cast("long"))
    return reports.clutches(df, ["day"], ["tick", "seq"], F.col("steamid") % 2)


# entities and derived rows
@query(
    """, r AS (SELECT * FROM lane QUALIFY row_number() OVER (PARTITION BY steamid, tick // 64000 ORDER BY seq DESC) = 1)
    SELECT steamid, tick // 64000 AS t, CASE WHEN row_number() OVER w = 1 THEN 'spawn' ELSE 'update' END AS op FROM r WINDOW w AS (PARTITION BY steamid ORDER BY tick // 64000)
    QUALIFY row_number() OVER w = 1 OR name IS DISTINCT FROM lag(name) OVER w -- lane"""
)
def entity_deltas(spark, sf):
    df = lane(spark, sf).withColumn("t", F.floor(F.col("tick") / 64000).cast("long"))
    return entities.deltas(df, ["name"], ["steamid"], "t", "seq").select("steamid", "t", "op")


@query(
    """SELECT steamid, min(tick) FILTER (name = 'signup') AS created, max(tick) AS last_tick, arg_max(CASE name WHEN 'purchase' THEN 'leave' WHEN 'error' THEN 'delete' END, tick) FILTER (name IN ('purchase', 'error')) AS ended_by,
    count(*) FILTER (name = 'view') AS updates FROM lane GROUP BY steamid"""
)
def lifetimes(spark, sf):
    n = F.col("name")
    df = lane(spark, sf).withColumn("mark", F.when(n == "signup", "create").when(n == "view", "update").when(n == "purchase", "leave").when(n == "error", "delete"))
    return entities.lifetimes(df.withColumn("mark", F.coalesce("mark", F.lit("none"))), ["steamid"])


@query("SELECT e.seq, s.value AS owner_value FROM (SELECT * FROM lane WHERE name = 'click') e ASOF LEFT JOIN (SELECT steamid, tick, arg_max(value, seq) AS value FROM lane WHERE name = 'view' GROUP BY ALL) s ON e.k = s.steamid AND e.tick >= s.tick")
def handle_deref(spark, sf):
    df = lane(spark, sf)
    target = df.where("name = 'view'").groupBy(F.col("steamid").alias("entity_id"), "tick").agg(F.max_by("value", "seq").alias("value"))
    return entities.dereferenced(df.where("name = 'click'"), "k", target, ["value"], prefix="owner_").select("seq", "owner_value")


@query("SELECT seq FROM lane QUALIFY k = lag(k) OVER (PARTITION BY steamid ORDER BY tick, seq) + 1")
def counter_steps(spark, sf):
    return win.counter_steps(lane(spark, sf), ["steamid"], ["tick", "seq"], "k").select("seq")


@query(
    """, t AS (SELECT steamid % 2 + 2 AS team_num, tick, arg_max(k, seq) AS k FROM lane WHERE name = 'view' GROUP BY ALL)
    SELECT e.seq, a.k AS t_k, b.k AS ct_k FROM (SELECT seq, tick FROM lane WHERE name = 'purchase') e ASOF LEFT JOIN (SELECT * FROM t WHERE team_num = 2) a ON e.tick >= a.tick ASOF LEFT JOIN (SELECT * FROM t WHERE team_num = 3) b ON e.tick >= b.tick -- lane"""
)
def team_pivot(spark, sf):
    df = lane(spark, sf)
    teams = df.where("name = 'view'").groupBy((F.col("steamid") % 2 + 2).alias("team_num"), "tick").agg(F.max_by("k", "seq").alias("k"))
    return entities.team_pivot(df.where("name = 'purchase'").select("seq", "tick"), teams, ["k"]).select("seq", "t_k", "ct_k")


@query(
    """SELECT o_custkey, string_agg(p_name, ';' ORDER BY i) AS inventory FROM (SELECT o_custkey, p_name, min((o_orderkey, l_partkey)) AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    GROUP BY o_custkey"""
)
def inventory(spark, sf):
    """The inventory of every customer. Part keys are no handles: they are taken as they are, however large."""
    lines = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = lines.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "l_partkey"))), lambda x: x["l_partkey"]).alias("handles"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return entities.inventory(held, "handles", items, ["o_custkey"], index=lambda key: key).select("o_custkey", F.array_join("inventory", ";").alias("inventory"))


@query(
    """, a AS (SELECT steamid, 113 + k % 24 AS d, max(seq) AS raw FROM lane GROUP BY ALL UNION ALL SELECT steamid, 278 + k % 12, max(seq) FROM lane GROUP BY ALL),
    s AS (SELECT steamid, CASE WHEN d < 200 THEN (d - 113) // 4 ELSE (d - 278) // 2 END AS slot, CASE WHEN d < 200 THEN (d - 113) % 4 ELSE (d - 278) % 2 + 4 END AS p, raw FROM a)
    SELECT steamid, CAST(slot AS INTEGER) AS slot, max(raw) FILTER (p = 0) AS id, max(raw) FILTER (p = 1) AS wear, max(raw) FILTER (p = 2) AS scale, max(raw) FILTER (p = 3) AS rotation, max(raw) FILTER (p = 4) AS offset_x, max(raw) FILTER (p = 5) AS offset_y
    FROM s GROUP BY steamid, slot HAVING coalesce(max(raw) FILTER (p = 0), 0) <> 0 -- lane"""
)
def stickers(spark, sf):
    df = lane(spark, sf)
    attributes = df.groupBy("steamid", (113 + F.col("k") % 24).alias("def_index")).agg(F.max("seq").alias("raw")).unionByName(df.groupBy("steamid", (278 + F.col("k") % 12).alias("def_index")).agg(F.max("seq").alias("raw")))
    return entities.stickers(attributes, ["steamid"])


@query("SELECT steamid, tick // 5529600 AS day, string_agg(printf('%d:%d', tick, k), ' ' ORDER BY tick, seq) AS points FROM lane WHERE name = 'view' GROUP BY steamid, day")
def trajectories(spark, sf):
    """A user's day stands for an entity's life."""
    df = lane(spark, sf).where("name = 'view'").withColumns({"at": F.struct("tick", "seq"), "day": F.floor(F.col("tick") / 5529600).cast("long")})
    got = kills.trajectories(df, ["steamid", "day"], "at", ["k"])
    return got.select("steamid", "day", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["at"]["tick"].cast("string"), p["k"].cast("string"))), " ").alias("points"))


@query(
    HITS
    + """, e AS (SELECT s.seq, 'weapon_' || (s.k % 5) AS w, count(h.seq) AS n FROM (SELECT * FROM lane WHERE name = 'click') s LEFT JOIN hits h ON h.seq = s.seq GROUP BY ALL)
    SELECT replace(w, 'weapon_', '') AS weapon, count(*) AS shots, sum((n > 0)::INT)::BIGINT AS hits FROM e GROUP BY w -- lane"""
)
def weapon_hits(spark, sf):
    df = lane(spark, sf).withColumn("weapon", F.concat(F.lit("weapon_"), F.col("k") % 5))
    shots = joins.shots_with_hits(df.where("name = 'click'"), _hits(df), ["steamid"], "tick", "seq")
    return kills.weapon_rates(shots)


@query(
    """, d AS (SELECT label, vec_id, vec_id - lag(vec_id) OVER w AS t, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2) AS m FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT label, coalesce(string_agg(CAST(t AS VARCHAR), ';' ORDER BY vec_id), '') AS ticks_between, count(m) AS n FROM d GROUP BY label""".join([POINTS.rstrip(), ""])
)
def collection_gaps(spark, sf):
    """A label's vectors stand for a collection."""
    return kills.gaps_text(points(spark, sf), ["label"], "vec_id", ["x", "y", "z"]).select("label", "ticks_between", "n")


@query(
    """, m AS (SELECT c_custkey & 255 AS m, min(c_name) AS n FROM customer GROUP BY ALL), x AS (SELECT c_custkey, c_name FROM customer)
    SELECT seq, coalesce(m.n, x.c_name) AS user_name FROM lane LEFT JOIN m ON (steamid & 255) = m.m LEFT JOIN x ON steamid = c_custkey -- lane"""
)
def masked_user_join(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("user_name"))
    return joins.by_masked_id(lane(spark, sf), users, "steamid", "c_custkey", ["user_name"]).select("seq", "user_name")


@query(
    """WITH r AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey END AS id, c_name AS who, c_mktsegment AS side FROM customer WHERE c_mktsegment <> 'MACHINERY')
    SELECT o_orderkey, coalesce((SELECT min(side) FROM r WHERE r.id = o_custkey), (SELECT min(side) FROM r WHERE r.who = c_name), 'UNKNOWN') AS side FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def side_fallback(spark, sf):
    """Orders whose customer is listed by id, by name alone (a balance below 0) or not at all (one segment has no side)."""
    customers = table(spark, sf, "customer")
    roster = customers.where("c_mktsegment <> 'MACHINERY'").select(F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("id"), F.col("c_name").alias("who"), F.col("c_mktsegment").alias("side"))
    names = customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("who"))
    df = table(spark, sf, "orders").join(names, "o_custkey", "left").select("o_orderkey", F.col("o_custkey").alias("id"), "who")
    return joins.side_with_fallback(df, roster, "id", "who", "side").select("o_orderkey", "side")


@query("SELECT seq FROM lane QUALIFY value > 50 OR coalesce(lag(value > 50) OVER (PARTITION BY steamid ORDER BY tick, seq), true)")
def dead_collapse(spark, sf):
    return win.collapse_dead(lane(spark, sf).withColumn("alive", F.col("value") > 50), ["steamid"], ["tick", "seq"], "alive").select("seq")


@query(
    """, b AS (SELECT steamid, max(tick) AS t FROM lane WHERE tick < 50000000 GROUP BY steamid) SELECT l.steamid, CAST(50000000 AS BIGINT) AS tick, max(l.seq) AS seq FROM lane l JOIN b ON b.steamid = l.steamid AND b.t = l.tick GROUP BY l.steamid
    UNION ALL SELECT steamid, tick, seq FROM lane WHERE tick BETWEEN 50000000 AND 90000000 -- lane"""
)
def window_seed(spark, sf):
    return joins.window_seed(lane(spark, sf).select("steamid", "tick", "seq"), ["steamid"], "tick", 50_000_000, 90_000_000)


@query("SELECT p_partkey, '[' || p_brand || ', new]' AS added, CASE WHEN p_size > 20 THEN '[' || p_brand || ']' ELSE '[' || p_brand || ', new]' END AS removed FROM part")
def tag_edits(spark, sf):
    tags = F.concat(F.lit("["), F.col("p_brand"), F.lit("]"))
    df = table(spark, sf, "part").select("p_partkey", "p_size", tags.alias("tag"))
    added = catalog.add_tag(df, F.lit(True), "new")
    removed = catalog.remove_tag(added.withColumn("removed", F.col("tag")), F.col("p_size") > 20, "new", "removed")
    return removed.select("p_partkey", F.col("tag").alias("added"), "removed")


@query("SELECT s_suppkey FROM supplier WHERE trim(s_name) = '' OR NOT (s_acctbal BETWEEN 0 AND 5000)")
def invalid_rows(spark, sf):
    return catalog.invalid(table(spark, sf, "supplier"), ["s_name"], {"s_acctbal": (0, 5000)}).select("s_suppkey")


@query("SELECT o_custkey AS demo_name, coalesce(max(o_totalprice), 0) AS col_total, max(o_orderkey) AS collection_num FROM orders GROUP BY o_custkey")
def largest_per_demo(spark, sf):
    return catalog.largest_per_demo(table(spark, sf, "orders").select(F.col("o_custkey").alias("demo_name"), F.col("o_totalprice").alias("col_total"), F.col("o_orderkey").alias("collection_num")))


@query("SELECT seq, CAST(row_number() OVER (PARTITION BY steamid ORDER BY CASE WHEN k > 50 THEN 0 ELSE 1 END, tick, seq) AS INTEGER) AS collection_num FROM lane")
def stable_numbers(spark, sf):
    return kills.numbered(lane(spark, sf), ["steamid"], ["tick", "seq"], F.col("k") > 50).select("seq", "collection_num")


@query("SELECT seq FROM lane WHERE name = 'view' AND EXISTS (SELECT 1 FROM lane e WHERE e.name = 'error' AND e.tick // 64000 = lane.tick // 64000)")
def event_ticks_semi(spark, sf):
    df = lane(spark, sf).withColumn("t", F.floor(F.col("tick") / 64000))
    return joins.present(df.where("name = 'view'"), df.where("name = 'error'").select("t").distinct(), ["t"]).select("seq")
