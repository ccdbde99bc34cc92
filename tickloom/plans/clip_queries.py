"""Queries of windows, intervals, parts and dispatch over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, derived, folds, intervals
from ..operators import clips as cl
from ..query import LogQuery, Predicate
from ..session import Engine
from ..sources import parts
from ..streaming import buffer
from . import repair
from .queries import lane, query, table

#: Orders as clips of users' events: 2 to 8 hundred thousand ticks each.
CLIPS = """, clips AS (
    SELECT o_orderkey AS clip_id, o_custkey % 150 AS steamid, (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 69119 + o_orderkey * 7919) % 160000000 AS start,
           (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 69119 + o_orderkey * 7919) % 160000000 + 200000 + (o_orderkey % 7) * 100000 AS "end" FROM orders
)
"""
WIDTH = 500_000


def clips_of(spark, sf) -> DataFrame:
    start = (F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01")) * 69119 + F.col("o_orderkey") * 7919) % 160_000_000
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"), (F.col("o_custkey") % 150).alias("steamid"), start.alias("start"))
    return o.withColumn("end", F.col("start") + 200_000 + (F.col("clip_id") % 7) * 100_000)


# windows
@query(CLIPS + "SELECT clip_id, seq, value FROM clips JOIN lane ON lane.steamid = clips.steamid AND tick BETWEEN start AND \"end\" -- lane")
def clip_ticks(spark, sf):
    return cl.in_clips(lane(spark, sf), clips_of(spark, sf), ["steamid"], "tick", WIDTH, salts=4).select("clip_id", "seq", "value")


@query(
    CLIPS
    + """SELECT clip_id, start AS tick, arg_max(seq, (tick, seq)) AS seq, name FROM clips JOIN lane ON lane.steamid = clips.steamid AND tick < start
    GROUP BY clip_id, start, name HAVING arg_max(k, (tick, seq)) < 90 -- lane"""
)
def clip_seeds(spark, sf):
    return cl.clip_seeds(lane(spark, sf), clips_of(spark, sf), ["steamid"], ["name"], "tick", tie="seq", ended=F.col("k") >= 90).select("clip_id", "tick", "seq", "name")


@query(
    CLIPS
    + """, inside AS (SELECT clip_id, start, seq, tick, name, tick // 20000000 AS life FROM clips JOIN lane ON lane.steamid = clips.steamid AND tick BETWEEN start AND "end"),
    seeds AS (SELECT clip_id, start, arg_max(seq, (tick, seq)) AS seq, name, arg_max(tick // 20000000, (tick, seq)) AS life FROM clips JOIN lane ON lane.steamid = clips.steamid AND tick < start GROUP BY clip_id, start, name),
    firsts AS (SELECT clip_id, name, min(tick) AS tick, arg_min(life, (tick, -life)) AS life FROM inside GROUP BY ALL)
    SELECT clip_id, tick, seq, false AS seeded FROM inside UNION ALL
    SELECT s.clip_id, s.start, s.seq, true FROM seeds s LEFT JOIN firsts f USING (clip_id, name) WHERE f.tick IS NULL OR (f.tick > s.start AND f.life = s.life) -- lane"""
)
def clip_lane(spark, sf):
    df = lane(spark, sf).withColumn("life", F.floor(F.col("tick") / 20_000_000))
    return cl.clip_lane(df, clips_of(spark, sf), ["steamid"], ["name"], "tick", WIDTH, tie="seq", life="life").select("clip_id", "tick", "seq", "seeded")


@query(
    CLIPS
    + """, l AS (SELECT *, min(CASE WHEN name = 'error' THEN tick END) OVER (PARTITION BY steamid, k // 10) AS over FROM lane)
    SELECT clip_id, count(*) AS n, sum(seq)::BIGINT AS seqs FROM clips JOIN l ON l.steamid = clips.steamid AND tick <= "end" AND (over IS NULL OR over > start) GROUP BY clip_id -- lane"""
)
def clip_history(spark, sf):
    df = lane(spark, sf).withColumn("slot", F.floor(F.col("k") / 10))
    rows = cl.clip_history(df, clips_of(spark, sf), ["steamid"], "tick", keys=["slot"], ended=F.col("name") == "error", salts=2)
    return rows.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(
    CLIPS
    + """SELECT clip_id, name, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS ticks, round(sum(value), 3) AS total, max(k) AS most FROM clips JOIN lane ON lane.steamid = clips.steamid AND tick BETWEEN start AND "end" GROUP BY clip_id, name -- lane"""
)
def clip_records(spark, sf):
    stats = {"total": F.round(F.sum("value"), 3), "most": F.max("k")}
    return cl.clip_records(lane(spark, sf), clips_of(spark, sf), ["steamid"], "name", "tick", WIDTH, stats)


# intervals
LIVES = """, r AS (SELECT *, name <> 'error' AS alive, k // 50 AS agent, lag(name <> 'error') OVER w AS before, lag(k // 50) OVER w AS other FROM lane WINDOW w AS (PARTITION BY steamid ORDER BY tick, seq)),
e AS (SELECT *, alive AND NOT (coalesce(before, false) AND agent IS NOT DISTINCT FROM other) AS starts FROM r),
x AS (SELECT *, lead(tick, 1, 165888000) OVER (PARTITION BY steamid ORDER BY tick, seq) AS stop FROM e WHERE starts OR (coalesce(before, false) AND NOT alive)),
lives AS (SELECT steamid, row_number() OVER (PARTITION BY steamid ORDER BY tick, seq) - 1 AS life, tick AS start, stop AS "end", agent FROM x WHERE starts)
"""
END = 165_888_000


def lives_of(spark, sf) -> DataFrame:
    df = lane(spark, sf).withColumn("agent", F.floor(F.col("k") / 50).cast("int"))
    return intervals.lives(df, ["steamid"], ["tick", "seq"], F.col("name") != "error", ["agent"], F.lit(END).cast("long"))


@query(LIVES + 'SELECT steamid, life, start, "end", agent FROM lives -- lane')
def agent_lives(spark, sf):
    return lives_of(spark, sf)


@query(LIVES + CLIPS + 'SELECT c.clip_id, l.steamid, l.life, greatest(l.start, c.start) AS start, least(l."end", c."end" + 1) AS "end" FROM lives l JOIN clips c ON l.steamid = c.steamid AND l.start <= c."end" AND c.start < l."end" -- lane')
def lives_in_clips(spark, sf):
    windows = clips_of(spark, sf).withColumn("end", F.col("end") + 1)
    return intervals.overlaps(windows, lives_of(spark, sf), ["steamid"], WIDTH, ["life"]).select("clip_id", "steamid", "life", "start", "end")


# late types
@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS late, CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY') THEN c_nationkey END AS some FROM customer")
def late_types(spark, sf):
    """A column that is null only in the first part, typed in the second, of another type in the third, absent in the fourth."""
    c = table(spark, sf, "customer")
    of = lambda name, late: c.where(F.col("c_mktsegment") == name).select("c_custkey", late.alias("late"), F.col("c_nationkey").alias("some"))
    rest = c.where(~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY"))
    return parts.append([of("AUTOMOBILE", F.lit(None).cast("string")).withColumn("some", F.lit(None)), of("BUILDING", F.col("c_acctbal")), of("MACHINERY", F.col("c_name")).drop("some"), rest.select("c_custkey", F.col("c_nationkey").alias("some"))])


TYPED = """, t AS (SELECT seq, k // 25 AS part, tick, name AS prop, CASE seq % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'string' END AS type, CASE WHEN k % 4 > 0 THEN CAST(seq AS VARCHAR) END AS value FROM lane),
f AS (SELECT prop, arg_min(type, (part, tick, seq)) AS own FROM t WHERE value IS NOT NULL GROUP BY prop)
"""


@query(TYPED + "SELECT seq, prop, own AS type, CASE WHEN type = own THEN value END AS value FROM t LEFT JOIN f USING (prop) -- lane")
def first_types(spark, sf):
    kind = F.when(F.col("seq") % 3 == 0, "int").when(F.col("seq") % 3 == 1, "float").otherwise("string")
    rows = lane(spark, sf).select("seq", F.floor(F.col("k") / 25).alias("part"), "tick", F.col("name").alias("prop"), kind.alias("type"), F.when(F.col("k") % 4 > 0, F.col("seq").cast("string")).alias("value"))
    return parts.by_first_type(rows, "part", ["tick", "seq"]).select("seq", "prop", "type", "value")


# events that state implies
CHANGES = """, c AS (SELECT steamid AS file, tick, seq, k % 5 AS player, k % 2 AS slot, CAST(CASE WHEN k < 50 THEN k % 3 ELSE k % 7 END AS VARCHAR) AS value,
    CASE WHEN k < 50 THEN CASE name WHEN 'view' THEN 'round_end_count' WHEN 'click' THEN 'round_start_count' WHEN 'error' THEN 'round_win_reason' WHEN 'purchase' THEN 'rounds_played' ELSE 'match_end_count' END
         WHEN k < 60 THEN 'player_name' ELSE CASE seq % 4 WHEN 0 THEN 'def' WHEN 1 THEN 'cost' WHEN 2 THEN 'handle' ELSE 'count' END END AS prop FROM lane),
r AS (SELECT *, value::INT AS v, lag(value::INT) OVER (PARTITION BY file, prop ORDER BY tick, seq) AS old, last_value(CASE WHEN prop = 'rounds_played' THEN value::INT END IGNORE NULLS) OVER (PARTITION BY file ORDER BY tick, seq) AS played FROM c),
p AS (SELECT *, lead(prop) OVER w AS p1, lead(value) OVER w AS v1, lead(prop, 2) OVER w AS p2, lead(value, 2) OVER w AS v2 FROM c WHERE prop IN ('def', 'cost', 'handle', 'count') WINDOW w AS (PARTITION BY file, player, slot ORDER BY tick, seq)),
x AS (
    SELECT seq, 'round_end' AS name, CAST(old AS VARCHAR) AS detail FROM r WHERE prop = 'round_end_count' AND v = old + 1
    UNION ALL SELECT seq, 'round_start', CAST(coalesce(played, 0) + 1 AS VARCHAR) FROM r WHERE prop = 'round_start_count' AND v = old + 1
    UNION ALL SELECT seq, 'round_officially_ended', NULL FROM r WHERE prop = 'round_start_count' AND v = old + 1 AND coalesce(played, 0) > 0
    UNION ALL SELECT seq, 'cs_win_panel_match', NULL FROM r WHERE prop = 'match_end_count' AND v = old + 1
    UNION ALL SELECT arg_min(seq, (tick, seq)), 'player_first_connect', NULL FROM c WHERE prop = 'player_name' GROUP BY file, player
    UNION ALL SELECT seq, 'item_purchase', concat_ws('/', value, v1, CASE WHEN p2 = 'handle' THEN v2 END) FROM p WHERE prop = 'def' AND p1 = 'cost'
    UNION ALL SELECT seq, 'item_sold', '' FROM p WHERE prop = 'count' AND value = '0'
)
"""


def changes_of(spark, sf) -> DataFrame:
    k, name = F.col("k"), F.col("name")
    rule = F.when(name == "view", "round_end_count").when(name == "click", "round_start_count").when(name == "error", "round_win_reason").when(name == "purchase", "rounds_played").otherwise("match_end_count")
    bought = F.element_at(F.array(*map(F.lit, ("def", "cost", "handle", "count"))), (F.col("seq") % 4 + 1).cast("int"))
    return lane(spark, sf).select(
        F.col("steamid").alias("file"), "tick", "seq", (k % 5).alias("steamid"), (k % 2).alias("slot"), F.when(k < 50, rule).when(k < 60, "player_name").otherwise(bought).alias("prop"), F.when(k < 50, k % 3).otherwise(k % 7).cast("string").alias("value")
    )


@query(CHANGES + "SELECT seq, name, detail FROM x -- lane")
def state_events(spark, sf):
    got, f = derived.state_events(changes_of(spark, sf)), F.col("fields")
    item = F.concat_ws("/", f["def_index"], f["cost"], f["handle"])
    return got.select("seq", "name", F.when(F.col("name").startswith("item_"), item).otherwise(f["round"]).alias("detail"))


@query(
    """, e AS (SELECT seq, steamid, name, k, tick // 20000000 AS packet FROM lane WHERE name <> 'view'), s AS (SELECT seq, steamid, k, tick // 20000000 AS packet FROM lane WHERE name = 'view')
    SELECT e.seq, arg_max(s.k, (s.packet, s.seq)) AS state FROM e LEFT JOIN s ON s.steamid = e.steamid AND (s.packet < e.packet OR (s.packet = e.packet AND (e.name IN ('purchase', 'error') OR s.seq <= e.seq))) GROUP BY e.seq -- lane"""
)
def deferred_events(spark, sf):
    df = lane(spark, sf).withColumn("packet", F.floor(F.col("tick") / 20_000_000)).withColumnRenamed("seq", "place")
    state = df.where("name = 'view'").withColumnRenamed("k", "state")
    got = derived.with_deferred_state(df.where("name <> 'view'"), state, ["steamid"], ["state"], ["purchase", "error"])
    return got.select(F.col("place").alias("seq"), "state")


# repair, buffer, audit, folds, predicates
ASSETS = """WITH own AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
rows AS (SELECT o_orderkey AS k, (o_custkey % 10)::BIGINT AS size, CASE WHEN o_orderpriority LIKE '1%' THEN 'pending' ELSE 'complete' END AS status FROM orders WHERE o_orderpriority NOT LIKE '5%'),
files AS (SELECT l_orderkey AS k, (l_quantity::INT % 10)::BIGINT AS size FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT k, max(size) AS found, count(*) AS n FROM files GROUP BY k),
plan AS (SELECT coalesce(own.k, rows.k, f.k) AS k, CASE WHEN own.k IS NULL AND rows.k IS NULL THEN 'stray' WHEN own.k IS NULL THEN 'delete' WHEN n > 1 THEN 'ambiguous' WHEN rows.k IS NOT NULL AND n = 1 THEN CASE WHEN status = 'complete' AND size = found THEN 'current' ELSE 'fix' END
    WHEN rows.k IS NOT NULL THEN 'delete' WHEN n = 1 THEN 'add' ELSE 'missing' END AS action, size AS recorded, found FROM own FULL JOIN rows USING (k) FULL JOIN f USING (k))
"""


def _assets(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as collections and asset rows, returned items as the files that are there."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))
    rows = o.where("o_orderpriority NOT LIKE '5%'").select("k", (F.col("o_custkey") % 10).alias("size"), F.when(F.col("o_orderpriority").like("1%"), "pending").otherwise("complete").alias("status"))
    files = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity").cast("int") % 10).cast("long").alias("size"))
    return o.where("o_orderstatus <> 'P'").select("k"), rows, files


@query(ASSETS + "SELECT k, action, recorded, found FROM plan")
def repair_plan(spark, sf):
    return repair.reconciled(*_assets(spark, sf), ["k"])


@query(ASSETS + "SELECT k, CASE WHEN action IN ('add', 'fix') THEN found ELSE recorded END AS size, CASE WHEN action IN ('add', 'fix') THEN 'complete' ELSE status END AS status FROM plan LEFT JOIN rows USING (k) WHERE action IN ('add', 'fix') OR (action <> 'delete' AND rows.k IS NOT NULL)")
def repaired_assets(spark, sf):
    own, rows, files = _assets(spark, sf)
    return repair.repaired(rows, repair.reconciled(own, rows, files, ["k"]), files, ["k"])


@query(
    """, p AS (SELECT steamid AS demo, k AS num, max(CASE WHEN name = 'view' THEN 1 ELSE 0 END) AS a, max(CASE WHEN name = 'click' THEN 1 ELSE 0 END) AS b, max(CASE WHEN name = 'view' THEN seq % 90 END) AS total FROM lane WHERE name IN ('view', 'click') GROUP BY ALL)
    SELECT demo, sum(a * b)::BIGINT AS done, coalesce(max(total), count(*))::INTEGER AS total FROM p GROUP BY demo -- lane"""
)
def buffer_completion(spark, sf):
    df = lane(spark, sf).where("name IN ('view', 'click')")
    first = F.col("name") == "view"
    return buffer.completion(df.select(F.col("steamid").alias("demo"), F.col("k").alias("num"), F.when(first, 1).otherwise(2).alias("phase"), F.col("value"), F.when(first, F.col("seq") % 90).alias("total"), F.col("tick").alias("ts")))


MARKED = ", m AS (SELECT steamid, tick, k, value, name AS class, CASE k % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'leave' ELSE 'delete' END AS mark FROM lane)"


@query(
    MARKED
    + """SELECT class, count(*) AS n, sum((mark = 'create')::INT)::BIGINT AS creates, sum((mark = 'update')::INT)::BIGINT AS updates, sum((mark = 'leave')::INT)::BIGINT AS leaves, sum((mark = 'delete')::INT)::BIGINT AS deletes,
    min(tick) AS first_tick, max(tick) AS last_tick, min(value) AS min_value, max(value) AS max_value FROM m GROUP BY class -- lane"""
)
def merged_audit(spark, sf):
    """Partial results per user, merged per class."""
    mark = F.element_at(F.array(*map(F.lit, audit.MARKS)), (F.col("k") % 4 + 1).cast("int"))
    rows = lane(spark, sf).select("steamid", "tick", F.col("k").alias("entity_id"), "value", F.col("name").alias("class"), mark.alias("mark"))
    return audit.merged(audit.partial(rows, ["steamid", "class"], extents=["value"]), ["class"]).drop("entities")


@query(
    """, c AS (SELECT steamid AS life, tick, seq, CASE WHEN name <> 'view' THEN k // 20 END AS counter, octet_length(encode(name)) AS n FROM lane),
    w AS (SELECT life, tick, counter, sum(n) OVER (PARTITION BY life ORDER BY tick, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS size, last_value(counter IGNORE NULLS) OVER (PARTITION BY life ORDER BY tick, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c)
    SELECT life, tick, counter::BIGINT AS counter, size FROM w WHERE counter IS NOT NULL AND counter IS DISTINCT FROM seen -- lane"""
)
def payload_frames(spark, sf):
    df = lane(spark, sf)
    chunks = df.select(F.col("steamid").alias("life"), "tick", "seq", F.when(F.col("name") != "view", F.floor(F.col("k") / 20)).alias("counter"), F.col("name").cast("binary").alias("payload"))
    return folds.frames(chunks).drop("payload")


@query("SELECT tick, steamid, name, value FROM lane WHERE value > k AND k IS NOT NULL")
def predicate_hook(spark, sf):
    """The engine's tick query with columns and a test of the caller's."""
    above = Predicate(["value", "k"], lambda frame: frame["value"] > frame["k"])
    return Engine(spark).from_tables(ticks=lane(spark, sf)).ticks(LogQuery(columns=["value"], predicate=above))
