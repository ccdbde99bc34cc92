"""Queries of items, their looks and names, of events out of changes, and of arrays of lanes, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cosmetics, derived, folds
from ..sources import sinks
from .clip_queries import CHANGES, changes_of
from .queries import lane, query, table

DEFINITIONS = (cosmetics.PAINT, cosmetics.SEED, cosmetics.WEAR, cosmetics.CHARM, *cosmetics.CHARM_PARTS)
#: A user and type stand for an item, its events for attributes.
ATTRIBUTES = f""", a AS (SELECT steamid, name, seq AS slot, [{", ".join(map(str, DEFINITIONS))}][k % {len(DEFINITIONS)} + 1] AS d, CASE WHEN seq % 6 > 0 THEN (k - 5) * 1.5::DOUBLE END AS value, seq % 5 AS raw FROM lane),
    i AS (SELECT DISTINCT steamid, name FROM lane),
    paints AS (SELECT steamid, name, arg_min_null(value, slot) FILTER (d = 6) AS p, arg_min_null(value, slot) FILTER (d = 7) AS s, arg_min_null(value, slot) FILTER (d = 8) AS w FROM a WHERE d <= 8 GROUP BY ALL),
    painted AS (SELECT steamid, name, CASE WHEN p >= 0 THEN floor(p)::BIGINT END AS paint, CASE WHEN s >= 0 THEN floor(s)::BIGINT END AS seed, w::FLOAT AS wear FROM paints),
    names AS (SELECT p_partkey % 100 AS id, min(p_name) AS skin FROM part GROUP BY 1)
"""
ITEM = ["steamid", "name"]


def attributes_of(spark, sf) -> DataFrame:
    c = F.col
    definition = F.element_at(F.array(*map(F.lit, DEFINITIONS)), (c("k") % len(DEFINITIONS) + 1).cast("int"))
    value = F.when(c("seq") % 6 > 0, (c("k") - 5) * 1.5).cast("double")
    return lane(spark, sf).select(*ITEM, c("seq").alias("slot"), definition.alias("def_index"), value.alias("value"), (c("seq") % 5).alias("raw"))


def skin_names(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("id"), F.col("p_name").alias("name"))


@query(ATTRIBUTES + "SELECT i.steamid, i.name, paint, seed, wear, skin FROM i LEFT JOIN painted p ON p.steamid = i.steamid AND p.name = i.name LEFT JOIN names ON id = paint -- lane")
def item_skins(spark, sf):
    """Paint, seed, wear and the paint's name of every item."""
    return cosmetics.skins(lane(spark, sf).select(*ITEM).distinct(), attributes_of(spark, sf), skin_names(spark, sf), ITEM)


CHARM_SQL = ", ".join(f"arg_min_null(raw, slot) FILTER (d = {d}) AS c{d}" for d in DEFINITIONS[3:])
KNOWN_SQL = " + ".join(f"(c{d} IS NOT NULL)::INT * {1 << i}" for i, d in enumerate(cosmetics.CHARM_PARTS))
PARTS_SQL = "concat_ws(',', " + ", ".join(f"coalesce(c{d}, 0)" for d in cosmetics.CHARM_PARTS) + ")"


@query(ATTRIBUTES + f", g AS (SELECT steamid, name, {CHARM_SQL} FROM a WHERE d >= 299 GROUP BY ALL) SELECT steamid, name, c299 AS charm, {KNOWN_SQL} AS known, {PARTS_SQL} AS parts FROM g WHERE c299 <> 0 -- lane")
def item_charms(spark, sf):
    got = cosmetics.charms(attributes_of(spark, sf), ITEM)
    return got.select(*ITEM, "charm", "known", F.array_join("parts", ",").alias("parts"))


@query(
    """, h AS (SELECT steamid, tick, max(k) AS agent FROM lane WHERE name = 'error' GROUP BY ALL), n AS (SELECT p_partkey % 100 AS id, min(p_name) AS agent_name FROM part GROUP BY 1)
    SELECT l.seq, n.agent_name AS agent FROM lane l ASOF LEFT JOIN h ON h.steamid = l.steamid AND l.tick >= h.tick LEFT JOIN n ON n.id = h.agent WHERE l.name <> 'error' -- lane"""
)
def agent_names(spark, sf):
    """The agent's name of each player as of the row."""
    rows = lane(spark, sf)
    held = rows.where("name = 'error'").groupBy("steamid", "tick").agg(F.max("k").alias("agent_id"))
    return cosmetics.agents(rows.where("name <> 'error'"), held, skin_names(spark, sf), ["steamid"]).select("seq", "agent")


@query("SELECT seq, CASE k WHEN 7 THEN 'ak47' WHEN 9 THEN 'awp' WHEN 40 THEN 'ssg08' END AS weapon FROM lane")
def weapons_by_dictionary(spark, sf):
    return derived.weapon_names(lane(spark, sf), "k", {7: "ak47", 9: "awp", 40: "ssg08"}).select("seq", "weapon")


# events out of changes, each kind alone
@query(CHANGES + "SELECT seq, name, detail FROM x WHERE name LIKE 'round_%' OR name = 'cs_win_panel_match' -- lane")
def round_event_rows(spark, sf):
    return derived.round_events(changes_of(spark, sf)).select("seq", "name", F.col("fields")["round"].alias("detail"))


@query(CHANGES + "SELECT seq, name, detail FROM x WHERE name LIKE 'item_%' -- lane")
def purchase_rows(spark, sf):
    """Purchases with definition, cost and handle, and sales."""
    return derived.purchases(changes_of(spark, sf)).select("seq", "name", F.concat_ws("/", "def_index", "cost", "handle").alias("detail"))


@query(CHANGES + "SELECT seq FROM x WHERE name = 'player_first_connect' -- lane")
def first_connect_rows(spark, sf):
    return derived.first_connects(changes_of(spark, sf).where("prop = 'player_name'")).select("seq")


@query("SELECT tick, steamid, k AS team, k - 1 AS oldteam FROM lane WHERE name = 'click'")
def team_change_rows(spark, sf):
    rows, text = lane(spark, sf), lambda c: c.cast("string")
    fields = F.create_map(F.lit("steamid"), text(F.col("steamid")), F.lit("team"), text(F.col("k")), F.lit("oldteam"), text(F.col("k") - 1))
    events = rows.select("tick", F.when(F.col("name") == "click", "player_team").otherwise(F.col("name")).alias("name"), fields.alias("fields"))
    return derived.team_changes(events).select("tick", *[F.col(c).cast("int").alias(c) for c in ("team", "oldteam")], F.col("steamid").cast("long").alias("steamid"))


@query("SELECT tick, steamid, k AS num_wins, CASE WHEN seq % 3 > 0 THEN k % 18 END AS rank_old, k % 17 AS rank_new, k % 17 - CASE WHEN seq % 3 > 0 THEN k % 18 END AS rank_change FROM lane WHERE name = 'signup'")
def rank_update_rows(spark, sf):
    """Ranks before and after; a field that is no number is null."""
    k = F.col("k")
    given = {"steamid": F.col("steamid"), "num_wins": k, "rank_old": F.when(F.col("seq") % 3 > 0, (k % 18).cast("string")).otherwise("none"), "rank_new": k % 17}
    fields = F.create_map(*[x for n, v in given.items() for x in (F.lit(n), v.cast("string"))])
    events = lane(spark, sf).select("tick", F.when(F.col("name") == "signup", "rank_update").otherwise(F.col("name")).alias("name"), fields.alias("fields"))
    got = derived.rank_updates(events)
    return got.withColumn("steamid", F.col("steamid").cast("long"))


@query("SELECT seq, s AS slot FROM lane, range(5) t(s) WHERE seq & (1 << s::INT) <> 0")
def mask_rows(spark, sf):
    """One row per set bit among the first five."""
    return derived.connect_rows(lane(spark, sf), "seq", 5).select("seq", F.col("slot").cast("long").alias("slot"))


# arrays
@query("SELECT steamid, tick, k::BIGINT AS player, max(value) AS value FROM lane WHERE k IS NOT NULL AND value IS NOT NULL GROUP BY ALL")
def dense_round_trip(spark, sf):
    """Grids of ticks and players per clip, written as arrays and read again: the same cells."""
    cells = lane(spark, sf).where("k is not null and value is not null").groupBy("steamid", "tick", F.col("k").cast("long").alias("player")).agg(F.max("value").cast("double").alias("value"))
    return sinks.read_dense(sinks.dense_arrays(cells, ["steamid"], "tick", "player", ["value"]), ["steamid"], ["value"])


@query("SELECT steamid, tick // 5529600 AS day, count(*)::INT AS n, string_agg(seq, ',' ORDER BY seq) AS seq, string_agg(coalesce(k, -1), ',' ORDER BY seq) AS k FROM lane WHERE name = 'click' GROUP BY ALL")
def sparse_arrays(spark, sf):
    """The rows of a sparse lane per user and day as parallel arrays."""
    rows = lane(spark, sf).where("name = 'click'").select("steamid", F.floor(F.col("tick") / 5529600).cast("long").alias("day"), "seq", F.coalesce("k", F.lit(-1)).alias("k"))
    return sinks.csr(rows, ["steamid", "day"], "seq", ["k"]).select("steamid", "day", "n", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("seq", "k")])


# poses
@query(
    """, c AS (SELECT steamid AS life, tick // 60000000 AS t, seq, k, name FROM lane WHERE name IN ('view', 'click', 'error')),
    w AS (SELECT life, t, seq, k % 8 AS place, seq % 256 AS byte FROM c WHERE name = 'view'),
    s AS (SELECT life, t, arg_max(k, seq) FILTER (name = 'error') AS v, arg_max(seq, seq) FILTER (name = 'click') AS top FROM c GROUP BY ALL),
    e AS (SELECT life, t, last_value(v IGNORE NULLS) OVER o AS recipe_version, last_value(top IGNORE NULLS) OVER o AS top FROM s WINDOW o AS (PARTITION BY life ORDER BY t)),
    b AS (SELECT e.life, e.t, place, arg_max(byte, (w.t, w.seq)) AS byte FROM e JOIN w ON w.life = e.life AND w.t <= e.t GROUP BY ALL),
    d AS (SELECT life, t, max(place) AS far FROM b GROUP BY ALL),
    h AS (SELECT d.life, d.t, string_agg(printf('%02X', coalesce(b.byte, 0)), '' ORDER BY p) AS dynamic FROM d JOIN range(8) r(p) ON p <= far LEFT JOIN b ON b.life = d.life AND b.t = d.t AND b.place = p GROUP BY ALL)
    SELECT e.life, e.t AS tick, recipe_version, top::VARCHAR AS topology, dynamic FROM e JOIN h ON h.life = e.life AND h.t = e.t WHERE top IS NOT NULL -- lane"""
)
def pose_recipes(spark, sf):
    """Bytes written one at a time, topologies whole, and a number, as they stand at the end of each tick. Rows of a tick go by seq."""
    c, name = F.col, F.col("name")
    rows = lane(spark, sf).where("name in ('view', 'click', 'error')")
    changes = rows.select(
        c("steamid").alias("life"), F.floor(c("tick") / 60_000_000).alias("tick"), "seq", F.when(name == "view", "dynamic").when(name == "click", "topology").otherwise("recipe_version").alias("field"),
        F.lit(0).alias("slot"), F.when(name == "view", c("k") % 8).alias("place"), F.when(name == "view", c("seq") % 256).when(name == "error", c("k")).alias("number"), F.when(name == "click", c("seq").cast("string").cast("binary")).alias("payload"),
    )
    return folds.recipes(changes).select("life", "tick", F.col("recipe_version").cast("int").alias("recipe_version"), F.decode(F.col("topologies")[0], "UTF-8").alias("topology"), F.hex("dynamic").alias("dynamic"))
