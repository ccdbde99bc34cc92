"""Queries that keep a catalog current and look up, filter and name rows of lanes, each with the SQL it must agree with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import entities, joins, kills, replay
from ..operators import windows as win
from . import catalog
from .queries import POINTS, lane, points, query, table


def text_case(column: str, names: dict) -> str:
    """SQL that names a column's numbers; other numbers stay as text."""
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {column}::VARCHAR END"


# the catalog's state
@query("""SELECT o_orderkey AS demo, coalesce(c.mode, o_orderpriority) AS mode, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 0 END, c.n) AS n_items FROM orders LEFT JOIN
    (SELECT l_orderkey, CASE WHEN max(l_linenumber) >= 4 THEN min(l_returnflag) END AS mode, max(l_linenumber) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) c ON l_orderkey = o_orderkey""")
def catalog_updates(spark, sf):
    """Values of change rows replace, or fill only what is null; rows without a change stay."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("demo"), F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderkey") % 3 > 0, 0).alias("n_items"))
    items = table(spark, sf, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("demo"))
    changes = items.agg(F.when(F.max("l_linenumber") >= 4, F.min("l_returnflag")).alias("mode"), F.max("l_linenumber").alias("n_items"))
    return catalog.filled_where_null(catalog.updated(rows, changes, ["demo"], ["mode"]), changes, ["demo"], ["n_items"])


@query("""SELECT o_orderkey AS demo, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'with' ELSE 'without' END AS mode FROM orders
    UNION ALL SELECT o_orderkey, 'older' FROM orders""")
def tick_data_modes(spark, sf):
    """Rows with and without tick data; a table that lacks the column has only rows without."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("demo"))
    found = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("demo"))
    marked = catalog.tick_data_enabled(rows, found, ["demo"])
    modes = [catalog.with_tick_data(marked, m).select("demo", F.lit(m).alias("mode")) for m in ("with", "without")]
    return modes[0].unionByName(modes[1]).unionByName(catalog.with_tick_data(rows, "without").withColumn("mode", F.lit("older")))


DEMOS = "SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 10 < 2 THEN o_orderkey // 10 * 10 ELSE o_orderkey END AS g FROM orders"


def demos(spark, sf) -> DataFrame:
    """k, c, g of each order; some share g, the number in the file's name."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.alias("k"), F.col("o_custkey").alias("c"), F.when(key % 10 < 2, key - key % 10).otherwise(key).alias("g"))


@query(f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({DEMOS})) SELECT '/demos/' || (k % 7) || '/M_' || g || '.dem.gz' AS demo_path, c AS collections
    FROM p WHERE k % 4 <> 0 AND (k % 3 = 0 OR n = 1)""")
def resolved_selection(spark, sf):
    """Filters find their log by path, else by a stem that only one log has."""
    rows = demos(spark, sf).withColumn("demo_path", F.concat(F.lit("/demos/"), F.col("k") % 7, F.lit("/M_"), "g", F.lit(".dem.gz")))
    moved = F.concat(F.lit("old/m_"), "g", F.lit(".dem"))
    filters = rows.where("k % 4 <> 0").select(F.when(F.col("k") % 3 == 0, F.col("demo_path")).otherwise(moved).alias("path"), F.col("c").alias("collections"))
    return catalog.resolved(filters, rows.select("demo_path"))


@query("""SELECT type, count(*) AS n FROM (SELECT NULL AS type FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderstatus FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1""")
def migrated_types(spark, sf):
    """A table of an older version, without types and with keys as text, together with a newer one, counted by type."""
    rows = table(spark, sf, "orders")
    columns = {"demo": "bigint", "type": "string", "version": "int"}
    older = rows.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("demo"))
    newer = rows.where("o_orderkey % 2 = 1").select(F.lit(2).alias("version"), F.col("o_orderkey").alias("demo"), F.col("o_orderstatus").alias("type"))
    return catalog.by_type(catalog.migrated(older, columns).unionByName(catalog.migrated(newer, columns)))


@query("SELECT coalesce(max(CASE WHEN l_linenumber > 1 THEN l_linenumber END), 0) AS version FROM lineitem")
def schema_version(spark, sf):
    return catalog.largest_version(table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("version")))


@query("""SELECT o_custkey AS demo_name, o_orderkey AS collection_num FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""")
def without_current_asset(spark, sf):
    """Collections that have no asset of one format, although they may have others."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("demo_name"), F.col("o_orderkey").alias("collection_num"))
    assets = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("collection_num"), F.col("l_returnflag").alias("format")).join(rows, "collection_num")
    return catalog.without_current_asset(rows, assets, "A")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)")
def changed_assets(spark, sf):
    """Assets that count as complete but are gone or have another size."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("size"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"))
    found = rows.where("o_orderkey % 7 <> 0").select("o_orderkey", (F.col("size") + (F.col("o_orderkey") % 11 == 0).cast("int")).alias("size"))
    return joins.changed_assets(rows, found, ["o_orderkey"], "size").select("o_orderkey")


# filters and look-ups of lanes
KILLS = """WITH kills AS (SELECT *, steamid % 5 AS victim_id, seq % 4 AS killer_team, k % 4 AS victim_team, tick // 1000000 AS round, k % 3 = 0 AS headshot, k % 5 AS penetrated,
    k % 7 = 0 AS blind, k % 11 = 0 AS smoke, k % 13 = 0 AS noscope, 'p' || steamid % 9 AS killer_name, 'p' || seq % 9 AS victim_name FROM (SELECT * FROM lane WHERE name = 'error')) """
#: A filter's field and value, for each field by which kills and collections are chosen.
FILTERS = {
    "killer_id": ("steamid", 7), "victim_id": ("victim_id", 3), "killer_team": ("killer_team", 2), "victim_team": ("victim_team", 3), "round": ("round", 20), "headshot": ("headshot", True),
    "penetrated": ("penetrated", 2), "blind": ("blind", True), "smoke": ("smoke", True), "noscope": ("noscope", True), "killer_name": ("killer_name", "p4"), "victim_name": ("victim_name", "p5"),
}


def kill_rows(spark, sf) -> DataFrame:
    c = F.col
    return lane(spark, sf).where("name = 'error'").withColumns({
        "victim_id": c("steamid") % 5, "killer_team": c("seq") % 4, "victim_team": c("k") % 4, "round": F.floor(c("tick") / 1_000_000), "headshot": c("k") % 3 == 0, "penetrated": c("k") % 5,
        "blind": c("k") % 7 == 0, "smoke": c("k") % 11 == 0, "noscope": c("k") % 13 == 0, "killer_name": F.concat(F.lit("p"), c("steamid") % 9), "victim_name": F.concat(F.lit("p"), c("seq") % 9),
    })


def one_filter(name: str) -> str:
    field, value = FILTERS[name]
    return f"SELECT '{name}' AS filter, seq FROM kills WHERE {field} = " + (f"'{value}'" if isinstance(value, str) else str(value).lower())


# the lane's own WITH comes first, so that of KILLS goes on with it
@query(", " + KILLS.removeprefix("WITH ") + " UNION ALL ".join(one_filter(n) for n in FILTERS) + " -- lane")
def kill_filters(spark, sf):
    """Kills by each field's filter alone."""
    rows = kill_rows(spark, sf)
    return reduce(DataFrame.unionByName, [kills.by_field(rows, *FILTERS[n]).select(F.lit(n).alias("filter"), "seq") for n in FILTERS])


@query(", " + KILLS.removeprefix("WITH ") + "SELECT seq FROM kills WHERE (killer_team <> victim_team OR k IS NULL) AND headshot AND round = 20 -- lane")
def kill_filters_together(spark, sf):
    """Filters one after the other, and no kills within a team."""
    return kills.by_field(kills.by_field(kills.no_team_kills(kill_rows(spark, sf)), "headshot", True), "round", 20).select("seq")


@query("""SELECT o_custkey, o_orderkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey""")
def collections_by_weapon(spark, sf):
    """Collections one of whose kills is with the weapon."""
    weapons = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("weapons"))
    return kills.by_weapon(table(spark, sf, "orders").join(weapons, "o_orderkey"), "R").select("o_custkey", "o_orderkey")


@query(", d AS (SELECT DISTINCT steamid, k, true AS there FROM lane WHERE name = 'error') SELECT seq, coalesce(there, false) AS fatal FROM lane LEFT JOIN d USING (steamid, k) WHERE name <> 'error' -- lane")
def fatal_hits(spark, sf):
    """Hits with a flag: whether the same key died."""
    rows = lane(spark, sf)
    return joins.flagged(rows.where("name <> 'error'"), rows.where("name = 'error'"), ["steamid", "k"], "fatal").select("seq", "fatal")


@query("SELECT seq, max(CASE WHEN name = 'error' THEN tick END) OVER (PARTITION BY steamid ORDER BY tick RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS checkpoint FROM lane")
def checkpoint_before(spark, sf):
    """The latest checkpoint at or before each row; null before the first."""
    rows = lane(spark, sf)
    return joins.nearest_before(rows, rows.where("name = 'error'").select("steamid", "tick"), "tick", ["steamid"]).select("seq", "checkpoint")


@query(""", p AS (SELECT steamid // 3 AS log, steamid, row_number() OVER (PARTITION BY steamid // 3 ORDER BY steamid) - 1 AS slot FROM (SELECT DISTINCT steamid FROM lane))
    SELECT seq, coalesce(string_agg(p.steamid, ',' ORDER BY slot) FILTER (WHERE l.seq % 8 & (1 << slot) <> 0), '') AS spotted FROM lane l JOIN p ON p.log = l.steamid // 3 GROUP BY seq""")
def spotted_by(spark, sf):
    """Ids of the players whose bit of the mask is set, by the log's own slots."""
    rows = lane(spark, sf).withColumn("log", F.floor(F.col("steamid") / 3))
    players = replay.numbered(rows, ["log"])
    slots = players.groupBy("log").agg(F.map_from_entries(F.collect_list(F.struct((F.col("index") + 1).cast("int"), "steamid"))).alias("slots"))
    return rows.join(slots, "log").select("seq", F.array_join(joins.spotted_ids(F.col("seq") % 8, F.col("slots")), ",").alias("spotted"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE m END AS mask FROM orders JOIN (SELECT l_orderkey, bit_or(1::BIGINT << (l_linenumber + l_partkey % 40)::INT) AS m FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey""")
def inventory_masks(spark, sf):
    """Item numbers of each living owner as bits."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_linenumber") + F.col("l_partkey") % 40).alias("items"))
    return table(spark, sf, "orders").join(items, "o_orderkey").select("o_orderkey", joins.inventory_mask(F.col("items"), F.col("o_orderstatus") != "P").alias("mask"))


@query(""", o AS (SELECT steamid % 20 AS e, tick, max(steamid) AS steamid FROM lane WHERE name = 'error' GROUP BY ALL),
    g AS (SELECT seq, tick, seq % 20 AS e FROM lane WHERE name <> 'error' AND k % 2 = 0 AND seq % 10 > 0)
    SELECT seq, steamid AS thrower_steamid, 'p' || steamid AS thrower_name FROM g ASOF JOIN o ON g.e = o.e AND g.tick >= o.tick -- lane""")
def thrown_projectiles(spark, sf):
    """Projectiles with their thrower as of the row; those without one, and other classes, are left out."""
    rows = lane(spark, sf)
    owners = rows.where("name = 'error'").groupBy((F.col("steamid") % 20).alias("entity_id"), "tick").agg(F.max("steamid").alias("steamid")).withColumn("name", F.concat(F.lit("p"), "steamid"))
    handle = F.when(F.col("seq") % 10 == 0, sc.INVALID_HANDLE).otherwise(F.col("seq") % 20 + (5 << sc.HANDLE_BITS))
    thrown = rows.where("name <> 'error' and k is not null").select("seq", "tick", F.when(F.col("k") % 2 == 0, "CSmokeGrenadeProjectile").otherwise("CKnife").alias("class"), handle.alias("owner"))
    return entities.projectiles(thrown, owners).select("seq", "thrower_steamid", "thrower_name")


@query(""", r AS (SELECT steamid, arg_max(k, seq) AS team_num, arg_max('p' || k, seq) AS name FROM (SELECT * REPLACE (k % 4 AS k) FROM lane) WHERE k IN (2, 3) GROUP BY 1)
    SELECT 'players' AS source, steamid, name, team_num FROM r UNION ALL SELECT 'list', c_custkey, c_name, c_nationkey FROM customer -- lane""")
def end_roster(spark, sf):
    """The end-of-match list where there is one, else the players' latest rows in a team."""
    players = lane(spark, sf).select("steamid", F.col("seq").alias("tick"), (F.col("k") % 4).alias("team_num"), F.concat(F.lit("p"), F.col("k") % 4).alias("name"))
    listed = table(spark, sf, "customer").select(F.col("c_custkey").alias("steamid"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team_num"))
    known = entities.roster(listed, players).withColumn("source", F.lit("list"))
    return entities.roster(listed.where("steamid is null"), players).withColumn("source", F.lit("players")).unionByName(known)


@query("SELECT seq, min(CASE WHEN k % 3 > 0 THEN tick END) OVER (PARTITION BY steamid, k % 4) AS start FROM lane")
def earliest_starts(spark, sf):
    rows = lane(spark, sf).select("seq", "steamid", (F.col("k") % 4).alias("life"), F.when(F.col("k") % 3 > 0, F.col("tick")).alias("start"))
    return entities.earliest_start(rows, "start", ["steamid", "life"]).select("seq", "start")


# motion
@query(POINTS + """SELECT vec_id, round(coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0), 6) AS gap
    FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def moved_since_last(spark, sf):
    return win.moved_since_last(points(spark, sf), ["label"], ["vec_id"], ["x", "y", "z"], "gap").select("vec_id", F.round("gap", 6).alias("gap"))


NEAR = ", ".join(f"nullif(lag(v, {k}) OVER w, 0), nullif(lead(v, {k}) OVER w, 0)" for k in (1, 2, 3))


@query(f", r AS (SELECT seq, steamid, CASE WHEN k % 3 > 0 THEN k * 0.5 ELSE 0 END::DOUBLE AS v FROM lane) SELECT seq, round(coalesce(nullif(v, 0), {NEAR}, 0), 2) AS v FROM r WINDOW w AS (PARTITION BY steamid ORDER BY seq) -- lane")
def velocity_near(spark, sf):
    """A row's velocity, or where that is zero its nearest neighbour's, the one before first."""
    rows = lane(spark, sf).withColumn("v", F.when(F.col("k") % 3 > 0, F.col("k") * 0.5).otherwise(0.0).cast("double"))
    return win.velocity_or_near(rows, ["steamid"], ["seq"], "v").select("seq", "v")


LOW, HIGH = (-300.0, -200.0), (250.0, 300.0)
SPAN = 550 * 1.3


@query(POINTS + f"""SELECT vec_id, round((x - (-25 - {SPAN} / 2)) / {SPAN} * 1024, 6) AS radar_x, round(((50 + {SPAN} / 2) - y) / {SPAN} * 1024, 6) AS radar_y,
    round(z + coalesce(CASE WHEN vec_id % 3 = 0 THEN x END, 64 - 18 * coalesce(CASE WHEN vec_id % 5 > 0 THEN y END, 0)), 6) AS eye_z,
    round(cos(radians(x)) * cos(radians(y)), 6) AS dir_x, round(cos(radians(x)) * sin(radians(y)), 6) AS dir_y, round(-sin(radians(x)), 6) AS dir_z FROM p""")
def views_on_radar(spark, sf):
    """Points on the map's picture, the eyes' height, and where one looks."""
    p, c = points(spark, sf), F.col
    x, y = sc.radar(c("x"), c("y"), LOW, HIGH)
    direction = sc.shot_direction(c("x"), c("y"))
    eye = sc.eye_height(c("z"), F.when(c("vec_id") % 3 == 0, c("x")), F.when(c("vec_id") % 5 > 0, c("y")))
    named = {"radar_x": x, "radar_y": y, "eye_z": eye} | dict(zip(("dir_x", "dir_y", "dir_z"), direction))
    return p.select("vec_id", *[F.round(v, 6).alias(n) for n, v in named.items()])


# masks and names
BIT_NAMES = "concat_ws(',', " + ", ".join(f"CASE WHEN seq::BIGINT & {bit} <> 0 THEN '{name}' END" for name, bit in sc.BUTTONS.items()) + ")"


@query(f"""SELECT seq, {BIT_NAMES} AS names, k::BIGINT AS held, (tick % 64) | (k & seq)::BIGINT AS pressed, seq & ~(k::BIGINT) AS released,
    (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN seq % 2 = 0 THEN 2 ELSE 0 END) AS flags, (CASE WHEN k IS NOT NULL THEN 1 ELSE 0 END) + 2 AS known FROM lane""")
def button_masks(spark, sf):
    c = F.col
    held, pressed, released = sc.button_edges(c("k"), c("seq"), c("tick") % 64)
    flags = (c("k") % 3 == 0, c("seq") % 2 == 0)
    names = F.array_join(sc.button_names(c("seq")), ",").alias("names")
    return lane(spark, sf).select("seq", names, held.alias("held"), pressed.alias("pressed"), released.alias("released"), sc.flag_mask(*flags).alias("flags"), sc.known_mask(*flags).alias("known"))


@query(f""", r AS (SELECT seq, name, k % 25 AS n FROM lane) SELECT seq, CASE WHEN seq % 5 = 0 THEN name ELSE {text_case("n", sc.REASONS)} END AS reason, CASE WHEN n = 2 THEN 'T' WHEN n = 3 THEN 'CT' END AS winner,
    CASE n WHEN 2 THEN 'T' WHEN 3 THEN 'CT' ELSE 'UNKNOWN' END AS team, CASE WHEN n - 3 >= 0 THEN n <> 3 END AS observed, {text_case("n", sc.HIT_GROUPS)} AS hit_group FROM r -- lane""")
def round_names(spark, sf):
    """Reasons (a number or a name), winners, teams, flags that may be unknown, and parts that were hit."""
    rows, n = lane(spark, sf).withColumn("n", F.col("k") % 25), F.col("n")
    text = n.cast("string")
    reason = sc.reason_text(F.when(F.col("seq") % 5 == 0, F.col("name")).otherwise(text))
    return rows.select("seq", reason.alias("reason"), sc.winner(text).alias("winner"), sc.team_text(F.concat(F.lit(" "), F.coalesce(text, F.lit("")))).alias("team"), sc.observed_flag(n - 3).alias("observed"), sc.hit_group(n).alias("hit_group"))


@query(f"""SELECT k, 'M_' || g || (CASE WHEN k % 4 = 0 THEN '.txt' ELSE '' END) AS stem, (k % 7)::VARCHAR AS parent, k % 4 > 0 AS is_log, CASE WHEN k % 2 = 0 THEN g::VARCHAR END AS match_id FROM ({DEMOS})""")
def file_names(spark, sf):
    """Stems, folders and match numbers of paths and addresses."""
    rows, c = demos(spark, sf), F.col
    ending = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".dem", ".dem.gz", ".dem.zst")]), (c("k") % 4 + 1).cast("int"))
    path = F.concat(F.lit("C:\\demos\\"), c("k") % 7, F.when(c("k") % 3 == 0, "\\").otherwise("/"), F.lit("M_"), "g", ending)
    url = F.concat(F.lit("https://example.org/match/"), "g", F.when(c("k") % 2 == 0, "/?from=list").otherwise("x"))
    return rows.select("k", sc.stem(path).alias("stem"), sc.parent_folder(path).alias("parent"), sc.is_log_file(path).alias("is_log"), sc.match_id(url).alias("match_id"))
