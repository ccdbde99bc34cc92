"""Entities of a log from its change lane: state, lifetimes, handles, inventories, attributes, projectiles.

A change lane has tick, seq, entity_id, serial, prop and value; an entity's identity is (entity_id, serial). State is carried forward per
identity, so all of it is one shuffle on the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import handle_index
from .asof import asof_join

IDENTITY = ("entity_id", "serial")


def wide_state(changes: DataFrame, props: dict[str, str], keys: Sequence[str] = IDENTITY, order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    """One row per change of a wanted prop with the state of all wanted props after it. props: prop → type."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = changes.where(F.col("prop").isin(*props))
    cols = [F.last(F.when(F.col("prop") == p, F.col("value").try_cast(t)), ignorenulls=True).over(w).alias(p) for p, t in props.items()]
    return wanted.select(*keys, *order, *cols)


def per_tick(state: DataFrame, keys: Sequence[str] = IDENTITY, on: str = "tick", order: str = "seq") -> DataFrame:
    """The last state of each tick."""
    w = Window.partitionBy(*keys, on).orderBy(F.desc(order))
    return state.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def deltas(state: DataFrame, values: Sequence[str], keys: Sequence[str] = IDENTITY, on: str = "tick", order: str = "seq") -> DataFrame:
    """One row per tick in which a life's state changed; op is spawn for the first and update for the others."""
    rows = per_tick(state, keys, on, order)
    w = Window.partitionBy(*keys).orderBy(on)
    now = F.struct(*values)
    rows = rows.withColumn("op", F.when(F.row_number().over(w) == 1, "spawn").when(~now.eqNullSafe(F.lag(now).over(w)), "update"))
    return rows.where("op is not null")


def lifetimes(marks: DataFrame, keys: Sequence[str] = IDENTITY, on: str = "tick", mark: str = "mark") -> DataFrame:
    """First and last tick of each life, how it ended (leave, delete or null) and its updates. marks: create, update, leave, delete."""
    ends = F.col(mark).isin("leave", "delete")
    return marks.groupBy(*keys).agg(
        F.min(F.when(F.col(mark) == "create", F.col(on))).alias("created"),
        F.max(on).alias("last_tick"),
        F.max_by(F.when(ends, F.col(mark)), F.when(ends, F.col(on))).alias("ended_by"),
        F.sum((F.col(mark) == "update").cast("int")).alias("updates"),
    )


def earliest_start(df: DataFrame, start: str, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Every row with its life's earliest start."""
    return df.withColumn(start, F.min(start).over(Window.partitionBy(*keys)))


def dereferenced(df: DataFrame, handle: str, target: DataFrame, values: Sequence[str], prefix: str = "", on: str = "tick", tie: str | None = None) -> DataFrame:
    """df with values of the entity that a handle points to, as of the row; null for the invalid handle.

    target: entity_id, on, values. Used for pawn → weapon, pawn → controller, grenade → owner.
    """
    rows = df.withColumn("__e", handle_index(F.col(handle)).cast("long"))
    right = target.select(F.col("entity_id").cast("long").alias("__e"), on, *([tie] if tie else []), *values)
    return asof_join(rows, right, ["__e"], on, list(values), tie=tie, prefix=prefix).drop("__e")


def team_pivot(df: DataFrame, teams: DataFrame, values: Sequence[str], on: str = "tick") -> DataFrame:
    """df with t_ and ct_ columns: the two teams' state as of the row. teams: team_num (2, 3), on, values; its rows are few."""
    out = df
    for num, prefix in ((2, "t_"), (3, "ct_")):
        side = teams.where(F.col("team_num") == num).withColumn("__g", F.lit(num))
        # the key is salted away: both teams' rows go to each salt, and the left side is spread over them
        left = out.withColumn("__g", F.lit(num)).withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
        right = side.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        out = asof_join(left, right, ["__g", "__salt"], on, list(values), prefix=prefix).drop("__g", "__salt")
    return out


def inventory(df: DataFrame, handles: str, items: DataFrame, keys: Sequence[str], index: Callable[[Column], Column] = handle_index) -> DataFrame:
    """Distinct item names per row of keys, in the handles' order. items: entity_id, name. index: entity number of a handle."""
    each = df.select(*keys, F.posexplode(handles).alias("__i", "__h")).withColumn("entity_id", index(F.col("__h")).cast("long"))
    named = each.join(items.select(F.col("entity_id").cast("long").alias("entity_id"), "name"), "entity_id")
    first = named.groupBy(*keys, "name").agg(F.min("__i").alias("__i"))
    lists = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "name"))), lambda x: x["name"]).alias("inventory"))
    return df.join(lists, list(keys), "left").withColumn("inventory", F.coalesce("inventory", F.array().cast("array<string>")))


def stickers(attributes: DataFrame, keys: Sequence[str] = IDENTITY, slots: int = 6) -> DataFrame:
    """One row per sticker: slot, id, wear, scale, rotation, offset_x, offset_y. attributes: def_index, raw (bits of a 32-bit value).

    Definitions 113 + 4s hold id, wear, scale and rotation of slot s, 278 + 2s the offsets; slots without an id have no row.
    """
    d = F.col("def_index")
    main, offs = d.between(113, 112 + 4 * slots), d.between(278, 277 + 2 * slots)
    rows = attributes.where(main | offs).withColumn("slot", F.when(main, F.floor((d - 113) / 4)).otherwise(F.floor((d - 278) / 2)).cast("int"))
    part = F.when(main, (d - 113) % 4).otherwise((d - 278) % 2 + 4)
    names = ("id", "wear", "scale", "rotation", "offset_x", "offset_y")
    out = rows.withColumn("__p", part).groupBy(*keys, "slot").agg(*[F.max(F.when(F.col("__p") == i, F.col("raw"))).alias(n) for i, n in enumerate(names)])
    return out.where("coalesce(id, 0) <> 0")


def projectiles(df: DataFrame, owners: DataFrame, every: bool = False) -> DataFrame:
    """Projectile rows with their thrower; rows without one are left out. every: also classes that are no projectiles."""
    rows = df if every else df.where(F.col("class").contains("Projectile"))
    thrown = dereferenced(rows, "owner", owners, ["steamid", "name"], prefix="thrower_")
    return thrown.where("thrower_steamid is not null")


def roster(infos: DataFrame, players: DataFrame) -> DataFrame:
    """The end-of-match list where it has rows, else players of teams 2 and 3 with their latest row."""
    last = players.where(F.col("team_num").isin(2, 3)).groupBy("steamid").agg(F.max_by("name", "tick").alias("name"), F.max_by("team_num", "tick").alias("team_num"))
    listed = infos.select("steamid", "name", "team_num")
    # one row if the list has any, none else: the players stay only where it is missing
    there = listed.limit(1).select(F.lit(True).alias("__there"))
    return listed.unionByName(last.withColumn("__there", F.lit(True)).join(F.broadcast(there), "__there", "left_anti").select(*listed.columns))
