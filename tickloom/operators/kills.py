"""Kills, their groups by killer and round, and the figures of such groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clean_weapon, distance3d

MULTI_ON_ONE_TICK = 3


def kill_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """flags and known: bit masks of boolean columns whose nulls are unknown."""
    known = sum((F.when(F.col(n).isNotNull(), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    flags = sum((F.when(F.col(n), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    return df.withColumns({"flags": flags, "known": known})


def no_warmup(df: DataFrame, flag: str = "is_warmup_period") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def no_team_kills(df: DataFrame, killer: str = "killer_team", victim: str = "victim_team") -> DataFrame:
    return df.where(~F.coalesce(F.col(killer) == F.col(victim), F.lit(False)))


def group_type(n: Column, names: Column, teams: Column, victims: Column, on_tick: Column) -> Column:
    """Type of a group: MULTI before the exact counts; 2, 4 and 5 need distinct victims, 3 does not; others are null."""
    alike = (names == 1) & (teams == 1)
    distinct = victims == n
    return (
        F.when(on_tick >= MULTI_ON_ONE_TICK, "MULTI")
        .when((n == 5) & alike & distinct, "ACE")
        .when((n == 4) & alike & distinct, "QUAD")
        .when((n == 3) & alike, "TRIPLE")
        .when((n == 2) & alike & distinct, "DOUBLE")
        .when(n == 1, "SINGLE")
    )


def collections(kills: DataFrame, group: Sequence[str], tick: str, victim: str, killer_name: str, victim_team: str, values: Sequence[str], bot: str | None = None) -> DataFrame:
    """One row per group with a type: first and last tick, number of kills, the kills in order of tick.

    Two aggregations, per tick and per group, share the group's keys; both combine on the map side.
    """
    per_tick = Window.partitionBy(*group, tick)
    rows = kills.withColumn("__on_tick", F.count("*").over(per_tick))
    kill = F.struct(F.col(tick).alias("tick"), *[F.col(v) for v in values])
    aggs = [
        F.count("*").alias("n_kills"),
        F.min(tick).alias("start_tick"),
        F.max(tick).alias("end_tick"),
        F.count_distinct(killer_name).alias("__names"),
        F.count_distinct(victim_team).alias("__teams"),
        F.count_distinct(victim).alias("__victims"),
        F.max("__on_tick").alias("__most"),
        F.sort_array(F.collect_list(kill)).alias("kills"),
    ]
    if bot:
        aggs.append(F.max(F.coalesce(F.col(bot), F.lit(False))).alias("__bot"))
    found = rows.groupBy(*group).agg(*aggs)
    if bot:
        found = found.where(~F.col("__bot"))
    found = found.withColumn("type", group_type(F.col("n_kills"), F.col("__names"), F.col("__teams"), F.col("__victims"), F.col("__most")))
    return found.where("type is not null").select(*group, "type", "n_kills", "start_tick", "end_tick", "kills")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], known: Column | None = None) -> DataFrame:
    """collection_num in a stable order: rows that had a number before come first."""
    first = [(~F.coalesce(known, F.lit(False))).cast("int")] if known is not None else []
    return df.withColumn("collection_num", F.row_number().over(Window.partitionBy(*keys).orderBy(*first, *order)))


def radius(df: DataFrame, keys: Sequence[str], xyz: Sequence[str]) -> DataFrame:
    """Largest distance to the group's centroid, and the centroid: two aggregations, joined on the key."""
    mid = df.groupBy(*keys).agg(*[F.avg(c).alias(f"c_{c}") for c in xyz], F.count("*").alias("n"))
    far = F.max(distance3d(*[F.col(c) for c in xyz], *[F.col(f"c_{c}") for c in xyz])).alias("radius")
    joined = df.join(mid, list(keys))
    return joined.groupBy(*keys).agg(far, F.first("n").alias("n"), *[F.first(f"c_{c}").alias(f"c_{c}") for c in xyz])


def path_length(df: DataFrame, keys: Sequence[str], order: Sequence[str], xyz: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    step = distance3d(*[F.col(c) for c in xyz], *[F.lag(c).over(w) for c in xyz])
    return df.withColumn("__step", step).groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path_length"))


def gaps_text(df: DataFrame, keys: Sequence[str], tick: str, xyz: Sequence[str], width: int = 4096) -> DataFrame:
    """ticks_between and move_between inside a group, joined by semicolons in order, and n, the gaps whose distance is known.

    Gaps are found in parts of `width` ticks, whose first row looks back to the last row of the part before; no task sorts or lists a whole
    group, only its parts' texts meet in its one row.
    """
    key = [*keys, "__part"]
    rows = df.select(*keys, tick, *xyz, F.floor(F.col(tick) / width).alias("__part"))
    last = rows.groupBy(*key).agg(F.max_by(F.struct(tick, *xyz), tick).alias("__last"))
    before = last.select(*key, F.lag("__last").over(Window.partitionBy(*keys).orderBy("__part")).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
    rows = rows.alias("r").join(before.alias("b"), same, "left").select("r.*", "b.__before")
    w = Window.partitionBy(*key).orderBy(tick)
    rows = rows.withColumn("__old", F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag(F.struct(tick, *xyz)).over(w)))
    moved = distance3d(*[F.col(c) for c in xyz], *[F.col(f"__old.{c}") for c in xyz]).cast("double")
    gap = F.when(F.col("__old").isNotNull(), F.struct(tick, (F.col(tick) - F.col(f"__old.{tick}")).cast("string").alias("__t"), F.format_string("%.6f", moved).alias("__m")))
    parts = rows.select(*key, gap.alias("__gap"), moved.isNotNull().alias("__known")).groupBy(*key).agg(F.sort_array(F.collect_list("__gap")).alias("__l"), F.count_if("__known").alias("__n"))
    joined = lambda of, x: F.array_join(F.transform(of, lambda r: r[x]), ";")
    # a part whose only row is the group's first has no text
    text = F.when(F.size("__l") > 0, F.struct("__part", joined("__l", "__t").alias("__t"), joined("__l", "__m").alias("__m")))
    listed = parts.select(*keys, text.alias("__text"), "__n").groupBy(*keys).agg(F.sort_array(F.collect_list("__text")).alias("__l"), F.sum("__n").alias("n"))
    return listed.select(*keys, joined("__l", "__t").alias("ticks_between"), joined("__l", "__m").alias("move_between"), "n")


def weapon_rates(shots: DataFrame, weapon: str = "weapon") -> DataFrame:
    """Hits per clean weapon name."""
    hit = (F.col("n_hits") > 0).cast("int")
    return shots.groupBy(clean_weapon(F.col(weapon)).alias("weapon")).agg(F.count("*").alias("shots"), F.sum(hit).alias("hits"))


def ranked_victims(df: DataFrame, keys: Sequence[str], victim: str, killed: str, damage: str) -> DataFrame:
    """Victims per key: killed ones first, then by damage, largest first."""
    each = df.groupBy(*keys, victim).agg(F.max(F.col(killed).cast("int")).alias("killed"), F.sum(damage).alias("damage"))
    w = Window.partitionBy(*keys).orderBy(F.desc("killed"), F.desc("damage"), victim)
    return each.withColumn("rank", F.row_number().over(w))


# Filters of collections and kills by one field; all are plain predicates that reach the scan.
def by_field(df: DataFrame, field: str, value) -> DataFrame:
    return df.where(F.col(field) == value)


def by_weapon(df: DataFrame, weapon: str, field: str = "weapons") -> DataFrame:
    return df.where(F.array_contains(field, weapon))


def first_last(df: DataFrame, keys: Sequence[str], order: str, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Per key the first and last value of `order`, the first row's and the last row's values."""
    return df.groupBy(*keys).agg(
        F.min(order).alias(f"first_{order}"),
        F.max(order).alias(f"last_{order}"),
        *[F.min_by(c, order).alias(f"first_{c}") for c in first],
        *[F.max_by(c, order).alias(f"last_{c}") for c in last],
    )


def trajectories(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Per key its points in order. A track is bounded by its entity's life."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[v for v in values]))).alias("points"))


def zone_counts(kills: DataFrame, killer: str, victim: str, zone: str) -> DataFrame:
    """Kills and deaths per player and zone: one pass over a union instead of a full join of two groupings."""
    k = kills.select(F.col(killer).alias("player"), F.col(zone).alias("zone"), F.lit(1).alias("kills"), F.lit(0).alias("deaths"))
    d = kills.select(F.col(victim).alias("player"), F.col(zone).alias("zone"), F.lit(0).alias("kills"), F.lit(1).alias("deaths"))
    return k.unionByName(d).groupBy("player", "zone").agg(F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"))
