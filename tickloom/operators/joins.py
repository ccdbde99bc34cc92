"""Interval, window and lookup joins between lanes.

Range joins are bucketed: both sides get the number of a fixed-width bucket of ticks, so that Spark has an equality to
hash on besides the key, and a row meets only rows of its own and the next buckets, not everything of its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof_join


def window_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, width: int, values: Sequence[str], how: str = "inner") -> DataFrame:
    """left rows with the right rows of the same key in [on, on + width): right `values` get the prefix r_.

    A window touches at most two buckets of its width, so a left row is sent to two.
    """
    l = left.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor(F.col(on) / width), F.floor((F.col(on) + width - 1) / width)))))
    r = right.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(on).alias(f"r_{on}"), *[F.col(v).alias(f"r_{v}") for v in values if v != on], F.floor(F.col(on) / width).alias("__rb"))
    cond = (F.col("__b") == F.col("__rb")) & (F.col(f"r_{on}") >= F.col(on)) & (F.col(f"r_{on}") < F.col(on) + width)
    for c in by:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    return l.join(r, cond, how).drop("__b", "__rb", *[f"__{c}" for c in by])


def greedy_hits(shots: DataFrame, hits: DataFrame, by: Sequence[str], on: str, seq: str, width: int) -> DataFrame:
    """Pairs shot ↔ hit: a hit in [shot, shot + width) goes to the earliest shot (in source order) that can have it.

    A shot takes every free hit of its window, so a hit's owner is simply its first eligible shot.
    """
    pairs = window_pairs(shots, hits, by, on, width, [on, seq])
    first = Window.partitionBy(*by, f"r_{seq}").orderBy(seq)
    return pairs.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def greedy_hits_mixed(shots: DataFrame, hits: DataFrame, by: Sequence[str], on: str, seq: str, wide: Column, width: int = 3, wide_width: int = 200) -> DataFrame:
    """As greedy_hits; shots where `wide` is true have the wider window. The owner is the earliest eligible shot of either kind."""
    marked = shots.withColumn("__wide", F.coalesce(wide, F.lit(False)))
    pairs = window_pairs(marked, hits, by, on, wide_width, [on, seq]).where(F.col("__wide") | (F.col(f"r_{on}") < F.col(on) + width))
    first = Window.partitionBy(*by, f"r_{seq}").orderBy(seq)
    return pairs.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__wide")


def shots_with_hits(shots: DataFrame, pairs: DataFrame, by: Sequence[str], on: str, seq: str, kill: str | None = None, damage: str | None = None) -> DataFrame:
    """Every shot with n_hits and impact, null for a miss: the tick of its first victim, killed ones first, then by damage, then in source order.

    kill, damage: columns of pairs; without them the first hit counts.
    """
    rank = [-F.col(c).cast("double") for c in (kill, damage) if c]
    order = F.struct(*rank, F.col(f"r_{on}"), F.col(f"r_{seq}"))
    each = pairs.groupBy(*by, seq).agg(F.count("*").alias("n_hits"), F.min_by(f"r_{on}", order).alias("impact"))
    return shots.join(each, [*by, seq], "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def hit_rates(shots: DataFrame, group: Sequence[str]) -> DataFrame:
    """shots, hits, misses and hit_rate per group of shots_with_hits()."""
    hit = (F.col("n_hits") > 0).cast("int")
    return shots.groupBy(*group).agg(F.count("*").alias("shots"), F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses"), F.avg(hit.cast("double")).alias("hit_rate"))


def orphans(events: DataFrame, shots: DataFrame, by: Sequence[str], on: str, width: int, keep: bool = True) -> DataFrame:
    """Events at most `width` ticks after a shot of the same key (inclusive); keep=False: those that are not."""
    times = shots.select(*by, F.col(on).alias("__shot"))
    # two buckets of the window's width hold every shot that may count
    e = events.withColumn("__b", F.floor(F.col(on) / (width + 1)))
    s = times.withColumn("__b", F.explode(F.array(F.floor(F.col("__shot") / (width + 1)), F.floor(F.col("__shot") / (width + 1)) + 1))).select(*[F.col(c).alias(f"__{c}") for c in by], "__shot", F.col("__b").alias("__sb"))
    cond = (F.col("__b") == F.col("__sb")) & (F.col(on) >= F.col("__shot")) & (F.col(on) <= F.col("__shot") + width)
    for c in by:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    return e.join(s, cond, "left_semi" if keep else "left_anti").drop("__b")


def in_round(df: DataFrame, rounds: DataFrame, by: Sequence[str], on: str, seq: str, length: int = 1000, freeze: int = 450) -> DataFrame:
    """df with round, start_tick, end_tick, freeze_tick of the first round whose closed interval holds `on`.

    Without one: round 1 with [on, on + length] and freeze at on + freeze. Rounds of a key do not overlap but may touch, so the first
    that ends at or after `on` is the only candidate: found by carrying ends down from the last tick, without comparing rows with rounds.
    """
    cols = ["round", "start_tick", "end_tick", "freeze_tick"]
    r = rounds.select(*by, F.col("end_tick").alias(on), F.struct(*cols).alias("__r"))
    both = df.withColumn("__mine", F.lit(True)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(on).desc(), F.col("__mine").isNull().desc(), F.col("__r.round").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__mine")
    ok = F.coalesce(F.col("__r.start_tick") <= F.col(on), F.lit(False))
    default = F.struct(F.lit(1).alias("round"), F.col(on).alias("start_tick"), (F.col(on) + length).alias("end_tick"), (F.col(on) + freeze).alias("freeze_tick"))
    return found.select(*df.columns, *[F.when(ok, F.col(f"__r.{c}")).otherwise(default[c]).alias(c) for c in cols])


def by_masked_id(df: DataFrame, users: DataFrame, key: str, user_key: str, values: Sequence[str], mask: int = 0xFF) -> DataFrame:
    """Looks up users by the masked id and, where that has none, by the exact id. Of several users the one with the smallest id and values counts."""
    least = lambda prefix: [F.min_by(v, F.struct(user_key, *values)).alias(f"{prefix}{v}") for v in values]
    first = users.groupBy(F.col(user_key).bitwiseAND(mask).alias("__m")).agg(*least("__m_"))
    exact = users.groupBy(F.col(user_key).alias("__e")).agg(*least("__e_"))
    both = df.join(first, F.col(key).bitwiseAND(mask) == F.col("__m"), "left").join(exact, F.col(key) == F.col("__e"), "left")
    return both.select(*df.columns, *[F.coalesce(f"__m_{v}", f"__e_{v}").alias(v) for v in values])


def side_with_fallback(df: DataFrame, roster: DataFrame, key: str, name: str, side: str) -> DataFrame:
    """side by key, then by name, else UNKNOWN; of several sides the smallest."""
    a = roster.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(side).alias("__a"))
    b = roster.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__n")).agg(F.min(side).alias("__b"))
    both = df.join(a, F.col(key) == F.col("__k"), "left").join(b, F.col(name) == F.col("__n"), "left")
    return both.select(*df.columns, F.coalesce("__a", "__b", F.lit("UNKNOWN")).alias(side))


def flagged(df: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with a flag: whether other has a row with the same keys."""
    there = other.select(*keys).distinct().withColumn("__there", F.lit(True))
    return df.join(there, list(keys), "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there")


def missing(df: DataFrame, assets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(assets, list(keys), "left_anti")


def present(df: DataFrame, assets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(assets, list(keys), "left_semi")


def changed_assets(listed: DataFrame, found: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Rows marked complete whose size on disk differs or that are not there."""
    f = found.select(*keys, F.col(size).alias("__size"))
    return listed.where("status = 'complete'").join(f, list(keys), "left").where(~F.col(size).eqNullSafe(F.col("__size"))).drop("__size")


def spotted_ids(mask: Column, slots: Column, bits: int = 16) -> Column:
    """Ids of the slots whose bit is set; slots: map from slot number to id; bit i is slot i + 1."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.getbit(mask.cast("long"), i) == 1, F.try_element_at(slots, (i + 1).cast("int"))))
    return F.array_compact(ids)


def inventory_mask(items: Column, alive: Column) -> Column:
    """OR of 1 << id over the distinct items of a living player; 0 when dead."""
    merged = F.aggregate(F.array_distinct(items), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))))
    return F.when(alive, merged).otherwise(F.lit(0).cast("long"))


def window_seed(df: DataFrame, keys: Sequence[str], on: str, start: int, end: int) -> DataFrame:
    """The last state of each key before the window, restamped at its start, and the rows in it."""
    before = df.where(F.col(on) < start).groupBy(*keys).agg(F.max_by(F.struct(*df.columns), on).alias("__r")).select("__r.*").withColumn(on, F.lit(start).cast(df.schema[on].dataType))
    return before.unionByName(df.where(F.col(on).between(start, end)))


def nearest_before(df: DataFrame, points: DataFrame, on: str, by: Sequence[str]) -> DataFrame:
    """df with the greatest point (a checkpoint of the same log, by its keys) at or before `on`; null without one."""
    marks = points.select(*by, on, F.col(on).alias("checkpoint")).distinct()
    return asof_join(df, marks, by, on, ["checkpoint"])
