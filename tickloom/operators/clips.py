"""Many windows of a lane in one plan.

A clip has clip_id, the keys of its log (`by`), and a closed range of ticks [start, end]. All clips are answered by one join: rows meet
clips of their own bucket of ticks; the state before a clip comes from one as-of join over the pairs of clip and key that have such a state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof_join
from .intervals import buckets

CLIP = ("clip_id", "start", "end")


def _salted(lane: DataFrame, clips: DataFrame, salts: int, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Lane rows spread over salts and clips sent to each, for buckets that hold much of the lane."""
    if salts == 1:
        return lane, clips, []
    spread = lane.withColumn("__salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    return spread, clips.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["__salt"]


def in_clips(lane: DataFrame, clips: DataFrame, by: Sequence[str], on: str, width: int, salts: int = 1) -> DataFrame:
    """clip_id and the lane's columns: each row once for every clip that holds it. Clips that end before they start hold nothing.

    width: ticks of a bucket, about a clip's length: a clip is sent to each bucket that it touches. salts: rows of one bucket go to so many tasks.
    """
    rows, wanted, salt = _salted(lane, clips.select(*by, *CLIP), salts, [on, *lane.columns[:2]])
    cut = wanted.withColumn("__b", F.explode(buckets(F.col("start"), F.col("end") + 1, width)))
    keys = [*by, *salt, "__b"]
    there = cut.select(*[F.col(c).alias(f"__c_{c}") for c in keys], "clip_id", F.col("start").alias("__start"), F.col("end").alias("__end"))
    cond = F.col(on).between(F.col("__start"), F.col("__end"))
    for c in keys:
        cond = cond & (F.col(c) == F.col(f"__c_{c}"))
    return rows.withColumn("__b", F.floor(F.col(on) / width)).join(there, cond).select("clip_id", *lane.columns)


def clip_seeds(lane: DataFrame, clips: DataFrame, by: Sequence[str], keys: Sequence[str], on: str, tie: str | None = None, ended: Column | None = None) -> DataFrame:
    """clip_id and the lane's columns: the last row of each key before the clip, restamped at its start.

    Of rows of one tick the one with the largest tie counts. ended: keys whose last row is so are over and have no seed. Pairs of clip and
    key are made where the key has a row before the clip, so there are as many as seeds (before `ended`).
    """
    whole = [*by, *[k for k in keys if k not in by]]
    first = lane.groupBy(*whole).agg(F.min(on).alias("__first"))
    pairs = clips.select(*by, "clip_id", F.col("start").alias(on)).join(first, list(by)).where(F.col("__first") < F.col(on)).drop("__first")
    state = lane.withColumn("__over", F.coalesce(ended, F.lit(False)) if ended is not None else F.lit(False))
    values = [*[c for c in lane.columns if c not in (*whole, on)], "__over"]
    found = asof_join(pairs, state, whole, on, values, tie=tie, strict=True)
    return found.where("NOT __over").select("clip_id", *lane.columns)


def clip_lane(lane: DataFrame, clips: DataFrame, by: Sequence[str], keys: Sequence[str], on: str, width: int, tie: str | None = None, ended: Column | None = None, life: str | None = None, salts: int = 1) -> DataFrame:
    """Rows in each clip and the seeds before it, with `seeded`: what a replay of the clip needs of a lane of states.

    A key that has a row at the clip's very start needs no seed; nor does one whose first row inside is of another life.
    """
    inside = in_clips(lane, clips, by, on, width, salts)
    seeds = clip_seeds(lane, clips, by, keys, on, tie, ended)
    whole = ["clip_id", *by, *[k for k in keys if k not in by]]
    order = F.struct(F.col(on), *[-F.col(life)] if life else [])
    first = inside.groupBy(*whole).agg(F.min(on).alias("__on"), *[F.min_by(life, order).alias("__life")] if life else [])
    held = seeds.join(first, whole, "left")
    stale = F.col("__on") == F.col(on)
    stale = stale | (F.col("__life") != F.col(life)) if life else stale
    kept = held.where(~F.coalesce(stale, F.lit(False))).select("clip_id", *lane.columns, F.lit(True).alias("seeded"))
    return inside.withColumn("seeded", F.lit(False)).unionByName(kept)


def clip_history(lane: DataFrame, clips: DataFrame, by: Sequence[str], on: str, keys: Sequence[str] = (), ended: Column | None = None, salts: int = 1) -> DataFrame:
    """clip_id and the lane's columns: every row at or before the clip's end, for lanes whose earlier rows still matter inside (sounds, fires).

    keys, ended: of lives (a key's rows) that are over at or before the clip's start, by their first row that is `ended`, nothing is kept.
    """
    rows = lane
    whole = [*by, *[k for k in keys if k not in by]]
    if ended is not None:
        rows = rows.withColumn("__over", F.min(F.when(ended, F.col(on))).over(Window.partitionBy(*whole)))
    rows, wanted, salt = _salted(rows, clips.select(*by, *CLIP), salts, [on, *lane.columns[:2]])
    there = wanted.select(*[F.col(c).alias(f"__c_{c}") for c in (*by, *salt)], "clip_id", F.col("start").alias("__start"), F.col("end").alias("__end"))
    cond = (F.col(on) <= F.col("__end")) & (F.col("__start") <= F.col("__end"))
    for c in (*by, *salt):
        cond = cond & (F.col(c) == F.col(f"__c_{c}"))
    if ended is not None:
        cond = cond & (F.col("__over").isNull() | (F.col("__over") > F.col("__start")))
    return rows.join(there, cond).select("clip_id", *lane.columns)


def clip_records(ticks: DataFrame, clips: DataFrame, by: Sequence[str], player: str, on: str, width: int, stats: dict[str, Column], salts: int = 1) -> DataFrame:
    """One row per clip and player: first and last tick, ticks, and the wanted sums and extremes over the clip's rows.

    Task-side partial sums come first, so a clip of any length is a few rows in the shuffle.
    """
    rows = in_clips(ticks, clips, by, on, width, salts)
    return rows.groupBy("clip_id", player).agg(F.min(on).alias("first_tick"), F.max(on).alias("last_tick"), F.count("*").alias("ticks"), *[c.alias(n) for n, c in stats.items()])
