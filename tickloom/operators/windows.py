"""Ordered-state operators: velocity, gaps, runs, look-ahead frames, resting points, rounds, state machines.

Each is one window specification per key where the semantics allow it, so Spark shuffles and sorts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import TICK_RATE


def ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def velocity(df: DataFrame, keys: Sequence[str], order: Sequence[str], axes: dict[str, str]) -> DataFrame:
    """64 times the difference of the two rows before: it lags one row and counts rows, not ticks. First two rows: null."""
    w = ordered(keys, order)
    step = {name: ((F.lag(c, 1).over(w).cast("float") * TICK_RATE) - (F.lag(c, 2).over(w).cast("float") * TICK_RATE)).cast("float") for name, c in axes.items()}
    return df.withColumns(step)


def velocity_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], axes: dict[str, str], ticks: DataFrame, ok: Column | None = None, on: str = "tick") -> DataFrame:
    """velocity() of the rows at the ticks of a frame, as all rows tell it: rows of other ticks count as rows before, those that are not ok (null too) do not and go."""
    every = df if ok is None else df.where(ok)
    return velocity(every, keys, order, axes).join(ticks.select(on).distinct(), on, "left_semi").select(*df.columns, *axes)


def speed(df: DataFrame, x: str, y: str, name: str = "velocity") -> DataFrame:
    return df.withColumn(name, F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))


def velocity_or_near(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, reach: int = 3) -> DataFrame:
    """column where it is not zero, else the nearest neighbour's that is not, two decimals."""
    w = ordered(keys, order)
    near = [F.col(column)] + [f(column, k).over(w) for k in range(1, reach + 1) for f in (F.lag, F.lead)]
    return df.withColumn(column, F.round(F.coalesce(*[F.when(c != 0, c) for c in near], F.lit(0.0)), 2))


def since_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], on: str, name: str) -> DataFrame:
    """on less that of the row before; 0 for the first row."""
    return df.withColumn(name, F.coalesce(F.col(on) - F.lag(on).over(ordered(keys, order)), F.lit(0)))


def moved_since_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], xyz: Sequence[str], name: str) -> DataFrame:
    w = ordered(keys, order)
    gap = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in xyz), F.lit(0.0)))
    return df.withColumn(name, F.coalesce(gap, F.lit(0.0)))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Adds run (number of the run of equal values) and run_length."""
    w = ordered(keys, order)
    change = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("__change", change).withColumn("run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")
    return numbered.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "run")))


def switches(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, least: int = 8) -> DataFrame:
    """Rows where a new run begins and the run before had `least` rows or more."""
    numbered = runs(df, keys, order, column)
    w = ordered(keys, order)
    first = F.coalesce(F.col("run") != F.lag("run").over(w), F.lit(False))
    return numbered.withColumn("__first", first).withColumn("previous_length", F.lag("run_length").over(w)).where(F.col("__first") & (F.col("previous_length") >= least)).drop("__first")


def steady_ahead(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, same: str, never: Column, rows: int = 24) -> DataFrame:
    """Rows where flag rises and the next `rows` rows (with this one) are all there, keep one value of `same` and never have `never`."""
    w = ordered(keys, order)
    frame = w.rowsBetween(0, rows - 1)
    marked = df.withColumn("__flag", flag.cast("int")).withColumn("__never", never.cast("int"))
    rises = (F.col("__flag") == 1) & (F.coalesce(F.lag("__flag").over(w), F.lit(0)) == 0)
    kept = (F.count("*").over(frame) == rows) & F.min(same).over(frame).eqNullSafe(F.max(same).over(frame)) & (F.max("__never").over(frame) == 0)
    return marked.withColumn("__ok", rises & kept).where("__ok").drop("__flag", "__never", "__ok")


def wrapped_turn(df: DataFrame, keys: Sequence[str], order: Sequence[str], yaw: str, name: str) -> DataFrame:
    """Absolute change of an angle to the row before, over the shorter way. keys empty: the row before of any key, as in one log."""
    w = ordered(keys or [F.lit(0)], order)
    gap = F.abs(F.col(yaw) - F.lag(yaw).over(w))
    return df.withColumn(name, F.coalesce(F.least(gap, 360 - gap), F.lit(0.0)))


def collapse_dead(df: DataFrame, keys: Sequence[str], order: Sequence[str], alive: str) -> DataFrame:
    """Living rows and the first row of each death."""
    before = F.lag(alive).over(ordered(keys, order))
    return df.withColumn("__before", before).where(F.col(alive) | F.col("__before").isNull() | F.col("__before")).drop("__before")


def changes_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], on: str | None = None, gap: int | None = None) -> DataFrame:
    """Rows whose values differ from the row before (nulls are equal), the first ones, and those after a gap in `on`."""
    w = ordered(keys, order)
    now = F.struct(*values)
    differs = ~now.eqNullSafe(F.lag(now).over(w)) | (F.row_number().over(w) == 1)
    if gap is not None:
        differs = differs | F.coalesce(F.col(on) - F.lag(on).over(w) > gap, F.lit(False))
    return df.withColumn("__differs", differs).where("__differs").drop("__differs")


def rest_pruned(df: DataFrame, keys: Sequence[str], order: Sequence[str], axes: Sequence[str], slack: float = 0.01) -> DataFrame:
    """Drops the points after a track came to rest.

    Index of the last point that moved (by slack or more on an axis), plus one more, stay; a track that never moves, or of fewer than three points, is left whole.
    """
    w = ordered(keys, order)
    moved = None
    for c in axes:
        one = F.abs(F.col(c) - F.lag(c).over(w)) >= slack
        moved = one if moved is None else moved | one
    idx = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__moved", F.coalesce(moved, F.lit(False)))
    each = Window.partitionBy(*keys)
    idx = idx.withColumn("__last", F.max(F.when(F.col("__moved"), F.col("__i"))).over(each)).withColumn("__n", F.count("*").over(each))
    stays = (F.col("__n") < 3) | F.col("__last").isNull() | (F.col("__i") <= F.col("__last") + 1)
    return idx.where(stays).drop("__i", "__moved", "__last", "__n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(ordered(keys, order))).where("__n = 1").drop("__n")


def state_until_reset(df: DataFrame, keys: Sequence[str], order: Sequence[str], reset: Column, ends_at: Column, on: str, name: str) -> DataFrame:
    """Remaining seconds of an effect: the latest end since the last reset less now, at least 0; null before any effect."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = df.withColumn("__life", F.sum(reset.cast("int")).over(w))
    life = Window.partitionBy(*keys, "__life").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.max(ends_at).over(life)
    return grouped.withColumn(name, F.when(end.isNotNull(), F.greatest(F.lit(0.0), (end - F.col(on)) / TICK_RATE))).drop("__life")


def aborted(df: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column, per_row: bool = False) -> DataFrame:
    """Rows before the first that is not ok in its group (a missing value is not ok); per_row: simply the rows that are ok."""
    fine = F.coalesce(ok, F.lit(False))
    if per_row:
        return df.where(fine)
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__bad", F.sum((~fine).cast("int")).over(w)).where("__bad = 0").drop("__bad")


def rounds(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], on: str, is_start: Column, is_freeze: Column, is_end: Column, number: str | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """One row per end event: round, start_tick, freeze_tick, end_tick, next_start, and `extra` columns of the end event.

    start: the last start after the end before and up to this one; without one, the tick after the end before (0 for the first end).
    freeze: the last freeze from the start up to the end; without one, the start. Ends whose start is not before them make no round.
    round: the end's own `number` where that is positive, else its place among the rounds. next_start: the first start after the end.
    One window by tick, one group per part between two ends, and one window backwards over starts and ends.
    """
    # at one tick starts and freezes come before the end that may be theirs
    place = [on, is_end.cast("int"), *order]
    w = Window.partitionBy(*keys).orderBy(*place)
    marked = df.withColumns({"__s": F.when(is_start, F.col(on)), "__f": F.when(is_freeze, F.col(on)), "__e": F.when(is_end, F.col(on))})
    marked = marked.where("__s is not null or __f is not null or __e is not null")
    backwards = Window.partitionBy(*keys).orderBy(*[(c if isinstance(c, Column) else F.col(c)).desc() for c in place]).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("__next", F.last("__s", ignorenulls=True).over(backwards))
    part = F.coalesce(F.sum(F.col("__e").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.struct("__next", *([F.col(number).alias("__number")] if number else []), *[F.col(c).alias(f"__x_{c}") for c in extra])
    parts = marked.withColumn("__part", part).groupBy(*keys, "__part").agg(
        F.max("__s").alias("__s"), F.max("__f").alias("__f"), F.max("__e").alias("end_tick"), F.max_by(own, F.col("__e")).alias("__own")
    )
    ends = parts.where("end_tick is not null")
    before = F.lag("end_tick").over(Window.partitionBy(*keys).orderBy("__part"))
    ends = ends.withColumn("start_tick", F.coalesce("__s", before + 1, F.lit(0)).cast(df.schema[on].dataType))
    ends = ends.withColumn("freeze_tick", F.when(F.col("__f") >= F.col("start_tick"), F.col("__f")).otherwise(F.col("start_tick"))).where("start_tick < end_tick")
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("__part"))
    ends = ends.withColumn("round", ordinal)
    if number:
        ends = ends.withColumn("round", F.when(F.col("__own.__number") > 0, F.col("__own.__number").cast("int")).otherwise(F.col("round")))
    return ends.select(*keys, "round", "start_tick", "freeze_tick", "end_tick", F.col("__own.__next").alias("next_start"), *[F.col(f"__own.__x_{c}").alias(c) for c in extra])


def first_after(df: DataFrame, keys: Sequence[str], on: str, marks: dict[str, Column]) -> DataFrame:
    """For each name, the smallest `on` of a row marked so that is strictly later than this one's; one pass backwards, linear in a key's rows."""
    w = Window.partitionBy(*keys).orderBy(F.col(on).cast("long").desc()).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: F.min(F.when(mark, F.col(on))).over(w) for name, mark in marks.items()})


def was_sold(df: DataFrame, keys: Sequence[str], on: str, is_buy: Column, is_sell: Column) -> DataFrame:
    """Buys with was_sold: the next sale comes before the next buy; false where either is missing."""
    found = first_after(df, keys, on, {"__sell": is_sell, "__buy": is_buy})
    return found.withColumn("was_sold", F.coalesce(F.col("__sell") < F.col("__buy"), F.lit(False))).where(is_buy).drop("__sell", "__buy")


def triples(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, wanted: Sequence[str], value: str) -> DataFrame:
    """Rows that begin the ordered pattern of kinds, with the values of its rows in `matched`."""
    w = ordered(keys, order)
    hit = F.lit(True)
    for k, want in enumerate(wanted):
        hit = hit & ((F.lead(kind, k).over(w) if k else F.col(kind)) == want)
    values = F.array(*[F.lead(value, k).over(w) if k else F.col(value) for k in range(len(wanted))])
    return df.withColumn("matched", F.when(F.coalesce(hit, F.lit(False)), values)).where("matched is not null")


def counter_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str) -> DataFrame:
    """Rows where a counter went up by exactly one."""
    before = F.lag(counter).over(ordered(keys, order))
    return df.withColumn("__step", F.col(counter) - before).where("__step = 1").drop("__step")
