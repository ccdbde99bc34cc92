"""State as of a moment: last observation carried forward, and as-of joins.

Both are one shuffle on the key and one sort: left and right rows are put in one stream per key, and a window carries the last
right row forward. Nothing is compared pairwise, so a key with many rows costs its sort only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the last value of its column that is not null, at or before the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last(col, ignorenulls=True).over(w) for name, col in values.items()})


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], tie: str | None = None, tolerance: int | None = None, strict: bool = False, prefix: str = ""
) -> DataFrame:
    """left with `values` of the latest right row of the same key whose `on` is at most left's (strict: less).

    tie orders rows of one `on` (both sides have it). tolerance: the right row may be so much earlier at most, else null.
    Left rows without a match keep nulls.
    """
    second = [tie] if tie else []
    rank = F.lit(1 if strict else 0)  # on equal order right rows come first, unless they must be earlier
    l = left.select(*[F.col(c) for c in left.columns], F.lit(None).cast("boolean").alias("__right"), (F.lit(0) if strict else F.lit(1)).alias("__side"))
    r = right.select(*by, on, *[c for c in second if c not in by], *[F.col(v).alias(f"__{v}") for v in values], F.col(on).alias("__at"), F.lit(True).alias("__right"), rank.alias("__side"))
    both = l.unionByName(r, allowMissingColumns=True)
    keys = [on, "__side", *second] if strict or not tie else [on, *second, "__side"]
    w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("__right"), F.struct("__at", *[f"__{v}" for v in values])), ignorenulls=True).over(w)
    out = both.withColumn("__found", found).where(F.col("__right").isNull())
    if tolerance is not None:
        out = out.withColumn("__found", F.when(F.col(on) - F.col("__found.__at") <= tolerance, F.col("__found")))
    return out.select(*left.columns, *[F.col(f"__found.__{v}").alias(prefix + v) for v in values])


def exact_or_before(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str) -> DataFrame:
    """left with the right value of the same tick, else of the tick before; ticks with several distinct values give null."""
    single = right.groupBy(*by, on).agg(F.when(F.count_distinct(value) == 1, F.first(value, ignorenulls=True)).alias(value), F.lit(True).alias("__there"))
    now = single.select(*by, on, F.col(value).alias("__now"), F.col("__there").alias("__has"))
    before = single.select(*by, (F.col(on) + 1).alias(on), F.col(value).alias("__before"))
    joined = left.join(now, [*by, on], "left").join(before, [*by, on], "left")
    return joined.select(*left.columns, F.when(F.col("__has"), F.col("__now")).otherwise(F.col("__before")).alias(value))


def latest_or_first_hint(left: DataFrame, samples: DataFrame, hints: DataFrame, by: Sequence[str], on: str, value: str, hint: str, tie: str) -> DataFrame:
    """The last sample at or before; without one, the hint of the earliest row of hints."""
    first = hints.groupBy(*by).agg(F.min_by(hint, on).alias("__hint"))
    found = asof_join(left, samples, by, on, [value], tie=tie)
    return found.join(first, list(by), "left").select(*left.columns, F.coalesce(value, "__hint").alias(value))
