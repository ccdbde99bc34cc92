"""Mergeable statistics of an entity lane: partial results per file, kept, and put together later without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts that a partial result holds, by the mark they count.
MARKS = ("create", "update", "leave", "delete")


def partial(rows: DataFrame, by: Sequence[str], on: str = "tick", entity: str = "entity_id", mark: str = "mark", extents: Sequence[str] = ()) -> DataFrame:
    """by, counts of each mark, first and last tick, extents of numbers, and a sketch of the distinct entities.

    by: the part (a file) and what is told apart (class, field). Rows of any number of parts make one shuffle of partial sums.
    """
    counts: list[Column] = [F.sum((F.col(mark) == m).cast("long")).alias(f"{m}s") for m in MARKS]
    ends = [f(c).alias(f"{name}_{c}") for c in extents for name, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *counts, F.min(on).alias("first_tick"), F.max(on).alias("last_tick"), *ends, F.hll_sketch_agg(F.col(entity).cast("string")).alias("entities"))


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Partial results put together over the columns that `by` leaves out: the result is a partial result again, in any order of merging."""
    out = []
    for c in parts.columns:
        if c in ("n", *[f"{m}s" for m in MARKS]):
            out.append(F.sum(c).alias(c))
        elif c == "entities":
            out.append(F.hll_union_agg(c).alias(c))
        elif c.startswith(("first_", "min_")):
            out.append(F.min(c).alias(c))
        elif c.startswith(("last_", "max_")):
            out.append(F.max(c).alias(c))
    return parts.groupBy(*by).agg(*out)


def estimated(parts: DataFrame) -> DataFrame:
    """The sketches as numbers of distinct entities (an estimate of about 2 % error)."""
    return parts.withColumn("entities", F.hll_sketch_estimate("entities"))
