"""Lives out of state rows, and joins of intervals with intervals.

An interval is half-open: [start, end). Interval joins cut both sides into buckets of a fixed width, so that Spark has an equality to hash
on besides the key, and two intervals are compared where both touch a bucket. A pair that shares several buckets is made in one of them
only: the one in which the later of the two starts lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lives(df: DataFrame, by: Sequence[str], order: Sequence[str], alive: Column, identity: Sequence[str] = (), end: Column | None = None) -> DataFrame:
    """by, life (from 0), start, end, identity: runs of living rows of one identity; nulls of an identity are equal.

    A life ends where a dead row or another identity follows; the last one of a key ends at `end` (a value of its rows, such as the
    log's last tick + 1), else it is open and its end null. order: what starts and ends are taken from, then what breaks ties.
    """
    on = order[0]
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*by, *order, *[c for c in identity if c not in (*by, *order)], F.coalesce(alive, F.lit(False)).alias("__alive"), (end if end is not None else F.lit(None).cast(df.schema[on].dataType)).alias("__end"))
    rows = rows.withColumns({"__before": F.coalesce(F.lag("__alive").over(w), F.lit(False)), "__same": F.lit(True)})
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = rows.withColumn("__starts", F.col("__alive") & ~(F.col("__before") & same))
    edges = rows.where(F.col("__starts") | (F.col("__before") & ~F.col("__alive")))
    edges = edges.withColumn("end", F.coalesce(F.lead(on).over(w), F.col("__end"))).where("__starts")
    return edges.select(*by, (F.row_number().over(w) - 1).alias("life"), F.col(on).alias("start"), "end", *[c for c in identity if c not in by])


def buckets(start: Column, end: Column, width: int) -> Column:
    """The buckets that [start, end) touches; none where it is empty."""
    last = F.floor((end - 1) / width)
    return F.when(end > start, F.sequence(F.floor(start / width), last))


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], width: int, values: Sequence[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """left with start and end of the overlap and `values` of each right interval of the same key that meets it; each pair once.

    Ends must be known. width: about the length of the longer side's intervals: shorter buckets repeat rows, longer ones compare more.
    salts: left rows of a key are spread over so many tasks, to each of which right's go: for keys that hold much of left.
    """
    own = [c for c in left.columns if c not in (*by, "start", "end")]
    salt = F.pmod(F.xxhash64(*by, "start", *own[:1]), F.lit(salts)).cast("int")
    l = left.withColumn("__salt", salt if salts > 1 else F.lit(0)).withColumn("__b", F.explode(buckets(F.col("start"), F.col("end"), width)))
    r = right.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("start").alias("__start"), F.col("end").alias("__end"), *[F.col(v).alias(f"__v_{v}") for v in values], F.explode(buckets(F.col("start"), F.col("end"), width)).alias("__rb"))
    if salts > 1:
        r = r.withColumn("__rs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = F.col("__b") == F.col("__rb")
    for c in by:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    cond = cond & (F.col("__salt") == F.col("__rs")) if salts > 1 else cond
    first = F.greatest("start", "__start")
    cond = cond & (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end")) & (F.floor(first / width) == F.col("__b"))
    pairs = l.join(r, cond, how)
    return pairs.select(*by, *own, first.alias("start"), F.least("end", "__end").alias("end"), *[F.col(f"__v_{v}").alias(v) for v in values])
