"""A catalog's asset rows against the files that are there: what to add, to fix, to take out, and doing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import merge

#: A clip is named after its log and its round.
CLIP = r"(?i)([^/]+)_r0*([1-9][0-9]{0,8})\.dem$"
#: A source is a log, packed or not.
SOURCE = r"(?i)([^/]+?)(?:\.dem)(?:\.gz|\.zst)?$"


def listing(spark: SparkSession, path: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """path, size, modified of the files below; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def clips(files: DataFrame) -> DataFrame:
    """demo (lower case), round and the file of each clip; other files are left out."""
    name, round_ = F.lower(F.regexp_extract("path", CLIP, 1)), F.regexp_extract("path", CLIP, 2)
    return files.withColumns({"demo": name, "round": F.when(round_ != "", round_).cast("int")}).where("demo <> '' AND round > 0")


def sources(files: DataFrame) -> DataFrame:
    """demo and the file of each log that is no clip; of a packed and a plain one both."""
    name = F.lower(F.regexp_extract("path", SOURCE, 1))
    return files.where(~F.col("path").rlike(CLIP)).withColumn("demo", name).where("demo <> ''")


def reconciled(collections: DataFrame, assets: DataFrame, files: DataFrame, keys: Sequence[str], size: str = "size", status: str = "status") -> DataFrame:
    """keys, action, recorded and found (sizes): one row for each collection, asset row or file.

    current: a complete row whose file has its size. fix: a row whose file differs or that is not complete. add: a collection's file without a
    row. delete: a row without a file, or whose collection is gone. missing: a collection with neither. stray: a file of no collection. ambiguous:
    several files have the keys, and none is chosen. Null keys equal nothing.
    """
    own = collections.select(*keys).distinct().withColumn("__own", F.lit(True))
    rows = assets.groupBy(*keys).agg(F.max(size).alias("recorded"), F.bool_and(F.col(status) == "complete").alias("__complete"), F.lit(True).alias("__row"))
    there = files.groupBy(*keys).agg(F.max(size).alias("found"), F.count("*").alias("__files"))
    both = own.join(rows, list(keys), "full").join(there, list(keys), "full")
    known, row, file = F.col("__own").isNotNull(), F.col("__row").isNotNull(), F.col("__files").isNotNull()
    good = F.coalesce(F.col("__complete"), F.lit(False)) & (F.col("recorded") == F.col("found"))
    action = (
        F.when(~known & ~row, "stray").when(~known, "delete").when(F.col("__files") > 1, "ambiguous").when(row & file, F.when(F.coalesce(good, F.lit(False)), "current").otherwise("fix"))
        .when(row, "delete").when(file, "add").otherwise("missing")
    )
    return both.select(*keys, action.alias("action"), "recorded", "found")


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def repaired(assets: DataFrame, plan: DataFrame, files: DataFrame, keys: Sequence[str], size: str = "size", status: str = "status") -> DataFrame:
    """The asset table after the plan: files' columns for rows to add or fix, marked complete; rows to delete are gone; all else stays."""
    changed = files.join(plan.where(F.col("action").isin("add", "fix")).select(*keys), list(keys), "left_semi").withColumn(status, F.lit("complete"))
    left = assets.join(plan.where("action = 'delete'").select(*keys), list(keys), "left_anti")
    fresh = changed.select(*[c for c in changed.columns if c in assets.columns])
    return merge(left, fresh, keys, keep_if_empty=[c for c in assets.columns if c not in (*keys, size, status)])
