"""Parts of one table whose columns got their types late: a column that is only null in a part has no type there.

The first part that has a value decides a column's type. Later parts of another type count as null in it, as their values have no
place in the column; parts without the column have nulls. Nothing is cast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NullType, StructType
from pyspark.sql.window import Window


def null_only(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of the columns that have no value: one aggregate over these columns alone."""
    open_ = [c for c in columns if not isinstance(df.schema[c].dataType, NullType)]
    there = df.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in open_]).first() if open_ else {}
    return {c for c in columns if c not in open_ or not there[c]}


def resolved(schemas: Sequence[StructType], empty: Sequence[set[str]]) -> dict[str, DataType]:
    """Columns in order of their first appearance with the type of the first part that has a value; without any, of the first that names one."""
    types: dict[str, DataType] = {}
    named: dict[str, DataType] = {}
    for schema, without in zip(schemas, empty):
        for f in schema.fields:
            if isinstance(named.setdefault(f.name, f.dataType), NullType):
                named[f.name] = f.dataType
            if f.name not in without and not isinstance(f.dataType, NullType):
                types.setdefault(f.name, f.dataType)
    return {c: types.get(c, t) for c, t in named.items()}


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """All parts, in their order, as one table. Only columns whose declared types differ are looked into, once a part."""
    schemas = [df.schema for df in frames]
    declared: dict[str, set] = {}
    for s in schemas:
        for f in s.fields:
            declared.setdefault(f.name, set()).add(f.dataType.simpleString())
    unclear = {c for c, kinds in declared.items() if len(kinds) > 1}
    empty = [null_only(df, [c for c in s.names if c in unclear]) for df, s in zip(frames, schemas)]
    types = resolved(schemas, empty)
    fitted = [
        df.select(*[(F.col(c) if c in s.names and s[c].dataType == t else F.lit(None).cast(t) if not isinstance(t, NullType) else F.lit(None)).alias(c) for c, t in types.items()]) for df, s in zip(frames, schemas)
    ]
    out = fitted[0]
    for more in fitted[1:]:
        out = out.unionByName(more)
    return out


def read_parts(spark: SparkSession, paths: Sequence[str], format: str = "parquet") -> DataFrame:
    """append() of the tables at the paths (one of each version of a log's schema, not one of each file), in their order."""
    return append([spark.read.format(format).load(p) for p in paths])


def by_first_type(rows: DataFrame, part: str, order: Sequence[str], prop: str = "prop", type: str = "type", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """The long form, for any number of parts: rows of (part, prop, type, value), value null where the type is not the prop's own.

    A prop's type is that of its first row with a value, by part and order. keys: props of different logs do not meet. Types are few, so
    they are found by an aggregate and joined back.
    """
    first = rows.where(F.col(value).isNotNull() & F.col(type).isNotNull()).groupBy(*keys, prop).agg(F.min_by(type, F.struct(part, *order)).alias("__type"))
    return rows.join(first, [*keys, prop], "left").select(*[F.when(F.col(type) == F.col("__type"), F.col(value)).alias(value) if c == value else F.col("__type").alias(type) if c == type else F.col(c) for c in rows.columns])


def backfilled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with, for each column, whether it has had a value by then: the point from which a late column is typed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"{c}_typed": F.coalesce(F.bool_or(F.col(c).isNotNull()).over(w), F.lit(False)) for c in columns})
