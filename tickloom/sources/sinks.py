"""Exports of lanes: dense arrays per clip, JSON rows, partitioned files."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_arrays(df: DataFrame, clip: Sequence[str], tick: str, player: str, values: Sequence[str]) -> DataFrame:
    """clip columns and `npz`: arrays ticks, players and, per value, a tick × player grid (NaN where there is no row).

    A clip is a bounded window of a round, so its grid fits a task; clips are independent.
    """

    def export(pdf: pd.DataFrame) -> pd.DataFrame:
        ticks, players = np.unique(pdf[tick].to_numpy()), np.unique(pdf[player].to_numpy())
        t, p = np.searchsorted(ticks, pdf[tick].to_numpy()), np.searchsorted(players, pdf[player].to_numpy())
        grids = {}
        for v in values:
            grids[v] = np.full((len(ticks), len(players)), np.nan)
            grids[v][t, p] = pdf[v].to_numpy(dtype=float)
        out = io.BytesIO()
        np.savez_compressed(out, ticks=ticks, players=players, **grids)
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in clip} | {"n_ticks": [len(ticks)], "n_players": [len(players)], "npz": [out.getvalue()]})

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in clip] + ["n_ticks int", "n_players int", "npz binary"])
    return df.select(*clip, tick, player, *values).groupBy(*clip).applyInPandas(export, schema)


def sections(df: DataFrame, clip: Sequence[str], lanes: dict[str, Sequence[str]], order: str) -> DataFrame:
    """One JSON document per clip with a section per lane, rows in order: the same content as a sectioned container."""
    listed = [F.sort_array(F.collect_list(F.when(F.col("lane") == lane, F.struct(order, *cols)))).alias(lane) for lane, cols in lanes.items()]
    grouped = df.groupBy(*clip).agg(*listed)
    return grouped.select(*clip, F.to_json(F.struct(*lanes)).alias("document"))


def per_player(df: DataFrame, path: str, player: str = "steamid") -> None:
    """One directory per player; a salt spreads a player with many rows over several files."""
    df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(8))).repartition(player, "__salt").drop("__salt").write.mode("overwrite").partitionBy(player).parquet(path)


def fnv1a(df: DataFrame, column: str, name: str = "checksum") -> DataFrame:
    """FNV-1a 64 of a binary column, as a signed long (Spark has no such function)."""

    @F.pandas_udf("long")
    def digest(values: pd.Series) -> pd.Series:
        there = values.notna().to_numpy()
        data = [v for v in values if v is not None]
        sizes = np.array([len(v) for v in data], np.int64)
        order = np.argsort(-sizes, kind="stable")  # the longest first: those that still have a byte at a place come first
        starts, joined = (np.cumsum(sizes) - sizes)[order], np.frombuffer(b"".join(data), np.uint8)
        h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
        longer = len(data) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        with np.errstate(over="ignore"):
            for place, n in enumerate(longer.tolist()):
                h[:n] = (h[:n] ^ joined[starts[:n] + place]) * np.uint64(0x100000001B3)
        found = np.empty(len(data), np.int64)
        found[order] = h.view(np.int64)
        out = pd.Series(pd.NA, index=values.index, dtype="Int64")
        out[there] = found
        return out

    return df.withColumn(name, digest(F.col(column)))


def read_dense(df: DataFrame, clip: Sequence[str], values: Sequence[str], npz: str = "npz") -> DataFrame:
    """The rows of dense_arrays() again: clip columns, tick, player and values, without empty cells."""
    kinds = dict(df.dtypes)

    def rows(frames):
        for pdf in frames:
            for data, *own in zip(pdf[npz], *[pdf[c] for c in clip]):
                with np.load(io.BytesIO(data)) as arrays:
                    grids = [arrays[v] for v in values]
                    t, p = np.nonzero(~np.all([np.isnan(g) for g in grids], axis=0))
                    yield pd.DataFrame({c: [x] * len(t) for c, x in zip(clip, own)} | {"tick": arrays["ticks"][t], "player": arrays["players"][p]} | {v: g[t, p] for v, g in zip(values, grids)})

    schema = ", ".join([f"{c} {kinds[c]}" for c in clip] + ["tick long", "player long"] + [f"{v} double" for v in values])
    return df.select(*clip, npz).mapInPandas(rows, schema)


def csr(df: DataFrame, clip: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Per clip the rows of a sparse lane as parallel arrays in order, with the count: compressed sparse rows."""
    listed = F.sort_array(F.collect_list(F.struct(order, *values)))
    grouped = df.groupBy(*clip).agg(listed.alias("__l"))
    return grouped.select(*clip, F.size("__l").alias("n"), *[F.col("__l")[c].alias(c) for c in (order, *values)])


def nested_csr(df: DataFrame, clip: Sequence[str], order: str, values: Sequence[str], nested: str, inner: Sequence[str]) -> DataFrame:
    """Per clip the rows of a lane as parallel arrays, and what each row holds in its array `nested` of structs flat beside them.

    offsets has one more place than rows: what row i holds stands at offsets[i] to offsets[i + 1] of each inner array. A null array holds nothing.
    """
    held = F.coalesce(F.col(nested), F.array().cast(df.schema[nested].dataType))
    listed = F.sort_array(F.collect_list(F.struct(order, *values, held.alias("__in"))))
    grouped = df.groupBy(*clip).agg(listed.alias("__l"))
    ends = F.aggregate("__l", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x["__in"]))))
    flat = F.flatten(F.col("__l")["__in"])
    return grouped.select(*clip, *[F.col("__l")[c].alias(c) for c in (order, *values)], ends.alias("offsets"), *[flat[c].alias(c) for c in inner])
