"""Streaming forms of the ordered-state operators, for logs that are still being written.

Late rows are dropped after the watermark; state is per key and bounded (one row, or one open session).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: state is dropped as it passes."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, keys: list[str], value: str, window: str = "1 hour", slide: str | None = None, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and tumbling (or sliding) window."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, delay).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def bursts(events: DataFrame, keys: list[str], gap: str = "5 minutes", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows at most `gap` apart."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def carried(events: DataFrame, key: str, order: str, value: str, is_state: str, keep_ms: int = 86_400_000) -> DataFrame:
    """Every row with the last value of a state row of its key before or at it, across batches. State: one number per key.

    events: key long, order long, value double, is_state boolean. Rows of a batch are sorted; a row that comes after a later one of an earlier batch
    sees the later state, as in any stream without buffering. A key without rows for keep_ms of the clock is forgotten.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([order, is_state], ascending=[True, False], kind="stable")
        out = []
        for o, v, s in zip(rows[order], rows[value], rows[is_state]):
            last = float(v) if s else last
            out.append((k[0], o, last))
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=[key, order, "state"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, state double", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
