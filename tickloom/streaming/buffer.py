"""A buffer for collections that come in two phases, as a stream: what a log holds, then what its ticks say about it.

Rows of a demo arrive in any order and may be repeated or late. The demo leaves the buffer when every collection it announced has both phases,
or when event time passes its last row by more than `wait`: then with what there is. State is one demo's parts; it is dropped either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that operators with timers need (a session setting of the caller).
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "demo string, num int, first string, second string, status string, done int, total int"


class TwoPhases(StatefulProcessor):
    """State: the demo's announced number of collections; of each collection, its two values (null: not there yet)."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "total int")
        self.parts = handle.getMapState("parts", "num int", "first string, has_first boolean, second string, has_second boolean")

    def _rows(self, demo: str, status: str, total: int | None) -> pd.DataFrame:
        held = sorted((key[0], tuple(value)) for key, value in self.parts.iterator())
        done = sum(bool(v[1] and v[3]) for _, v in held)
        rows = [(demo, n, v[0], v[2], "complete" if v[1] and v[3] else status, done, total if total is not None else len(held)) for n, v in held]
        return pd.DataFrame(rows, columns=["demo", "num", "first", "second", "status", "done", "total"])

    def _clear(self) -> None:
        self.parts.clear()
        self.total.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, latest = self.total.get()[0] if self.total.exists() else None, 0
        for batch in rows:
            for num, phase, value, announced, ms in zip(batch["num"], batch["phase"], batch["value"], batch["total"], batch["ms"]):
                num, value = int(num), None if pd.isna(value) else str(value)
                old = tuple(self.parts.getValue((num,))) if self.parts.containsKey((num,)) else (None, False, None, False)
                # a repeated first phase replaces the collection and undoes its second, as a new collection would; a second phase may come before
                again = phase == 1 and old[1]
                new = (value, True, None if again else old[2], False if again else old[3]) if phase == 1 else (old[0], old[1], value, True)
                self.parts.updateValue((num,), new)
                total = total if pd.isna(announced) else int(announced)
                latest = max(latest, int(ms))
        if total is not None:
            self.total.update((total,))
        out = self._rows(key[0], "waiting", total)
        if total is not None and int((out["status"] == "complete").sum()) >= total:
            self._clear()
            yield out
            return
        timers = list(self.handle.listTimers())
        due = max([latest + self.wait_ms, *timers])
        if due not in timers:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._rows(key[0], "expired", self.total.get()[0] if self.total.exists() else None)
        self._clear()
        yield out

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, time: str = "ts", delay: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """demo, num, first, second, status (complete or expired), done and total (of the demo) of each collection, when its demo leaves the buffer.

    rows: a stream of demo, num, phase (1 or 2), value, total (the demo's number of collections, on any of its rows; null elsewhere) and time.
    Repeated rows replace what they repeat; a first phase that comes again takes the second back. A demo whose rows come after it left begins anew.
    """
    wanted = rows.withWatermark(time, delay).select("demo", F.col("num").cast("int").alias("num"), F.col("phase").cast("int").alias("phase"), "value", F.col("total").cast("int").alias("total"), F.unix_millis(time).alias("ms"), time)
    return wanted.groupBy("demo").transformWithStateInPandas(TwoPhases(wait_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def completion(rows: DataFrame) -> DataFrame:
    """demo, done, total of a table of such rows: the buffer's report where all rows are there at once."""
    order = F.struct("ts", "value")
    each = rows.groupBy("demo", "num").agg(F.max(F.when(F.col("phase") == 1, order)).isNotNull().alias("a"), F.max(F.when(F.col("phase") == 2, order)).isNotNull().alias("b"), F.max("total").alias("total"))
    return each.groupBy("demo").agg(F.sum((F.col("a") & F.col("b")).cast("int")).alias("done"), F.coalesce(F.max("total"), F.count("*")).cast("int").alias("total"))
