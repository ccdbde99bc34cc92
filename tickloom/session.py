"""The session's settings for this package, and the engine that opens logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .query import LogDataset, Registry

#: What the operators assume of a session; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "tickloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Engine:
    """Opens logs, or tables that stand for their lanes. registry: names and derived columns that tick queries may use."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None):
        self.spark, self.registry = spark, registry

    def open(self, path: str | list[str], pattern: str = "*.dem*", **ready: DataFrame) -> LogDataset:
        """A dataset whose lanes are decoded from the logs under path when they are first used.

        Only replaylog.LANES come from the logs. Entity state is not decoded: ticks, grenades, item_drops and skins are
        given ready, as tables with the log's name in `file`; without them, asking for them raises a KeyError that names the lanes there are.
        """
        from .sources.replaylog import LANES, read_lane

        decoded = {lane: (lambda lane=lane: read_lane(self.spark, path, lane, pattern)) for lane in LANES}
        return LogDataset(decoded | {name: (lambda df=df: df) for name, df in ready.items()}, self.registry)

    def from_tables(self, **lanes: DataFrame) -> LogDataset:
        """A dataset over ready lanes: ticks, events, players, grenades, and so on."""
        return LogDataset({name: (lambda df=df: df) for name, df in lanes.items()}, self.registry)
