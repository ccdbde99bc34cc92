"""Reports over a log's events and ticks, each for all logs and rounds at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof_join
from .clips import in_clips

#: Weapons of utility damage and the kind that they count as (fixed values).
UTILITY = {"hegrenade": "he", "molotov": "fire", "inferno": "fire", "incgrenade": "fire"}


def aim_windows(ticks: DataFrame, hurts: DataFrame, by: Sequence[str], attacker: str, event: str, ticks_before: int = 300, on: str = "tick", salts: int = 1) -> DataFrame:
    """The attacker's rows in the ticks up to each hurt event, with the event as clip_id. Events without an attacker have none."""
    windows = hurts.where(F.col(attacker).isNotNull()).select(*by, F.col(attacker).alias("steamid"), F.col(event).alias("clip_id"), (F.col(on) - ticks_before).alias("start"), F.col(on).alias("end"))
    return in_clips(ticks, windows, [*by, "steamid"], on, ticks_before + 1, salts)


def utility_damage(hurts: DataFrame, by: Sequence[str], weapon: str = "weapon", damage: str = "dmg_health") -> DataFrame:
    """Damage and hits of grenades (he) and fires (fire)."""
    kind = F.create_map(*[F.lit(x) for pair in UTILITY.items() for x in pair])
    return hurts.where(F.col(weapon).isin(*UTILITY)).groupBy(*by, F.element_at(kind, F.col(weapon)).alias("kind")).agg(F.sum(damage).alias("damage"), F.count("*").alias("hits"))


def at_events(ticks: DataFrame, events: DataFrame, by: Sequence[str], columns: Sequence[str], on: str = "tick") -> DataFrame:
    """The rows of all players at the ticks of some events (the end of freeze time, say): events are made distinct, so no row repeats."""
    return ticks.join(events.select(*by, on).distinct(), [*by, on], "left_semi").select(*by, on, "steamid", *[c for c in columns if c not in (*by, on, "steamid")])


def at_last_event(ticks: DataFrame, events: DataFrame, by: Sequence[str], columns: Sequence[str], on: str = "tick") -> DataFrame:
    """The rows of all players at the last of some events of each log (the last round's end, say)."""
    last = events.groupBy(*by).agg(F.max(on).alias(on)) if by else events.agg(F.max(on).alias(on))
    return at_events(ticks, last, by, columns, on)


def time_into(events: DataFrame, starts: DataFrame, by: Sequence[str], seconds: str, name: str = "into", on: str = "tick") -> DataFrame:
    """events with the seconds since the latest start at or before them; null before the first."""
    begun = starts.select(*by, on, F.col(seconds).alias("__began"))
    found = asof_join(events, begun, by, on, ["__began"])
    return found.withColumn(name, F.col(seconds) - F.col("__began")).drop("__began")


def of_kind(events: DataFrame, name: str, field: str, value: str) -> DataFrame:
    """Events of a name whose field has a value (deaths of a chicken, say)."""
    return events.where((F.col("name") == name) & (F.col(field) == value))


def voice_chunks(voice: DataFrame, by: Sequence[str], order: Sequence[str], data: str = "bytes", chunk: int = 1024) -> DataFrame:
    """by, part, packets, data: each player's packets in order, put together in chunks of so many packets: no player is one row, however long."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = voice.withColumn("__n", F.row_number().over(w) - 1).withColumn("part", F.floor(F.col("__n") / chunk))
    packets = F.transform(F.sort_array(F.collect_list(F.struct("__n", data))), lambda x: x[data])
    whole = F.aggregate("packets", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x, F.lit(b""))))
    return placed.groupBy(*by, "part").agg(packets.alias("packets")).select(*by, "part", F.size("packets").alias("packets"), whole.alias("data"))


def per_round(events: DataFrame, round: Column, name: str = "kills") -> DataFrame:
    return events.groupBy(round.alias("round")).agg(F.count("*").alias(name))


def clutches(deaths: DataFrame, by: Sequence[str], order: Sequence[str], side: Column, players: int = 5) -> DataFrame:
    """by, dead0, dead1, first_clutch: deaths of the sides 0 and 1, and the place (last of order) at which side 0 has one player left and side 1 more."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = deaths.withColumns({f"dead{s}": F.sum((side == s).cast("int")).over(w) for s in (0, 1)})
    alone = (F.col("dead0") == players - 1) & (F.col("dead1") < players - 1)
    return rows.groupBy(*by).agg(F.max("dead0").alias("dead0"), F.max("dead1").alias("dead1"), F.min(F.when(alone, F.col(order[-1]))).alias("first_clutch"))


def altitude(points: DataFrame, by: Sequence[str], z: str) -> DataFrame:
    """Median, lowest and highest of a coordinate."""
    return points.groupBy(*by).agg(F.median(z).alias("altitude"), F.min(z).alias("low"), F.max(z).alias("high"))


def bounds(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Box around the points whose coordinates are both finite; null without one."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
    return points.groupBy(*by).agg(*[f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))])


def kill_rows(deaths: DataFrame, required: Sequence[str] = ("steamid", "victim", "weapon"), warm: str = "warmup") -> DataFrame:
    """player_death rows as kills: those of warm-up and those that lack a required field are left out."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return deaths.where(~F.coalesce(F.col(warm), F.lit(False)) & whole)


def game_start(events: DataFrame, by: Sequence[str], seconds: str = "game_time", order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    """by, offset: the game time of the first round start; 0 for logs without one."""
    first = F.min_by(F.when(F.col("name") == "round_start", F.col(seconds)), F.when(F.col("name") == "round_start", F.struct(*order)))
    return events.groupBy(*by).agg(F.coalesce(first, F.lit(0.0)).alias("offset"))


def local_ticks(df: DataFrame, headers: DataFrame, by: Sequence[str], ticks: Sequence[str], start: str = "server_start_tick") -> DataFrame:
    """Server ticks that rows carry, as ticks of their own log: those from 0 on less the header's start; without one they stay."""
    shifted = df.join(headers.select(*by, F.col(start).try_cast("long").alias("__start")), list(by), "left")
    shift = F.coalesce("__start", F.lit(0))
    return shifted.select(*[F.when(F.col(c) >= 0, F.col(c) - shift).otherwise(F.col(c)).alias(c) if c in ticks else F.col(c) for c in df.columns])


def ragdoll_impacts(kills: DataFrame, ticks: DataFrame, by: Sequence[str], victim: str, kill: str, values: Sequence[str], slack: int = 2, on: str = "tick") -> DataFrame:
    """kills with `values` of the victim's first dead row, within slack ticks from the kill on, that has any of them."""
    some = F.lit(False)
    for v in values:
        some = some | F.col(v).isNotNull()
    windows = kills.select(*by, F.col(victim).alias("steamid"), F.col(kill).alias("clip_id"), F.col(on).alias("start"), (F.col(on) + slack).alias("end"))
    found = in_clips(ticks.where(some & ~F.col("alive")), windows, [*by, "steamid"], on, slack + 1).groupBy("clip_id").agg(F.min_by(F.struct(*values), on).alias("__v"))
    return kills.join(found, F.col(kill) == F.col("clip_id")).select(*kills.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def press_edges(inputs: DataFrame, by: Sequence[str], pressed: Column, order: Sequence[str] = ("tick",), every: bool = False) -> DataFrame:
    """by and tick at which a button goes down: pressed now, not in the row before. Rows without a tick come last.

    every: each such row, also where a tick has several; else each tick once. order must tell rows of one tick apart where there are several.
    """
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    rows = inputs.withColumn("__now", F.coalesce(pressed, F.lit(False))).withColumn("__before", F.coalesce(F.lag("__now").over(w), F.lit(False)))
    edges = rows.where("__now AND NOT __before").select(*by, order[0])
    return edges if every else edges.distinct()


def player_index(df: DataFrame, players: DataFrame, by: Sequence[str], key: str, name: str, index: str, default: int) -> DataFrame:
    """The player's index by id, else by name, else the default; of several players the smallest index."""
    a = players.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min(index).alias("__a"))
    b = players.where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.min(index).alias("__b"))
    return df.join(a, [*by, key], "left").join(b, [*by, name], "left").select(*df.columns, F.coalesce("__a", "__b", F.lit(default)).alias(index))
