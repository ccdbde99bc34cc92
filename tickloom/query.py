"""The query object of a log and the dataset that answers it.

A query names columns, players, ticks, states and events; each part compiles to a projection or a filter, so Catalyst pushes it to the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import asof
from .operators import windows as win

#: Columns that a tick query always returns; raw fields of events that enrichment replaces.
ALWAYS = ("tick", "steamid", "name")
REMOVED_EVENTS = ("server_cvar", "player_connect")
#: Raw ids that enrichment has used up, and the event that only serves to find sales (fixed values).
INTERNAL_FIELDS = ("userid", "attacker", "assister", "userid_pawn", "attacker_pawn", "assister_pawn", "victim", "victim_pawn")
INTERNAL_EVENTS = ("item_sold",)
#: Parts that a log's events are spread over to get the state of its rules.
SALTS = 16
ROLES = {"userid": "user", "attacker": "attacker", "assister": "assister", "victim": "victim"}


@dataclass(frozen=True)
class Predicate:
    """A caller's test of rows that no expression states: test(frame of the named columns) → booleans, batch by batch.

    It runs after all filters that Spark knows, on the named columns only. Rows with a null in one of them are not shown to it and do not pass
    (nulls="keep": they pass). An error ends the query (errors="drop": the batch's rows do not pass).
    """

    columns: Sequence[str]
    test: Callable[[pd.DataFrame], Sequence[bool]]
    nulls: str = "drop"
    errors: str = "raise"

    def column(self) -> Column:
        names, test, quiet = list(self.columns), self.test, self.errors == "drop"

        @F.pandas_udf("boolean")
        def passes(*columns: pd.Series) -> pd.Series:
            frame = pd.concat(columns, axis=1, keys=names)
            whole = frame.notna().all(axis=1)
            out = pd.Series(False, index=frame.index)
            if whole.any():
                try:
                    out[whole] = pd.Series(test(frame[whole].reset_index(drop=True))).fillna(False).astype(bool).to_numpy()
                except Exception:
                    if not quiet:
                        raise
            return out

        missing = F.lit(False)
        for c in names:
            missing = missing | F.col(c).isNull()
        found = passes(*[F.col(c) for c in names])
        return F.when(missing, F.lit(self.nulls == "keep")).otherwise(found)


@dataclass(frozen=True)
class Registry:
    """Names that a caller may use for columns of the ticks lane, and columns that are made out of others.

    names: friendly name → column of the lane. derived: name → (columns it needs, expression over them); an expression may use what other
    derived names make. A prefix `Weapon.` or `Grenade.` does not count (of states: `Weapon.`). Unknown names stand for themselves.
    """

    names: Mapping[str, str] = field(default_factory=dict)
    derived: Mapping[str, tuple[Sequence[str], Callable[[], Column]]] = field(default_factory=dict)

    def real(self, name: str, state: bool = False) -> str:
        for prefix in ("Weapon.", "Grenade.")[: 1 if state else 2]:
            name = name.removeprefix(prefix)
        return self.names.get(name, name)

    def with_derived(self, df: DataFrame, wanted: Sequence[str]) -> DataFrame:
        """df with the derived columns among the wanted ones and those that they need, in order of need."""
        for name in wanted:
            if name in self.derived and name not in df.columns:
                needs, make = self.derived[name]
                df = self.with_derived(df, [self.real(c) for c in needs])
                df = df.withColumn(name, make())
        return df


def friendly_name(path: str) -> str:
    """The name that a column's path suggests: without its classes, `m_` and the letters of its type, in lower case with lines between words."""
    last = re.sub(r"^m_(?:[a-z]{1,3}(?=[A-Z]))?", "", path.rpartition(".")[2])
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", last).lower()


@dataclass(frozen=True)
class LogQuery:
    """What a caller wants of a log; empty means everything. Players and ticks may be tables of them (steamid, tick), of any size."""

    columns: Sequence[str] = ()
    players: Sequence[int] | DataFrame = ()
    ticks: Sequence[int] | DataFrame = ()
    states: Mapping[str, object] = field(default_factory=dict)
    events: Sequence[str] = ()
    other: Sequence[str] = ()
    #: A state filter ends the tick at the first player that differs; "row" drops that player's row only.
    state_mode: str = "abort"
    #: Applied last, to the rows that all other parts of the query leave.
    predicate: Predicate | None = None


def _log(*lanes: DataFrame) -> list[str]:
    """The key of a log where all lanes have one."""
    have = ["file" in df.columns for df in lanes]
    if any(have) and not all(have):
        raise ValueError("either all lanes or none must name their log in a column `file`")
    return ["file"] if all(have) else []


class LogDataset:
    """Lanes by name. Column names of the lanes are tick, steamid, name, seq and what they carry.

    Lanes of several logs have a column `file`; state, velocity and ticks of one log never meet those of another.
    """

    def __init__(self, lanes: Mapping[str, Callable[[], DataFrame]], registry: Registry | None = None):
        self.lanes, self.registry = dict(lanes), registry or Registry()

    def lane(self, name: str) -> DataFrame:
        if name not in self.lanes:
            raise KeyError(f"this log has no lane {name!r}; it has {', '.join(sorted(self.lanes))}")
        return self.lanes[name]()

    # lanes as they are
    def header(self) -> DataFrame:
        return self.lane("header")

    def grenades(self) -> DataFrame:
        return self.lane("grenades")

    def player_info(self) -> DataFrame:
        return self.lane("players")

    def item_drops(self) -> DataFrame:
        return self.lane("item_drops")

    def skins(self) -> DataFrame:
        return self.lane("skins")

    def voice(self) -> DataFrame:
        return self.lane("voice")

    def convars(self) -> DataFrame:
        return self.lane("convars")

    def chat_messages(self) -> DataFrame:
        return self.lane("chat")

    def event_names(self) -> DataFrame:
        return self.lane("events").select("name").distinct()

    def updated_fields(self) -> DataFrame:
        return self.lane("changes").select("prop").distinct().orderBy("prop")

    def ticks(self, q: LogQuery = LogQuery()) -> DataFrame:
        """One row per player and tick: velocity is computed over all rows, then filters apply, then the wanted columns stay."""
        df = self.lane("ticks")
        wanted = [c for c in q.columns if c not in ALWAYS]
        states = {self.registry.real(c, state=True): v for c, v in q.states.items()}
        log = _log(df)
        if any(c.startswith("velocity") for c in wanted):
            axes = {f"velocity_{c}": c for c in ("X", "Y", "Z") if c in df.columns}
            df = win.velocity(df, [*log, "steamid"], ["tick"], axes)
            df = win.speed(df, "velocity_X", "velocity_Y") if {"X", "Y"} <= set(df.columns) else df
        df = self.registry.with_derived(df, [*map(self.registry.real, wanted), *states])
        if states:
            ok = F.lit(True)
            for name, value in states.items():
                ok = ok & (F.col(name) == F.lit(value))
            order = ["entity_id"] if "entity_id" in df.columns else ["steamid"]
            df = win.aborted(df, [*log, "tick"], order, ok, per_row=q.state_mode == "row")
        for column, some in (("tick", q.ticks), ("steamid", q.players)):
            if isinstance(some, DataFrame):
                df = df.join(some.select(*[c for c in log if c in some.columns], column).distinct(), [*[c for c in log if c in some.columns], column], "left_semi")
            elif some:
                df = df.where(F.col(column).isin(*some))
        if q.predicate:
            df = df.where(q.predicate.column())
        if not q.columns:
            return df
        named = [(c, self.registry.real(c)) for c in wanted]
        return df.select(*log, *[c for c in ALWAYS if c in df.columns], *[F.col(real).alias(c) for c, real in named if real in df.columns])

    def event(self, name: str, player: Sequence[str] = (), other: Sequence[str] = (), roles: Mapping[str, str] | None = None) -> DataFrame:
        """Rows of one event with the state of each role's player as of the event, under the role's prefix.

        roles: event column with a player's id → prefix. A role without a player keeps nulls.
        """
        events = self.lane("events").where((F.col("name") == name) & ~F.col("name").isin(*REMOVED_EVENTS))
        for column, prefix in (roles if roles is not None else ROLES).items():
            if column not in events.columns or not player:
                continue
            ticks = self.lane("ticks")
            log = _log(events, ticks)
            state = ticks.select(*log, F.col("steamid").alias(column), "tick", *player)
            events = asof.asof_join(events, state, [*log, column], "tick", list(player), prefix=f"{prefix}_")
        if other:
            rules = self.lane("rules")
            log = _log(events, rules)
            # a log's events are spread over salts, and its rules, which are few, go to each of them
            spread = events.withColumn("__salt", F.pmod(F.xxhash64("tick", *events.columns[:1]), F.lit(SALTS)).cast("int"))
            each = rules.select(*log, "tick", *other).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            events = asof.asof_join(spread, each, [*log, "__salt"], "tick", list(other)).drop("__salt")
        return events

    def public(self, events: DataFrame) -> DataFrame:
        """Events as a caller gets them in the end: without the raw ids and the events that only serve to find others."""
        return events.where(~F.col("name").isin(*INTERNAL_EVENTS)).drop(*INTERNAL_FIELDS)

    def events(self, names: Sequence[str], player: Sequence[str] = (), other: Sequence[str] = ()) -> dict[str, DataFrame]:
        """One frame per event name; `all` stands for every name of the log (which are read first: they are few)."""
        if names and names[0] == "all":
            names = sorted(r["name"] for r in self.event_names().collect())
        return {n: self.event(n, player, other) for n in names if n not in REMOVED_EVENTS}
