"""Events that a log does not send but its state implies: rounds, match end, first connects, purchases.

state_events() finds all kinds in one pass: a change belongs to one group (the log's rules, a player, a player's purchase slot), each
group is one window, and what a row implies is made by one `inline`. The functions of single kinds are filters over changes with the value before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import mapped, winner_of_reason, win_reason
from .asof import asof_join
from .windows import first_per_key


def stepped(changes: DataFrame, prop: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows at which a counter prop went up by one, with its old value."""
    rows = changes.where(F.col("prop") == prop).withColumn("value", F.col("value").try_cast("long"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("old", F.lag("value").over(w)).where("value = old + 1")


def _event(df: DataFrame, name: str, keys: Sequence[str], fields: dict[str, Column]) -> DataFrame:
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(*keys, "tick", "seq", F.lit(name).alias("name"), (F.map_from_arrays(F.array(*pairs[::2]), F.array(*pairs[1::2])) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("fields"))


def round_events(changes: DataFrame, keys: Sequence[str] = ("file",), order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    """round_start, round_officially_ended, round_end and cs_win_panel_match.

    changes: props round_end_count, round_win_reason, round_start_count, rounds_played and match_end_count.
    A round ends when its counter steps (reason as of then); on a start, the round before is officially over if there was one.
    """
    up_to = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    now = lambda prop: F.last(F.when(F.col("prop") == prop, F.col("value").try_cast("int")), ignorenulls=True).over(up_to)
    rows = changes.withColumns({"__reason": now("round_win_reason"), "__played": F.coalesce(now("rounds_played"), F.lit(0))})
    ends = stepped(rows, "round_end_count", keys, order)
    starts = stepped(rows, "round_start_count", keys, order).withColumn("__round", F.col("__played") + 1)
    match = stepped(rows, "match_end_count", keys, order)
    out = _event(ends, "round_end", keys, {"round": F.col("old"), "reason": win_reason(F.col("__reason")), "winner": winner_of_reason(F.col("__reason"))})
    out = out.unionByName(_event(starts, "round_start", keys, {"round": F.col("__round")}))
    out = out.unionByName(_event(starts.where("__round > 1"), "round_officially_ended", keys, {}))
    return out.unionByName(_event(match, "cs_win_panel_match", keys, {}))


#: Props that tell of the rules, of a player's connection, and of a purchase slot.
RULES = ("round_end_count", "round_win_reason", "round_start_count", "rounds_played", "match_end_count")
CONNECT = ("player_name", "steamid", "team_num", "player_pawn")
SLOT = ("def", "cost", "handle", "count")


def state_events(changes: DataFrame, keys: Sequence[str] = ("file",), player: str = "steamid", slot: str = "slot", order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    """keys, player, slot, tick, seq, name, fields: rounds, match end, first connects, purchases and sales out of one scan and one shuffle.

    The rows are those of round_events(), purchases() and the first row of each player's connection props. Rules have no player and slot,
    connects no slot. Changes of other props are left out before the shuffle.
    """
    prop = F.col("prop")
    kind = F.when(prop.isin(*RULES), 0).when(prop.isin(*CONNECT), 1).when(prop.isin(*SLOT), 2)
    rows = changes.withColumn("__kind", kind).where("__kind IS NOT NULL")
    rows = rows.withColumns({player: F.when(F.col("__kind") > 0, F.col(player)), slot: F.when(F.col("__kind") == 2, F.col(slot))})
    w = Window.partitionBy(*keys, "__kind", player, slot).orderBy(*order)
    up_to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda name, type: F.when(prop == name, F.struct(F.col("value").try_cast(type).alias("v")))
    known = lambda name: F.last(F.when(prop == name, F.col("value").try_cast("int")), ignorenulls=True).over(up_to)
    # the row of the same prop before, with or without a number
    old = {f"__{name}": F.last(of(name, "long"), ignorenulls=True).over(before)["v"] for name in ("round_end_count", "round_start_count", "match_end_count")}
    rows = rows.withColumns(
        old | {"__reason": known("round_win_reason"), "__played": F.coalesce(known("rounds_played"), F.lit(0)), "__n": F.row_number().over(w)}
        | {f"__{c}{k}": F.lead(c, k).over(w) for c in ("prop", "value") for k in (1, 2)}
    )
    now, number = F.col("value").try_cast("long"), lambda c: F.col(c).try_cast("int").cast("string")
    stepped_ = lambda name: (prop == name) & (now == F.col(f"__{name}") + 1)
    round_ = F.col("__played") + 1
    fields = lambda **pairs: F.map_from_arrays(F.array(*map(F.lit, pairs)).cast("array<string>"), F.array(*[v.cast("string") for v in pairs.values()]).cast("array<string>"))
    made = lambda name, cond, **pairs: F.when(cond, F.struct(F.lit(name).alias("name"), fields(**pairs).alias("fields")))
    bought = (prop == "def") & (F.col("__prop1") == "cost")
    events = F.array_compact(
        F.array(
            made("player_first_connect", (F.col("__kind") == 1) & (F.col("__n") == 1)),
            made("round_end", stepped_("round_end_count"), round=F.col("__round_end_count"), reason=win_reason(F.col("__reason")), winner=winner_of_reason(F.col("__reason"))),
            made("round_officially_ended", stepped_("round_start_count") & (round_ > 1)),
            made("round_start", stepped_("round_start_count"), round=round_),
            made("cs_win_panel_match", stepped_("match_end_count")),
            made("item_purchase", bought, def_index=number("value"), cost=number("__value1"), handle=F.when(F.col("__prop2") == "handle", F.col("__value2").try_cast("long"))),
            made("item_sold", (prop == "count") & (F.col("value").try_cast("int") == 0), def_index=F.lit(None), cost=F.lit(None), handle=F.lit(None)),
        )
    )
    return rows.select(*keys, player, slot, *order, F.inline(events))


def with_deferred_state(events: DataFrame, state: DataFrame, by: Sequence[str], values: Sequence[str], deferred: Sequence[str], packet: str = "packet", place: str = "place", prefix: str = "") -> DataFrame:
    """events with the state as of each event on a clock of packets and places within them.

    An event sees what stands at or before its place; events whose name is in `deferred` are filled in at the end of their packet and see all of it.
    """
    last = F.lit(2**63 - 1)
    # a deferred event takes the place after all others of its packet
    moved = events.withColumn("__place", F.when(F.col("name").isin(*deferred), last).otherwise(F.col(place).cast("long")))
    clock = lambda at: F.struct(F.col(packet).cast("long").alias("packet"), at.alias("place"))
    left = moved.withColumn("__clock", clock(F.col("__place"))).drop("__place")
    right = state.select(*by, clock(F.col(place).cast("long")).alias("__clock"), *values)
    return asof_join(left, right, by, "__clock", values, prefix=prefix).drop("__clock")


def first_connects(players: DataFrame, keys: Sequence[str] = ("file", "steamid"), order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    return first_per_key(players, keys, order)


def team_changes(events: DataFrame) -> DataFrame:
    """tick, steamid, team, oldteam of player_team events."""
    rows = events.where("name = 'player_team'")
    return rows.select("tick", *[F.col("fields")[k].alias(k) for k in ("steamid", "team", "oldteam")])


def rank_updates(events: DataFrame) -> DataFrame:
    """Wins, old and new rank and their change."""
    n = lambda k: F.col("fields")[k].try_cast("int")
    return events.where("name = 'rank_update'").select("tick", F.col("fields")["steamid"].alias("steamid"), n("num_wins").alias("num_wins"), n("rank_old").alias("rank_old"), n("rank_new").alias("rank_new"), (n("rank_new") - n("rank_old")).alias("rank_change"))


def purchases(changes: DataFrame, keys: Sequence[str] = ("file", "steamid", "slot"), order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    """item_purchase and item_sold: a definition, its cost and (unless it is none) its handle follow one another; a count that falls to 0 is a sale.

    Changes of other props may stand between them; they are left out before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    nxt = lambda c, k: F.lead(c, k).over(w)
    rows = changes.where(F.col("prop").isin(*SLOT)).withColumns({"__p1": nxt("prop", 1), "__p2": nxt("prop", 2), "__v1": nxt("value", 1), "__v2": nxt("value", 2)})
    buy = (F.col("prop") == "def") & (F.col("__p1") == "cost")
    sold = (F.col("prop") == "count") & (F.col("value").try_cast("int") == 0)
    return rows.where(buy | sold).select(
        *keys, *order, F.when(sold, "item_sold").otherwise("item_purchase").alias("name"), F.when(buy, F.col("value").try_cast("int")).alias("def_index"),
        F.when(buy, F.col("__v1").try_cast("int")).alias("cost"), F.when(buy & (F.col("__p2") == "handle"), F.col("__v2").try_cast("long")).alias("handle"),
    )


def weapon_names(df: DataFrame, column: str, names: dict[int, str], to: str = "weapon") -> DataFrame:
    """Names of definition numbers by a dictionary that the caller supplies; unknown numbers give null."""
    known = mapped(F.col(column), names) if names else F.lit(None).cast("string")
    return df.withColumn(to, F.when(F.col(column).isin(*names), known)) if names else df.withColumn(to, known)


def connect_rows(bits: DataFrame, column: str, slots: int) -> DataFrame:
    """One row per set bit of a mask with its number."""
    return bits.withColumn("slot", F.explode(F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.getbit(F.col(column).cast("long"), i) == 1)))
