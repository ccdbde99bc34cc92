"""Lanes of a replay clip: kills, weapons, inputs, entities and states as rows of DataFrames.

`by` names the columns that tell logs apart. A clip has clip_id, `by`, and a closed range of ticks [start, end] (operators/clips.py).
Rows meet their clips by buckets of ticks; what changes is found by windows of one life or player, so no task holds more than such a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof_join
from .clips import in_clips
from .windows import changes_only, ordered

# Bits of a kill's modifiers by the field of the event.
MODIFIERS = {"headshot": 1, "thrusmoke": 2, "noscope": 4, "attackerblind": 8, "penetrated": 16, "attacker_is_airborne": 32, "user_is_airborne": 64}
# Kinds of grenade by the event in which they go off.
DETONATIONS = {"flashbang_detonate": 1, "hegrenade_detonate": 2, "smokegrenade_detonate": 3, "inferno_startburn": 4, "decoy_started": 5}
# The index of nobody, the entity of no grenade, the handle of no owner.
NOBODY, NO_ENTITY, NO_HANDLE = 255, 2047, 0x3FFF
# Parts of names by which classes count as parts of the world, and parts by which they don't.
WORLD, NOT_WORLD = "Door|Break|Mover|Button|Toggle|Physbox|PhysicsProp|DynamicProp|Track|Rotating|Gib|Func", "Player|Weapon|Projectile"


def world_class(name: Column) -> Column:
    """Whether a class is a part of the world that may change in a round, by its name."""
    return name.rlike(WORLD) & ~name.rlike(NOT_WORLD)


def numbered(players: DataFrame, by: Sequence[str], player: str = "steamid") -> DataFrame:
    """by, player, index: the players of each log in the order of their ids, from 0; a null id has none."""
    return players.where(F.col(player).isNotNull()).select(*by, player).distinct().withColumn("index", F.row_number().over(ordered(by, [player])) - 1)


def indexed(df: DataFrame, players: DataFrame, by: Sequence[str], ids: dict[str, str], player: str = "steamid") -> DataFrame:
    """df with the index of each id column under the new name; NOBODY where the player is none of the log's or its index takes more than a byte."""
    for column, name in ids.items():
        of = players.select(*by, F.col(player).alias(column), F.when(F.col("index") < NOBODY, F.col("index")).alias("__index"))
        df = df.join(of, [*by, column], "left").withColumn(name, F.coalesce("__index", F.lit(NOBODY))).drop("__index")
    return df


def observed(field: str) -> Column:
    """A truth value or number of an event as true, false or unknown (null, below 0)."""
    number = F.col(field).cast("int")
    return F.when(number >= 0, number > 0)


def bits(values: dict[int, Column]) -> Column:
    """The sum of those bits whose condition holds; null does not."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(condition, bit).otherwise(0) for bit, condition in values.items()], F.lit(0))


def with_modifiers(deaths: DataFrame) -> DataFrame:
    """deaths with flags (what is true), known (what was observed) and penetrated (surfaces, null if below 0), of those fields that deaths has."""
    there = {bit: observed(field) for field, bit in MODIFIERS.items() if field in deaths.columns}
    surfaces = F.when(F.col("penetrated") >= 0, F.col("penetrated").cast("long")) if dict(deaths.dtypes).get("penetrated", "boolean") != "boolean" else F.lit(None).cast("long")
    return deaths.withColumns({"flags": bits(there), "known": bits({bit: value.isNotNull() for bit, value in there.items()}), "penetrated": surfaces})


def clip_kills(deaths: DataFrame, clips: DataFrame, players: DataFrame, by: Sequence[str], killer: str, victim: str, width: int, on: str = "tick", salts: int = 1) -> DataFrame:
    """Every death in each clip, by whoever or by the world: clip_id, the lane's columns, killer_index, victim_index, flags, known."""
    return indexed(in_clips(with_modifiers(deaths), clips, by, on, width, salts), players, by, {killer: "killer_index", victim: "victim_index"})


def enriched_kills(kills: DataFrame, deaths: DataFrame, ticks: DataFrame, by: Sequence[str], killer: str, victim: str, order: str, on: str = "tick", player: str = "steamid") -> DataFrame:
    """kills with flags, known and penetrated of the death of the same tick, killer and victim (of several the last by order).

    Where it says nothing of them being in the air, the last row in which they live at the kill's tick, or else at the one before, does.
    Without a death flags and known start at 0.
    """
    keys = [*by, on, killer, victim]
    said = with_modifiers(deaths).groupBy(*keys).agg(F.max_by(F.struct("flags", "known", "penetrated"), order).alias("__said"))
    out = kills.join(said, keys, "left").select(
        *kills.columns, F.coalesce("__said.flags", F.lit(0)).alias("flags"), F.coalesce("__said.known", F.lit(0)).alias("known"), F.col("__said.penetrated").alias("penetrated")
    )
    seen = ticks.where("alive").groupBy(*by, player, on).agg(F.max_by("airborne", order).alias("__air"))
    for column, bit in ((killer, MODIFIERS["attacker_is_airborne"]), (victim, MODIFIERS["user_is_airborne"])):
        now = seen.select(*by, F.col(player).alias(column), on, F.struct("__air").alias("__now"))
        before = seen.select(*by, F.col(player).alias(column), (F.col(on) + 1).alias(on), F.struct("__air").alias("__before"))
        out = out.join(now, [*by, column, on], "left").join(before, [*by, column, on], "left")
        # the row of the tick itself counts, even where it does not know
        air = F.when(F.col("known").bitwiseAND(bit) == 0, F.coalesce("__now", "__before")["__air"])
        flags, known = F.col("flags").bitwiseOR(F.when(air, bit).otherwise(0)), F.col("known").bitwiseOR(F.when(air.isNotNull(), bit).otherwise(0))
        out = out.select(*kills.columns, flags.alias("flags"), known.alias("known"), "penetrated")
    return out


def death_sources(kills: DataFrame, ticks: DataFrame, by: Sequence[str], victim: str, kill: str, values: Sequence[str], origin: str, slack: int = 2, on: str = "tick", player: str = "steamid") -> DataFrame:
    """kills with the victim's first dead row, within slack ticks from the kill on, that has any of values: source_tick and its origin (an array; null unless all of it is finite).

    Kills without such a row have none here.
    """
    windows = kills.select(*by, F.col(victim).alias(player), F.col(kill).alias("clip_id"), F.col(on).alias("start"), (F.col(on) + slack).alias("end"))
    some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    dead = in_clips(ticks.where(~F.col("alive") & some), windows, [*by, player], on, slack + 1)
    first = dead.groupBy("clip_id").agg(F.min_by(F.struct(F.col(on).alias("source_tick"), F.when(finite(F.col(origin)), F.col(origin)).alias("origin")), on).alias("__s"))
    return kills.join(first, F.col(kill) == F.col("clip_id")).select(*kills.columns, "__s.*")


def finite(values: Column) -> Column:
    """Whether an array has no component that is null, NaN or infinite; null has."""
    return F.coalesce(F.forall(values, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def placed(events: DataFrame, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Events whose place is known: each coordinate is there and finite."""
    return events.where(finite(F.array(*[F.col(c).cast("double") for c in xyz])))


def impacts(events: DataFrame, clips: DataFrame, players: DataFrame, by: Sequence[str], width: int, user: str = "user_steamid", attacker: str = "attacker_steamid", on: str = "tick") -> DataFrame:
    """Bullet impacts with a place in each clip, with player_index of the user, or of the attacker where no user is named."""
    rows = placed(events.where("name = 'bullet_impact'")).withColumn("__player", F.coalesce(user, attacker))
    return indexed(in_clips(rows, clips, by, on, width), players, by, {"__player": "player_index"}).drop("__player")


def detonations(events: DataFrame, clips: DataFrame, by: Sequence[str], width: int, on: str = "tick") -> DataFrame:
    """Grenades that go off at a known place in each clip: kind (DETONATIONS), entityid null where it is below 0 or stands for none."""
    kind = F.create_map(*[F.lit(x) for pair in DETONATIONS.items() for x in pair])[F.col("name")]
    rows = placed(events.where(F.col("name").isin(*DETONATIONS))).withColumn("kind", kind)
    known = F.when((F.col("entityid") >= 0) & (F.col("entityid") != NO_ENTITY), F.col("entityid"))
    return in_clips(rows.withColumn("entityid", known), clips, by, on, width)


def presence(parts: Sequence[Sequence[str]]) -> Column:
    """Bit i is set where every column of part i is there. 62 parts at most."""
    if len(parts) > 62:
        raise ValueError("more parts than bits")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in part]), 1 << i).otherwise(0).cast("long") for i, part in enumerate(parts)], F.lit(0).cast("long"))


def inputs(events: DataFrame, clips: DataFrame, players: DataFrame, by: Sequence[str], parts: Sequence[Sequence[str]], width: int, user: str = "user_steamid", on: str = "tick", name: str = "fire_bullets") -> DataFrame:
    """Raw inputs of one event in each clip with the mask of parts that are there; a part of which a column is missing is null as a whole."""
    rows = events.where(F.col("name") == name).withColumn("presence", presence(parts))
    whole = {c: F.when(F.col("presence").bitwiseAND(1 << i) != 0, F.col(c)) for i, part in enumerate(parts) for c in part}
    return indexed(in_clips(rows.withColumns(whole), clips, by, on, width), players, by, {user: "player_index"})


def disjoint(clips: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, clip_id, start, end: clips that hold the same ticks, of which no two of one id and log overlap; those that end before they start go."""
    w = ordered(["clip_id", *by], ["start", "end"]).rowsBetween(Window.unboundedPreceding, -1)
    cut = clips.where(F.col("start") <= F.col("end")).select(*by, "clip_id", F.greatest("start", F.max("end").over(w) + 1).alias("start"), "end")
    return cut.where(F.col("start") <= F.col("end"))


def weapon_lives(snapshots: DataFrame, clips: DataFrame, by: Sequence[str], width: int, life: Sequence[str] = ("entity", "serial"), order: Sequence[str] = ("tick", "seq"), on: str = "tick", salts: int = 1, per_task: int = 20_000) -> DataFrame:
    """Snapshots in each clip, equal ones once, with life_id: the lives of a clip from 1 in the order in which they begin (tick, place, entity, serial).

    Equal snapshots go before they meet the clips, whose ranges of one id are made disjoint; the pairs of clip and snapshot are then sent once, by clip.
    A task gets about per_task clips: pairs take much less room in a shuffle than in a sort, so tasks made by shuffled bytes would spill.
    """
    rows = in_clips(snapshots.distinct(), disjoint(clips, by), by, on, width, salts).repartition(clips.count() // per_task + 1, "clip_id")
    lives = ordered(["clip_id", *life], order)
    rows = rows.withColumn("__first", F.first(F.struct(*order)).over(lives))
    return rows.withColumn("life_id", F.dense_rank().over(ordered(["clip_id"], ["__first", *life]))).drop("__first")


def unowned(owner: str = "owner", handle: str = "owner_handle") -> Column:
    """Whether a weapon lies in the world: no owner is known, and its handle is null or stands for none."""
    h = F.col(handle).cast("long")
    none = (h == 0) | (h.bitwiseAND(NO_HANDLE) == NO_HANDLE)
    return F.col(owner).isNull() & F.coalesce(none, F.lit(True))


#: What an inventory row says besides owner and flags, and the bytes it may take; a value that takes more is null.
INVENTORY = {"slot": 8, "clip": 16, "reserve": 16, "position": 16}


def inventory_deltas(lives: DataFrame, players: DataFrame, by: Sequence[str], order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    """Rows of weapon_lives (owner, owner_handle, active, present, and INVENTORY) at which what is owned changes, and the first of each life.

    owner_index, flags: 1 owned, 2 active, 4 whether active is known, 8 in the world, 16 gone. Lives that have an owner_index keep it: snapshots
    are fewer than their pairs with clips, so it is best looked up (indexed) in them.
    """
    flags = bits({1: F.col("owner").isNotNull(), 2: F.col("active"), 4: F.col("active").isNotNull(), 8: unowned(), 16: ~F.col("present")})
    fit = {c: F.when(F.col(c).between(-(1 << (n - 1)), (1 << (n - 1)) - 1), F.col(c)) for c, n in INVENTORY.items()}
    rows = (lives if "owner_index" in lives.columns else indexed(lives, players, by, {"owner": "owner_index"})).withColumns(fit | {"flags": flags})
    return changes_only(rows, ["clip_id", "life_id"], order, ["owner_index", "flags", *INVENTORY])


def world_weapon_deltas(lives: DataFrame, state: Sequence[str] = ("pvs_state",), xyz: Sequence[str] = ("x", "y", "z"), order: Sequence[str] = ("tick", "seq"), on: str = "tick") -> DataFrame:
    """Changes of weapons that lie in the world: operation 1 it appears, 0 its place or state changes, 2 it is picked up or gone.

    The axes of velocity (per tick, since the row before that has a place) are null where there is none or it is of the same tick. A row has a place if each axis is there.
    """
    w = ordered(["clip_id", "life_id"], order)
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in xyz])
    rows = lives.withColumns({"__world": F.col("present") & unowned(), "__state": F.struct(*xyz, *state)})
    rows = rows.withColumns({"__was": F.coalesce(F.lag("__world").over(w), F.lit(False)), "__old": F.lag("__state").over(w)})
    ends = ~F.col("present") | (F.col("__was") & ~F.col("__world"))
    same = F.col("__world") & F.col("__was") & F.col("__state").eqNullSafe(F.col("__old"))
    kept = rows.withColumn("operation", F.when(ends, 2).when(F.col("__was"), 0).otherwise(1)).where((F.col("__world") | (F.col("operation") == 2)) & ~same)
    # places count from rows that are kept only
    last = F.last(F.when(there, F.struct(F.col(on).alias("t"), *xyz)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("__last", last)
    dt = F.col(on) - F.col("__last.t")
    return kept.withColumns({f"v{c}": F.when(there & (dt > 0), (F.col(c) - F.col(f"__last.{c}")) / dt) for c in xyz}).drop("__world", "__state", "__was", "__old", "__last")


def standing_once(deltas: DataFrame, by: Sequence[str], kind: str, xyz: Sequence[str], order: Sequence[str] = ("tick", "seq"), grain: float = 0.2) -> DataFrame:
    """deltas (operation spawn, update, delete; dormant) without spawns of an entity that stands there already.

    Entities are told apart by kind and place, to a grain; one that was deleted (not only dormant) may spawn again.
    """
    place = [F.round(F.col(c) / grain).cast("long").alias(f"__{c}") for c in xyz]
    rows = deltas.withColumn("__at", F.struct(*place)).withColumn("__mark", F.when(F.col("operation") == "spawn", True).when((F.col("operation") == "delete") & ~F.coalesce("dormant", F.lit(False)), False))
    before = F.last("__mark", ignorenulls=True).over(ordered([*by, kind, "__at"], order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__stands", F.coalesce(before, F.lit(False))).where("operation != 'spawn' OR NOT __stands").drop("__at", "__mark", "__stands")


def clip_entities(deltas: DataFrame, clips: DataFrame, by: Sequence[str], kind: str, xyz: Sequence[str], width: int, order: Sequence[str] = ("tick", "seq"), on: str = "tick") -> DataFrame:
    """What places the entities of each clip: the spawns up to its end, those before it at its start, and the other changes inside it."""
    rows = standing_once(deltas, by, kind, xyz, order)
    c = clips.select(*by, "clip_id", F.col("start").alias("__start"), F.col("end").alias("__end"))
    spawns = rows.where("operation = 'spawn'").join(c, list(by)).where((F.col(on) <= F.col("__end")) & (F.col("__start") <= F.col("__end")))
    spawns = spawns.withColumn(on, F.greatest(on, "__start")).select("clip_id", *deltas.columns)
    return spawns.unionByName(in_clips(rows.where("operation != 'spawn'"), clips, by, on, width))


def player_states(rows: DataFrame, by: Sequence[str], flags: dict[int, Column], values: Sequence[str], order: Sequence[str] = ("tick", "seq"), on: str = "tick") -> DataFrame:
    """Sparse states of players: rows at which flags (true), known (not null) or values change, and those after a tick without a row."""
    states = rows.withColumns({"flags": bits(flags), "known": bits({bit: value.isNotNull() for bit, value in flags.items()})})
    return changes_only(states, by, order, ["flags", "known", *values], on=on, gap=1)


def side(team: Column) -> Column:
    """T or CT, from names or numbers; null for others."""
    return F.when(F.trim(team).isin("T", "2", "Terrorist"), "T").when(F.trim(team).isin("CT", "3", "Counter-Terrorist"), "CT")


def clip_meta(clips: DataFrame, players: DataFrame, by: Sequence[str], killer: str, columns: Sequence[str], padding: str, player: str = "steamid") -> DataFrame:
    """clip_id, meta: one JSON object per clip of columns, killer_index, padding (0 as -1) and the log's players in the order of their indexes.

    players: by, player, index, name, team, seen_team (of its first row, used where team names no side). A log has some tens of players.
    """
    entry = F.struct("index", F.col(player).cast("string").alias(player), "name", F.coalesce(side(F.col("team")), side(F.col("seen_team")), F.lit("?")).alias("team"))
    listed = players.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("players"))
    rows = indexed(clips, players, by, {killer: "killer_index"}).join(listed, list(by), "left")
    shown = F.struct(*columns, "killer_index", F.when(F.col(padding) == 0, -1).otherwise(F.col(padding)).alias("padding"), F.coalesce("players", F.array().cast(listed.schema["players"].dataType)).alias("players"))
    return rows.select("clip_id", F.to_json(shown).alias("meta"))


def array_faults(df: DataFrame, dense: Sequence[str] = (), size: Column | None = None, offsets: str | None = None, inner: Sequence[str] = ()) -> DataFrame:
    """df with faults: what contradicts itself in arrays of clips.

    Each dense array has `size` values; offsets begin with 0, never fall, have one more place than rows, and end with the size of each inner array. Null arrays are faults.
    """
    checks = [(F.coalesce(F.size(c) != size, F.lit(True)), f"size of {c}") for c in dense]
    if offsets is not None:
        falls = F.exists(F.zip_with(offsets, F.slice(offsets, 2, F.greatest(F.size(offsets), F.lit(1))), lambda a, b: b < a), lambda x: x)
        checks += [
            (F.coalesce(F.size(offsets) != size + 1, F.lit(True)), "number of offsets"),
            (F.coalesce(F.get(offsets, F.lit(0)) != 0, F.lit(True)), "first offset"),
            (F.coalesce(falls, F.lit(False)), "offsets fall"),
            *[(F.coalesce(F.get(offsets, F.size(offsets) - 1) != F.size(c), F.lit(True)), f"end of {c}") for c in inner],
        ]
    return df.withColumn("faults", F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull()))


def weapon_timeline(writes: DataFrame, lifecycle: DataFrame, by: Sequence[str], player: str = "steamid", handle: str = "handle", on: str = "tick", seq: str = "seq") -> DataFrame:
    """Changes of the weapon that each player holds, with its class as of then.

    lifecycle: by, entity, serial, class (null: deleted), on, seq. A handle is the entity in its lower 14 bits and the serial above; it names
    a weapon only if the entity's last life before or at the change has that serial and was not deleted.
    """
    changed = changes_only(writes, [*by, player], [on, seq], [handle]).withColumn("__entity", F.col(handle).bitwiseAND(NO_HANDLE))
    right = lifecycle.select(*by, F.col("entity").cast("long").alias("__entity"), on, seq, F.col("serial").alias("serial"), F.col("class").alias("class"))
    found = asof_join(changed.withColumn("__entity", F.col("__entity").cast("long")), right, [*by, "__entity"], on, ["serial", "class"], tie=seq, prefix="__")
    same = F.shiftright(F.col(handle).cast("long"), 14) == F.col("__serial")
    return found.withColumn("class", F.when(same, F.col("__class"))).drop("__entity", "__serial", "__class")


def clocks(ticks: DataFrame, clips: DataFrame, by: Sequence[str], width: int, time: str = "game_time", on: str = "tick") -> DataFrame:
    """clip_id, tick, time, conflict: the game's clock at each tick of each clip whose rows have a finite one; null and a conflict where rows differ."""
    seen = in_clips(ticks.where(F.abs(F.col(time)) < float("inf")), clips, by, on, width).groupBy("clip_id", on).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    return seen.select("clip_id", on, F.when(F.col("__a") == F.col("__b"), F.col("__a")).alias(time), (F.col("__a") != F.col("__b")).alias("conflict"))


def shake_states(lives: DataFrame, value: str = "last_shake", order: Sequence[str] = ("tick", "seq"), on: str = "tick") -> DataFrame:
    """clip_id, life_id, tick, value of weapon_lives at which it changes: the last row of a tick counts; gone weapons and values that are not finite have none (null)."""
    last = F.max_by(F.when(F.col("present") & (F.abs(F.col(value)) < float("inf")), F.col(value)), F.struct(*order)).alias(value)
    return changes_only(lives.groupBy("clip_id", "life_id", on).agg(last), ["clip_id", "life_id"], [on], [value])


def audio_records(events: DataFrame, clips: DataFrame, by: Sequence[str], width: int, order: Sequence[str] = ("frame_offset", "message_index"), on: str = "tick") -> DataFrame:
    """Sounds of each clip with their place in it (from 0) by the order in which the log holds them; repeated: another sound has the same key."""
    rows = in_clips(events, clips, by, on, width)
    w = ordered(["clip_id"], order)
    twice = F.count("*").over(Window.partitionBy("clip_id", *order)) > 1
    return rows.withColumns({"place": F.row_number().over(w) - 1, "repeated": twice})
