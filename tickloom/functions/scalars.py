"""Scalar column functions of replay lanes: coordinates, bits, names, weapons, paths and text lists.

All are plain column expressions, so they stay inside generated code and push down where Spark can push them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK_RATE = 64

# Fixed values of the log format.
BUTTONS = {
    "FIRE": 1 << 0,
    "JUMP": 1 << 1,
    "DUCK": 1 << 2,
    "FORWARD": 1 << 3,
    "BACK": 1 << 4,
    "USE": 1 << 5,
    "LEFT": 1 << 9,
    "RIGHT": 1 << 10,
    "RIGHTCLICK": 1 << 11,
    "RELOAD": 1 << 13,
    "WALK": 1 << 16,
    "ZOOM": 1 << 34,
    "SCOREBOARD": 1 << 33,
    "INSPECT": 1 << 35,
}
COLORS = {0: "blue", 1: "green", 2: "yellow", 3: "orange", 4: "purple"}
HIT_GROUPS = {0: "generic", 1: "head", 2: "chest", 3: "stomach", 4: "left_arm", 5: "right_arm", 6: "left_leg", 7: "right_leg", 8: "neck", 10: "gear"}
REASONS = {
    0: "still_in_progress",
    1: "bomb_exploded",
    2: "vip_escaped",
    3: "vip_killed",
    4: "t_saved",
    5: "ct_stopped_escape",
    6: "RoundEndReasonTerroristsStopped",
    7: "bomb_defused",
    8: "t_killed",
    9: "ct_killed",
    10: "draw",
    11: "hostage_rescued",
    12: "time_ran_out",
    13: "RoundEndReasonHostagesNotRescued",
    14: "terrorists_not_escaped",
    15: "vip_not_escaped",
    16: "game_start",
    17: "t_surrender",
    18: "ct_surrender",
    19: "t_planted",
    20: "ct_reached_hostage",
}
WINNERS = {1: "T", 4: "CT", 5: "CT", 6: "CT", 7: "CT", 8: "CT", 9: "T", 11: "CT", 12: "CT", 13: "T", 14: "CT", 17: "CT", 18: "T", 19: "CT", 20: "CT"}
COLLECTION_TYPES = {1: "SINGLE", 2: "DOUBLE", 3: "TRIPLE", 4: "QUAD", 5: "ACE"}
INVALID_HANDLE, HANDLE_BITS, NO_GROUND = 0xFFFFFF, 14, 0xFFFFFF
CELL, CELL_ORIGIN = 512, 16384


def mapped(col: Column, names: dict[int, str]) -> Column:
    """The name of a number; the number as text where it has none; null stays null."""
    out = None
    for k, v in names.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return F.coalesce(out, col.cast("string"))


def cell_coord(cell: Column, offset: Column) -> Column:
    """World coordinate of a cell number and the offset in it, as float."""
    return (cell * CELL - CELL_ORIGIN + offset).cast("float")


def distance3d(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def round2(col: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(col, 2)


def is_alive(life_state: Column) -> Column:
    return F.coalesce(life_state == 0, F.lit(False))


def is_airborne(ground: Column) -> Column:
    return F.coalesce(ground == NO_GROUND, F.lit(False))


def button(mask: Column, name: str, fallback: Column | None = None) -> Column:
    """Whether a button's bit is set; where the mask is null the fallback's."""
    source = mask if fallback is None else F.coalesce(mask, fallback)
    return source.cast("long").bitwiseAND(BUTTONS[name]) != 0


def first_mask(*masks: Column) -> Column:
    """The first mask that is there; 0 counts."""
    return F.coalesce(*masks)


def button_names(mask: Column) -> Column:
    """Array of the names of the set bits."""
    each = [F.when(mask.cast("long").bitwiseAND(bit) != 0, F.lit(name)) for name, bit in BUTTONS.items()]
    return F.array_compact(F.array(*each))


def button_edges(state1: Column, state2: Column, state3: Column) -> tuple[Column, Column, Column]:
    """held, pressed, released masks of the three button states."""
    s1, s2, s3 = (c.cast("long") for c in (state1, state2, state3))
    return s1, s3.bitwiseOR(s1.bitwiseAND(s2)), s2.bitwiseAND(F.bitwise_not(s1))


def player_color(col: Column) -> Column:
    return mapped(col, COLORS)


def hit_group(col: Column) -> Column:
    return mapped(col, HIT_GROUPS)


def win_reason(col: Column) -> Column:
    return mapped(col, REASONS)


def reason_text(col: Column) -> Column:
    """A number or a name, as text, to the name."""
    number = col.try_cast("int")
    return F.coalesce(F.when(number.isNotNull(), mapped(number, REASONS)), col)


def winner_of_reason(reason: Column) -> Column:
    """T or CT by the reason's number; else the number as text."""
    return mapped(reason, WINNERS)


def winner(col: Column) -> Column:
    """2 or T → T, 3 or CT → CT, else null."""
    return F.when(col.isin("2", "T"), "T").when(col.isin("3", "CT"), "CT")


def team_name(number: Column) -> Column:
    return F.when(number == 2, "T").when(number == 3, "CT").otherwise("UNKNOWN")


def team_text(col: Column) -> Column:
    low = F.lower(F.trim(col))
    return F.when(low.isin("2", "t", "terrorist", "terrorists"), "T").when(low.isin("3", "ct", "counter-terrorist", "counter-terrorists"), "CT").otherwise("UNKNOWN")


def to_i32(col: Column) -> Column:
    """Whole number as int; null where it does not fit."""
    wide = col.try_cast("long")
    return F.when(wide.between(-(2**31), 2**31 - 1), wide).cast("int")


def observed_flag(col: Column) -> Column:
    """A number that is not negative as boolean, else unknown (null)."""
    return F.when(col >= 0, col != 0)


def known_mask(*flags: Column) -> Column:
    """Bit i is set where flag i is not null."""
    return sum((F.when(f.isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def flag_mask(*flags: Column) -> Column:
    """Bit i is set where flag i is true."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def shot_direction(pitch: Column, yaw: Column) -> tuple[Column, Column, Column]:
    """Unit vector of view angles in degrees; positive pitch looks down."""
    p, y = F.radians(pitch), F.radians(yaw)
    return F.cos(p) * F.cos(y), F.cos(p) * F.sin(y), -F.sin(p)


def ray_offset(origin: tuple[Column, ...], direction: tuple[Column, ...], point: tuple[Column, ...]) -> tuple[Column, Column]:
    """(distance from the ray, distance along it) of a point; null behind the origin. direction: unit vector."""
    to = [p - o for p, o in zip(point, origin)]
    along = sum((t * d for t, d in zip(to, direction)), F.lit(0.0))
    off = F.sqrt(sum(((t - along * d) * (t - along * d) for t, d in zip(to, direction)), F.lit(0.0)))
    return F.when(along >= 0, off), F.when(along >= 0, along)


def eye_height(z: Column, view_offset: Column, duck: Column) -> Column:
    """z of the eyes: the offset where it is known, else 64 less up to 18 by the crouch."""
    return z + F.coalesce(view_offset, 64 - 18 * F.coalesce(duck, F.lit(0.0)))


def handle_index(handle: Column) -> Column:
    """Entity number of a handle; null for the invalid handle."""
    return F.when(handle != INVALID_HANDLE, handle.cast("long").bitwiseAND((1 << HANDLE_BITS) - 1))


def radar(x: Column, y: Column, low: tuple[float, float], high: tuple[float, float], size: int = 1024, padding: float = 1.3) -> tuple[Column, Column]:
    """World to picture: padded bounds, y downwards."""
    span = max(high[0] - low[0], high[1] - low[1]) * padding
    mid = [(a + b) / 2 for a, b in zip(low, high)]
    return (x - (mid[0] - span / 2)) / span * size, ((mid[1] + span / 2) - y) / span * size


def quantised(col: Column, scale: float) -> Column:
    """col times scale, rounded and clamped to 16 bits."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(col * scale))).cast("int")


def angle16(degrees: Column) -> Column:
    """Degrees, wrapped to [-180, 180), as 16 bits."""
    wrapped = F.pmod(degrees + 180, F.lit(360.0)) - 180
    return quantised(wrapped, 32768 / 180)


def clean_weapon(col: Column) -> Column:
    return F.regexp_replace(col, "^weapon_", "")


def canonical_name(path: Column) -> Column:
    """File name in lower case without archive and log endings."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    return F.regexp_replace(name, r"(\.dem)?(\.gz|\.zst|\.bz2)?$", "")


def is_log_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.dem(\.gz|\.zst|\.bz2)?$")


def stem(path: Column) -> Column:
    """File name without archive and log endings; other dots stay."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(\.dem)?(\.gz|\.zst|\.bz2)?$", "")


def parent_folder(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def text_list(col: Column) -> Column:
    """"[a;b]" or "a;b" as array of ints; elements that are none are left out."""
    parts = F.split(F.regexp_replace(col, r"[\[\]\s]", ""), ";")
    return F.array_compact(F.transform(parts, lambda x: x.try_cast("int")))


def list_text(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ";")


def float_list_text(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: F.format_string("%.6f", x.cast("double"))), ";")


def tags_text(tags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]"))


def text_tags(text: Column) -> Column:
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[|\]$", "")
    return F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x)))


def tag_added(text: Column, tag: str) -> Column:
    return tags_text(F.array_union(text_tags(text), F.array(F.lit(tag))))


def tag_removed(text: Column, tag: str) -> Column:
    return tags_text(F.array_except(text_tags(text), F.array(F.lit(tag))))


def seconds_text(ticks: Column) -> Column:
    """One decimal, halves to the even digit."""
    return F.format_string("%.1fs", F.bround(ticks / TICK_RATE, 1))


def percent_text(rate: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(rate * 100, 1))


def game_time(net_tick: Column) -> Column:
    return net_tick / TICK_RATE


def seconds_each(seconds: Column, items: Column) -> Column:
    return F.try_divide(seconds, items)


def match_id(url: Column) -> Column:
    """The id of the form 1-<uuid> or the run of digits that ends a match address; null without one."""
    found = F.regexp_extract(url, r"(1-[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d+)/?(?:[?#].*)?$", 1)
    return F.when(found != "", found)


def collection_type(n: Column) -> Column:
    out = None
    for k, v in COLLECTION_TYPES.items():
        out = F.when(n == k, v) if out is None else out.when(n == k, v)
    return out


def json_value(col: Column) -> Column:
    return F.to_json(F.struct(col.alias("value")))
