"""Names and numbers of weapons, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log format: a weapon's clean name and its item definition.
WEAPON_IDS = {
    "deagle": 1, "elite": 2, "fiveseven": 3, "glock": 4, "ak47": 7, "aug": 8, "awp": 9, "famas": 10, "g3sg1": 11, "galil": 13, "galilar": 13, "m249": 14, "m4a1": 16, "m4a4": 16, "mac10": 17, "p90": 19,
    "mp5sd": 23, "ump45": 24, "xm1014": 25, "bizon": 26, "mag7": 27, "negev": 28, "sawedoff": 29, "tec9": 30, "taser": 31, "hkp2000": 32, "mp7": 33, "mp9": 34, "nova": 35, "p250": 36, "scar20": 38, "sg556": 39,
    "ssg08": 40, "knife": 42, "flashbang": 43, "hegrenade": 44, "smokegrenade": 45, "molotov": 46, "decoy": 47, "incgrenade": 48, "inferno": 48, "knife_t": 59, "m4a1_silencer": 60, "usp_silencer": 61, "cz75a": 63, "revolver": 64,
}
#: Classes of thrown things and the beginnings and names of their events (fixed values).
UTILITY_CLASSES = ("CFlashbangProjectile", "CHEGrenadeProjectile", "CSmokeGrenadeProjectile", "CMolotovProjectile", "CDecoyProjectile", "CInferno")
UTILITY_PREFIXES = ("decoy_", "inferno_", "smokegrenade_", "flashbang_", "hegrenade_", "molotov_", "incgrenade_", "grenade_")
UTILITY_EVENTS = ("player_blind", "player_hurt")


def weapon_name(name: Column) -> Column:
    """Lower case, without blanks around and the prefix `weapon_`."""
    return F.regexp_replace(F.lower(F.trim(name)), "^weapon_", "")


def weapon_id(name: Column) -> Column:
    """The number of a name in any of its spellings; 0 where it is unknown or null."""
    known = F.create_map(*[F.lit(x) for pair in WEAPON_IDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, weapon_name(name)), F.lit(0))


def weapon_id_or(raw: Column, name: Column) -> Column:
    """The number that the log gives, if it is above 0, else that of the name, else 0. Numbers of the log are taken as they are."""
    return F.when(raw > 0, raw.cast("int")).otherwise(weapon_id(name))


def is_utility_class(name: Column) -> Column:
    return name.isin(*UTILITY_CLASSES)


def is_utility_event(name: Column) -> Column:
    return name.rlike("^(" + "|".join(UTILITY_PREFIXES) + ")") | name.isin(*UTILITY_EVENTS)


def original_owner(high: Column, low: Column) -> Column:
    """The account number that two 32-bit halves hold, as decimal text; null if one is missing."""
    unsigned = lambda c: c.cast("long").bitwiseAND(0xFFFFFFFF).cast("decimal(20,0)")
    return (unsigned(high) * F.lit(1 << 32).cast("decimal(20,0)") + unsigned(low)).cast("decimal(20,0)").cast("string")
