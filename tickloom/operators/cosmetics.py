"""Looks of items and players: paint, charms and the names of both, out of attribute lanes and dictionaries of the caller.

An attribute lane has an item's keys, slot (the attribute's place), def_index, value (a double) and raw (the same 32 bits as a number).
Of attributes with equal definitions the one in the first slot counts. An item costs one row in one shuffle, whatever it carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .entities import IDENTITY

# Fixed values of the log format: definitions of paint, seed and wear, of a charm, and of what else may be known of the charm.
PAINT, SEED, WEAR = 6, 7, 8
CHARM = 299
CHARM_PARTS = (300, 301, 302, 306, 314, 321, 322)


def attribute(definition: int, value: str, slot: str = "slot") -> Column:
    """An aggregate: the value of the first attribute with this definition; null without one."""
    here = F.col("def_index") == definition
    return F.min_by(F.when(here, F.col(value)), F.when(here, F.col(slot)))


def whole(value: Column) -> Column:
    """A number that is finite and not negative, without its fraction, as a long; others are unknown."""
    fits = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < 2.0**63)
    return F.when(fits, F.floor(value)).cast("long")


def paints(attributes: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """keys, paint, seed and wear of each item that has an attribute; what is not there or no such number is null."""
    found = attributes.where(F.col("def_index").isin(PAINT, SEED, WEAR)).groupBy(*keys).agg(*[attribute(d, "value").alias(f"__{d}") for d in (PAINT, SEED, WEAR)])
    wear = F.col(f"__{WEAR}").cast("float")
    finite = ~F.isnan(wear) & (F.abs(wear) < F.lit(float("inf")))
    return found.select(*keys, whole(F.col(f"__{PAINT}")).alias("paint"), whole(F.col(f"__{SEED}")).alias("seed"), F.when(finite, wear).alias("wear"))


def charms(attributes: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """keys, charm, known and parts of each item with a charm (an id that is not 0).

    parts has one number per part, 0 where it is unknown; bit i of known says whether part i is there, so that an own 0 is told apart.
    """
    wanted = attributes.where(F.col("def_index").isin(CHARM, *CHARM_PARTS))
    found = wanted.groupBy(*keys).agg(attribute(CHARM, "raw").alias("charm"), *[attribute(d, "raw").alias(f"__{d}") for d in CHARM_PARTS]).where("charm <> 0")
    known = sum((F.when(F.col(f"__{d}").isNotNull(), 1 << i).otherwise(0) for i, d in enumerate(CHARM_PARTS)), F.lit(0))
    parts = F.array(*[F.coalesce(F.col(f"__{d}"), F.lit(0)).cast("long") for d in CHARM_PARTS])
    return found.select(*keys, "charm", known.alias("known"), parts.alias("parts"))


def named(df: DataFrame, column: str, names: DataFrame, to: str) -> DataFrame:
    """df with the name of the id in `column`; unknown ids and nulls give null. names: id, name; of repeated ids the least name counts."""
    one = names.groupBy(F.col("id").alias("__id")).agg(F.min("name").alias("__name"))
    return df.join(one, F.col(column) == F.col("__id"), "left").select(*df.columns, F.col("__name").alias(to))


def skins(df: DataFrame, attributes: DataFrame, names: DataFrame, keys: Sequence[str] = IDENTITY, to: str = "skin") -> DataFrame:
    """df (weapons, or the pawns whose gloves count) with paint, seed, wear and the paint's name."""
    painted = df.join(paints(attributes, keys), list(keys), "left")
    return named(painted, "paint", names, to)


def agents(players: DataFrame, controllers: DataFrame, names: DataFrame, keys: Sequence[str], on: str = "tick", prop: str = "agent_id", to: str = "agent") -> DataFrame:
    """players with the name of the agent that their controller holds as of the row. controllers: keys, on, prop."""
    held = asof_join(players, controllers, list(keys), on, [prop], prefix="held_")
    return named(held, f"held_{prop}", names, to).drop(f"held_{prop}")


def looks_of_held(df: DataFrame, handle: str, attributes: DataFrame, names: DataFrame, index: Column, serial: Column | None = None) -> DataFrame:
    """df with the looks of the item that a handle points to. index, serial: entity number and serial number of the handle; a null handle has none."""
    keys = ["entity_id"] + ([] if serial is None else ["serial"])
    parts = {"entity_id": index} | ({} if serial is None else {"serial": serial})
    rows = df.withColumns({f"__{k}": F.when(F.col(handle).isNotNull(), c).cast("long") for k, c in parts.items()})
    items = paints(attributes, keys).select(*[F.col(k).cast("long").alias(f"__{k}") for k in keys], "paint", "seed", "wear")
    return named(rows.join(items, [f"__{k}" for k in keys], "left"), "paint", names, "skin").drop(*[f"__{k}" for k in keys])
