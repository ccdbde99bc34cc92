"""Paint, charms and names of items: first slots, unknown numbers, missing attributes, dictionaries with repeats."""

import math

from pyspark.sql import functions as F

from tickloom.functions.scalars import handle_index
from tickloom.operators import cosmetics

LANE = "entity_id int, serial int, slot int, def_index int, value double, raw long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def attributes(spark, *data):
    return spark.createDataFrame(list(data), LANE)


def test_paints(spark):
    a = attributes(
        spark,
        (1, 0, 2, 6, 44.0, 1), (1, 0, 5, 6, 99.0, 2), (1, 0, 0, 7, 12.9, 3), (1, 0, 1, 8, 0.25, 4),  # the first slot counts, fractions go
        (2, 0, 0, 6, -1.0, 5), (2, 0, 1, 7, math.nan, 6), (2, 0, 2, 8, math.inf, 7),  # none of them is such a number
        (3, 0, 0, 113, 5.0, 8), (4, 0, 0, 6, None, 9), (4, 0, 1, 6, 7.0, 9),  # no look at all; the first has no value
    )
    assert rows(cosmetics.paints(a), "entity_id") == [(1, 0, 44, 12, 0.25), (2, 0, None, None, None), (4, 0, None, None, None)]
    assert cosmetics.paints(a.limit(0)).count() == 0


def test_charms(spark):
    a = attributes(
        spark,
        (1, 0, 0, 299, 0.0, 17), (1, 0, 1, 300, 0.0, 0), (1, 0, 2, 314, 0.0, 9), (1, 0, 3, 322, 0.0, 8),
        (2, 0, 0, 299, 0.0, 0), (2, 0, 1, 300, 0.0, 5), (3, 0, 0, 300, 0.0, 5), (4, 0, 0, 299, 0.0, 3), (4, 0, 9, 299, 0.0, 4),
    )
    assert rows(cosmetics.charms(a), "entity_id") == [(1, 0, 17, 0b1010001, [0, 0, 0, 0, 9, 0, 8]), (4, 0, 3, 0, [0] * 7)]


def test_skins_of_items_and_of_what_is_held(spark):
    a = attributes(spark, (3, 1, 0, 6, 44.0, 0), (3, 2, 0, 6, 45.0, 0), (5, 0, 0, 6, 99.0, 0))
    names = spark.createDataFrame([(44, "Case Hardened"), (45, "b"), (45, "a"), (None, "none")], "id int, name string")
    items = spark.createDataFrame([(3, 1), (3, 2), (5, 0), (7, 0)], "entity_id int, serial int")
    assert rows(cosmetics.skins(items, a, names).select("entity_id", "serial", "paint", "skin"), "entity_id", "serial") == [(3, 1, 44, "Case Hardened"), (3, 2, 45, "a"), (5, 0, 99, None), (7, 0, None, None)]
    held = spark.createDataFrame([(1, 3 + (1 << 14)), (2, 3 + (2 << 14)), (3, 0xFFFFFF), (4, None), (5, 3)], "tick int, handle long")
    got = cosmetics.looks_of_held(held, "handle", a, names, handle_index(F.col("handle")), F.shiftright("handle", 14))
    assert rows(got.select("tick", "handle", "skin"), "tick") == [(1, 3 + (1 << 14), "Case Hardened"), (2, 3 + (2 << 14), "a"), (3, 0xFFFFFF, None), (4, None, None), (5, 3, None)]


def test_agents(spark):
    players = spark.createDataFrame([("f", 7, 1), ("f", 7, 5), ("f", 7, 9), ("f", 8, 5), ("g", 7, 5)], "file string, steamid long, tick int")
    held = spark.createDataFrame([("f", 7, 2, 100), ("f", 7, 8, 4)], "file string, steamid long, tick int, agent_id long")
    names = spark.createDataFrame([(100, "Ava"), (3, "Max")], "id long, name string")
    got = cosmetics.agents(players, held, names, ["file", "steamid"])
    assert rows(got, "file", "steamid", "tick") == [("f", 7, 1, None), ("f", 7, 5, "Ava"), ("f", 7, 9, None), ("f", 8, 5, None), ("g", 7, 5, None)]
