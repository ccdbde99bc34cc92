"""State, lifetimes and derived events of a change lane."""

from pyspark.sql import functions as F

from tickloom.operators import derived, entities


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def changes(spark, data):
    return spark.createDataFrame([("f", *r) for r in data], "file string, seq long, tick int, entity_id int, serial int, prop string, value string")


def test_state_and_deltas(spark):
    df = changes(spark, [(1, 1, 5, 0, "hp", "100"), (2, 1, 5, 0, "x", "1.5"), (3, 2, 5, 0, "hp", "100"), (4, 3, 5, 0, "hp", "90"), (5, 3, 5, 1, "hp", "100")])
    state = entities.wide_state(df, {"hp": "int", "x": "double"})
    assert rows(entities.per_tick(state).select("serial", "tick", "hp", "x"), "serial", "tick") == [(0, 1, 100, 1.5), (0, 2, 100, 1.5), (0, 3, 90, 1.5), (1, 3, 100, None)]
    assert rows(entities.deltas(state, ["hp", "x"]).select("serial", "tick", "op"), "serial", "tick") == [(0, 1, "spawn"), (0, 3, "update"), (1, 3, "spawn")]


def test_lifetimes(spark):
    df = spark.createDataFrame([(5, 0, 1, "create"), (5, 0, 2, "update"), (5, 0, 9, "delete"), (5, 1, 10, "create")], "entity_id int, serial int, tick int, mark string")
    assert rows(entities.lifetimes(df), "serial") == [(5, 0, 1, 9, "delete", 1), (5, 1, 10, 10, None, 0)]


def test_handles_and_inventory(spark):
    pawns = spark.createDataFrame([(1, 3, [2, 3, 2]), (2, 0xFFFFFF, []), (5, 0x4003, [9])], "tick int, weapon long, items array<long>")
    weapons = spark.createDataFrame([(3, 0, "ak47"), (3, 4, "awp")], "entity_id int, tick int, name string")
    assert rows(entities.dereferenced(pawns, "weapon", weapons, ["name"]).select("tick", "name"), "tick") == [(1, "ak47"), (2, None), (5, "awp")]
    items = spark.createDataFrame([(2, "knife"), (3, "ak47")], "entity_id int, name string")
    assert rows(entities.inventory(pawns, "items", items, ["tick"]).select("tick", "inventory"), "tick") == [(1, ["knife", "ak47"]), (2, []), (5, [])]


def test_stickers_projectiles_teams(spark):
    a = spark.createDataFrame([(1, 0, 113, 77), (1, 0, 114, 5), (1, 0, 278, 9), (1, 0, 118, 4)], "entity_id int, serial int, def_index int, raw long")
    assert rows(entities.stickers(a), "slot") == [(1, 0, 0, 77, 5, None, None, 9, None)]
    p = spark.createDataFrame([(4, "CSmokeGrenadeProjectile", 3), (4, "CPlantedC4", 3), (5, "CFlashbangProjectile", 0xFFFFFF)], "tick int, class string, owner long")
    owners = spark.createDataFrame([(3, 1, 70, "Ann")], "entity_id int, tick int, steamid long, name string")
    assert rows(entities.projectiles(p, owners).select("tick", "thrower_steamid"), "tick") == [(4, 70)]
    teams = spark.createDataFrame([(2, 1, "A"), (3, 1, "B"), (2, 9, "C")], "team_num int, tick int, clan string")
    assert rows(entities.team_pivot(spark.createDataFrame([(5,), (10,)], "tick int"), teams, ["clan"]), "tick") == [(5, "A", "B"), (10, "C", "B")]


def test_round_events(spark):
    data = [(1, 0, 1, 0, "round_start_count", "0"), (2, 0, 1, 0, "round_end_count", "0"), (3, 5, 1, 0, "round_start_count", "1"), (4, 9, 1, 0, "round_win_reason", "9"), (5, 9, 1, 0, "round_end_count", "1"), (6, 9, 1, 0, "rounds_played", "1"), (7, 20, 1, 0, "round_start_count", "2")]
    got = derived.round_events(changes(spark, data)).select("tick", "name", F.col("fields")["round"], F.col("fields")["winner"])
    assert rows(got, "tick", "name") == [(5, "round_start", "1", None), (9, "round_end", "0", "T"), (20, "round_officially_ended", None, None), (20, "round_start", "2", None)]


def test_purchases(spark):
    df = spark.createDataFrame([("f", 1, 0, 1, 1, "def", "7"), ("f", 1, 0, 1, 2, "cost", "2700"), ("f", 1, 0, 1, 2, "health", "90"), ("f", 1, 0, 1, 3, "handle", "55"), ("f", 1, 0, 9, 4, "count", "0")], "file string, steamid long, slot int, tick int, seq long, prop string, value string")
    assert rows(derived.purchases(df).select("tick", "name", "def_index", "cost", "handle"), "tick") == [(1, "item_purchase", 7, 2700, 55), (9, "item_sold", None, None, None)]
