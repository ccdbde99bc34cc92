"""Pose recipes: one row per tick that changed something, bytes set one by one, by length and whole, many lives over small batches."""

from tickloom.operators import folds

LANE = "life long, tick long, seq long, field string, slot int, place int, number long, payload binary"


def snapshots(spark, data):
    got = folds.recipes(spark.createDataFrame([(*r[:2], i, *r[2:]) for i, r in enumerate(data)], LANE)).orderBy("life", "tick").collect()
    return [(r["life"], r["tick"], r["recipe_version"], [bytes(t) for t in r["topologies"]], bytes(r["dynamic"])) for r in got]


def test_nothing_before_both_kinds_of_bytes(spark):
    data = [(1, 1, "recipe_version", None, None, 3, None), (1, 2, "dynamic", None, 1, 7, None), (1, 2, "dynamic", None, None, 0, None), (1, 3, "topology", 0, None, None, b"ab"), (1, 4, "dynamic", None, 1, 9, None)]
    assert snapshots(spark, data) == [(1, 4, 3, [b"ab"], b"\x00\x09")]


def test_last_state_of_a_tick(spark):
    start = [(1, 1, "topology", 2, None, None, b"xyz"), (1, 1, "dynamic", None, None, None, b"q")]
    data = start + [(1, 5, "dynamic", None, 0, 1, None), (1, 5, "dynamic", None, 0, 2, None), (1, 6, "health", None, None, 5, None), (1, 8, "recipe_version", None, None, 4, None), (1, 8, "recipe_version", None, None, None, None)]
    assert snapshots(spark, data) == [(1, 1, None, [b"", b"", b"xyz"], b"q"), (1, 5, None, [b"", b"", b"xyz"], b"\x02"), (1, 8, None, [b"", b"", b"xyz"], b"\x02")]


def test_lengths(spark):
    data = [
        (1, 1, "dynamic", None, None, 2, None), (1, 1, "topology", 0, 0, 65, None), (1, 2, "topology", 0, 2, 67, None), (1, 3, "topology", 0, None, 4, None), (1, 4, "topology", 0, None, 1, None),
        (1, 5, "dynamic", None, None, 5000, None), (1, 6, "dynamic", None, 4096, 1, None), (1, 7, "dynamic", None, 1, 256, None), (1, 8, "topology", 0, None, None, b"z" * 4097), (1, 9, "topology", None, 0, 1, None),
    ]
    tops = [b"A", b"A", b"A\x00C\x00", b"A", b"A", b"A", b"A", b"A"]
    assert snapshots(spark, data) == [(1, t, None, [top], b"\x00\x00") for t, top in enumerate(tops, 1)]


def test_a_slot_that_no_recipe_has_hides_the_rest(spark):
    data = [(1, 1, "dynamic", None, None, None, b"q"), (1, 1, "topology", 63, None, None, b"t"), (1, 2, "topology", 64, None, None, b"t"), (1, 3, "dynamic", None, 0, 1, None)]
    assert [r[:2] for r in snapshots(spark, data)] == [(1, 1)]


def test_lives_keep_apart_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [r for life in range(20) for r in [(life, 1, "topology", 0, None, None, b"t"), *[(life, k, "dynamic", None, k % 4, life, None) for k in range(1, 9)]]]
        got = snapshots(spark, data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 160 and all(len(r[4]) <= 4 and set(r[4]) <= {0, r[0]} for r in got)
    assert snapshots(spark, []) == []
