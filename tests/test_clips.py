"""Clips, lives and overlaps against plain loops, with hot logs, empty and touching ranges, nulls and ties."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import clips, intervals

LANE = "log string, who int, tick long, seq long, alive boolean, life int"


def made(seed, n=400, logs="abc"):
    r = random.Random(seed)
    # most rows are of one log, and many of one moment
    rows = [(r.choice([logs[0]] * 6 + list(logs)), r.randint(1, 4), r.choice([500, r.randint(0, 1000)]), s, r.random() < 0.8, r.randint(0, 1)) for s in range(n)]
    rows += [(None, 1, 500, n, True, 0), ("a", None, 499, n + 1, True, 0)]
    spans = [(i, r.choice([*logs, None]), t := r.randint(0, 900), t + r.randint(-5, 300)) for i in range(60)] + [(98, "a", 500, 500), (99, "a", 0, 1000)]
    return rows, spans


@pytest.mark.parametrize("width, salts", [(100, 1), (7, 3), (5000, 8)])
def test_clip_lane(spark, width, salts):
    rows, spans = made(width)
    lane, windows = spark.createDataFrame(rows, LANE), spark.createDataFrame(spans, "clip_id int, log string, start long, end long")
    inside = sorted((c, s) for c, log, lo, hi in spans for l, _, t, s, *_ in rows if log is not None and l == log and lo <= t <= hi)
    assert sorted((r["clip_id"], r["seq"]) for r in clips.in_clips(lane, windows, ["log"], "tick", width, salts).collect()) == inside

    seeds = {}
    for c, log, lo, _ in spans:
        for row in rows:
            if log is not None and row[0] == log and row[2] < lo:
                seeds[c, row[1]] = max(seeds.get((c, row[1]), row), row, key=lambda x: (x[2], x[3]))
    live = {k: v for k, v in seeds.items() if v[4] and k[1] is not None}
    got = clips.clip_seeds(lane, windows, ["log"], ["who"], "tick", tie="seq", ended=~F.col("alive")).where("who IS NOT NULL").collect()
    starts = {c: lo for c, _, lo, _ in spans}
    assert {(r["clip_id"], r["who"]): (r["seq"], r["tick"]) for r in got} == {k: (v[3], starts[k[0]]) for k, v in live.items()} and len(got) == len(live)

    whole = clips.clip_lane(lane, windows, ["log"], ["who"], "tick", width, tie="seq", life="life", salts=salts).where("who IS NOT NULL").collect()
    first = {}
    for c, log, lo, hi in spans:
        for row in rows:
            if log is not None and row[0] == log and lo <= row[2] <= hi:
                first[c, row[1]] = min(first.get((c, row[1]), row), row, key=lambda x: (x[2], -x[5]))
    wanted = {(c, w) for (c, w), v in seeds.items() if w is not None and ((c, w) not in first or first[c, w][2] > starts[c] and first[c, w][5] == v[5])}
    assert {(r["clip_id"], r["who"]) for r in whole if r["seeded"]} == wanted
    assert sorted((r["clip_id"], r["seq"]) for r in whole if not r["seeded"]) == [x for x in inside if rows[x[1]][1] is not None]


@pytest.mark.parametrize("salts", [1, 4])
def test_clip_history(spark, salts):
    rows, spans = made(3)
    lane, windows = spark.createDataFrame(rows, LANE), spark.createDataFrame(spans, "clip_id int, log string, start long, end long")
    over = {}
    for l, w, t, _, alive, _ in rows:
        if not alive:
            over[l, w] = min(over.get((l, w), t), t)
    want = sorted((c, s) for c, log, lo, hi in spans for l, w, t, s, *_ in rows if log is not None and lo <= hi and l == log and t <= hi and over.get((l, w), lo + 1) > lo)
    assert sorted((r["clip_id"], r["seq"]) for r in clips.clip_history(lane, windows, ["log"], "tick", ["who"], ~F.col("alive"), salts).collect()) == want
    assert clips.clip_history(lane, windows, ["log"], "tick").count() >= len(want)


def test_a_hot_bucket_is_split(spark):
    """All rows in one log and bucket: with salts, several tasks hold them."""
    lane = spark.range(4000).select(F.lit("a").alias("log"), (F.col("id") % 10).alias("tick"), F.col("id").alias("seq"))
    windows = spark.createDataFrame([(1, "a", 0, 20), (2, "a", 5, 5)], "clip_id int, log string, start long, end long")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = clips.in_clips(lane, windows, ["log"], "tick", 100, salts=8)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 4400 and max(sizes) < 2200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lives(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), t, s, r.choice([True, True, False, None]), r.choice([1, 1, None])) for s, t in enumerate(sorted(r.choices(range(60), k=120)))]
    want = []
    for key in "ab":
        life, now = 0, None
        for k, t, _, alive, agent in rows:
            if k != key:
                continue
            if now and (not alive or agent != now[3]):
                want.append((*now[:3], t, now[3]))
                now = None
            if alive and not now:
                now, life = (key, life, t, agent), life + 1
        if now:
            want.append((*now[:3], 99, now[3]))
    df = spark.createDataFrame(rows, "k string, tick int, seq int, alive boolean, agent int")
    got = intervals.lives(df, ["k"], ["tick", "seq"], F.col("alive"), ["agent"], F.lit(99)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert intervals.lives(df.limit(0), ["k"], ["tick"], F.col("alive")).collect() == []


@pytest.mark.parametrize("width, salts", [(1, 1), (13, 3), (1000, 2)])
def test_overlaps_equal_all_pairs(spark, width, salts):
    r = random.Random(width)
    some = lambda n: [(r.choice(["a", "a", "b", None]), i, t := r.randint(-50, 100), t + r.choice([0, -3, 1, 2, 60])) for i in range(n)]
    a, b = some(80), some(90)
    want = sorted((k, i, j, max(s, t), min(e, f)) for k, i, s, e in a for m, j, t, f in b if k is not None and k == m and s < e and t < f and s < f and t < e)
    left, right = spark.createDataFrame(a, "k string, i int, start long, end long"), spark.createDataFrame(b, "k string, j int, start long, end long")
    got = intervals.overlaps(left, right, ["k"], width, ["j"], salts=salts).select("k", "i", "j", "start", "end").collect()
    assert sorted(map(tuple, got)) == want
