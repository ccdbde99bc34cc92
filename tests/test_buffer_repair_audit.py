"""The two-phase buffer as a stream, catalog repair from a listing, mergeable statistics, ordered folds, predicates."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import audit, folds
from tickloom.plans import catalog, repair
from tickloom.query import LogDataset, LogQuery, Predicate
from tickloom.streaming import buffer

PHASES = "demo string, num int, phase int, value string, total int, at string"


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def test_two_phases(spark, tmp_path):
    """Parts in any order, repeated, late, missing, and after the demo has left."""
    batches = [
        [("a", 1, 2, "a1 ticks", None, at(0)), ("a", 1, 1, "a1", 2, at(0)), ("b", 1, 1, "b1", 1, at(0)), ("c", 1, 1, "c1", 3, at(0)), ("d", 1, 1, "old", None, at(0)), ("d", 1, 2, "old ticks", None, at(0))],
        [("a", 2, 1, "a2", None, at(1)), ("a", 2, 1, "a2 again", None, at(1)), ("c", 1, 2, "c1 ticks", None, at(1)), ("d", 1, 1, "new", 1, at(1))],
        [("a", 2, 2, None, None, at(2)), ("b", 1, 2, "b1 ticks", None, at(2)), ("d", 1, 2, "new ticks", None, at(2))],
        [("z", 1, 1, "later", 2, at(200)), ("c", 2, 1, "too late", None, at(3))],
        [("b", 1, 2, "after", None, at(201))],
        [("z", 2, 1, "end", None, at(900))],
    ]
    source = tmp_path / "in"
    before = spark.conf.get(buffer.STORE[0])
    spark.conf.set(*buffer.STORE)
    try:
        for k, rows in enumerate(batches):
            df = spark.createDataFrame(rows, PHASES).withColumn("ts", F.to_timestamp("at")).drop("at")
            df.coalesce(1).write.mode("append").parquet(str(source))
            q = buffer.buffered(spark.readStream.schema(df.schema).parquet(str(source)), wait_ms=30 * 60_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.set(buffer.STORE[0], before)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = [
        *[("a", 1, "a1", "a1 ticks", "complete", 2, 2), ("a", 2, "a2 again", None, "complete", 2, 2), ("b", 1, "b1", "b1 ticks", "complete", 1, 1), ("d", 1, "new", "new ticks", "complete", 1, 1)],
        *[("c", 1, "c1", "c1 ticks", "complete", 1, 3), ("c", 2, "too late", None, "expired", 1, 3), ("b", 1, None, "after", "expired", 0, 1)],
    ]
    assert got == sorted(want, key=str)  # z still waits


def test_repair(spark, tmp_path):
    for name, size in {"x/One_r1.dem": 5, "x/one_r2.dem": 7, "x/two_r03.dem": 2, "y/two_r3.dem": 2, "y/three.dem.gz": 9, "y/four_r9.dem": 4, "y/notes.txt": 1, "y/five_r0.dem": 3}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = repair.listing(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and files.count() == 8
    clips = repair.clips(files)
    assert sorted((r["demo"], r["round"], r["size"]) for r in clips.collect()) == [("four", 9, 4), ("one", 1, 5), ("one", 2, 7), ("two", 3, 2), ("two", 3, 2)]
    assert sorted(r["demo"] for r in repair.sources(files).collect()) == ["five_r0", "three"]
    collections = spark.createDataFrame([("one", 1), ("one", 2), ("two", 3), ("six", 1), ("seven", 1), ("nine", 1)], "demo string, round int")
    assets = spark.createDataFrame(
        [("one", 1, 5, "complete", "keep"), ("one", 2, 6, "complete", "note"), ("two", 3, 2, "complete", None), ("six", 1, 8, "complete", None), ("eight", 1, 8, "complete", None)], "demo string, round int, size long, status string, tag string"
    )
    found = repair.reconciled(collections, assets, clips, ["demo", "round"])
    assert {(r["demo"], r["round"]): r["action"] for r in found.collect()} == {
        ("one", 1): "current", ("one", 2): "fix", ("two", 3): "ambiguous", ("six", 1): "delete", ("seven", 1): "missing", ("nine", 1): "missing", ("eight", 1): "delete", ("four", 9): "stray"
    }
    (tmp_path / "y" / "seven_r1.dem").write_bytes(b"123")
    clips = repair.clips(repair.listing(spark, str(tmp_path)))
    found = repair.reconciled(collections, assets, clips, ["demo", "round"])
    got = repair.repaired(assets, found, clips, ["demo", "round"])
    assert sorted(map(tuple, got.collect())) == [("one", 1, 5, "complete", "keep"), ("one", 2, 7, "complete", "note"), ("seven", 1, 3, "complete", None), ("two", 3, 2, "complete", None)]
    # after the repair, nothing is left to add, fix or delete but what was not done by intent
    again = {r["action"] for r in repair.summary(repair.reconciled(collections, got, clips, ["demo", "round"])).collect()}
    assert again == {"current", "ambiguous", "missing", "stray"}
    assert catalog.unique(got, ["demo", "round"]).count() == 0
    none = repair.listing(spark, str(tmp_path), "*.nothing")
    assert repair.reconciled(collections.limit(0), assets.limit(0), repair.clips(none), ["demo", "round"]).collect() == []


def test_audit_merges_in_any_order(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(f"f{r.randint(0, 6)}", r.choice("AB"), r.randint(0, 999), r.randint(0, 300), r.choice([*audit.MARKS, None]), r.choice([None, r.random()])) for _ in range(3000)], "file string, class string, tick long, entity_id long, mark string, x double")
    whole = audit.partial(rows, ["class"], extents=["x"])
    parts = audit.partial(rows, ["file", "class"], extents=["x"])
    flat = lambda df: sorted((tuple(x) for x in audit.estimated(df).collect()), key=str)
    once = audit.merged(parts, ["class"]).select(*whole.columns)
    some, others = parts.where("file < 'f3'"), parts.where("file >= 'f3'")
    halves = audit.merged(others, ["class"]).unionByName(audit.merged(some, ["class"]))
    assert flat(once) == flat(whole) == flat(audit.merged(halves, ["class"]).select(*whole.columns))
    exact = {x["class"]: x["n"] for x in rows.groupBy("class").agg(F.count_distinct("entity_id").alias("n")).collect()}
    assert all(abs(x["entities"] - exact[x["class"]]) <= 0.05 * exact[x["class"]] for x in audit.estimated(whole).collect())


def test_frames_equal_a_plain_loop(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), t // 2, t, r.choice([None, t // 9]), r.choice([None, b"", bytes([t % 256]) * r.randint(1, 3)])) for t in range(900)]
    want = []
    for life in (1, 2, 3, None):
        seen, held = None, b""
        for k, tick, _, counter, chunk in rows:
            if k == life:
                held += chunk or b""
                if counter is not None and counter != seen:
                    seen = counter
                    want.append((life, tick, counter, len(held), held))
    chunks = spark.createDataFrame(rows, "life int, tick int, seq int, counter int, payload binary").repartition(7)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a life is spread over many batches
    try:
        got = [(x["life"], x["tick"], x["counter"], x["size"], bytes(x["payload"])) for x in folds.frames(chunks).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        sizes = [tuple(x) for x in folds.frame_sizes(chunks).select("life", "tick", "counter", "size").collect()]
        assert sorted(sizes, key=str) == sorted((w[:4] for w in want), key=str)
        assert folds.frames(chunks.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_predicate(spark, tmp_path):
    data = [(1, 7, "a", 1.0, 5), (2, 7, "a", None, 5), (3, 8, "b", 9.0, 5), (4, 8, "b", 7.0, None)]
    spark.createDataFrame(data, "tick int, steamid long, name string, x double, y int").write.parquet(str(tmp_path / "ticks"))
    log = LogDataset({"ticks": lambda: spark.read.parquet(str(tmp_path / "ticks"))})
    assert_only = lambda frame: frame["x"] > 2 if list(frame.columns) == ["x"] else 1 / 0
    ticks = lambda p, **q: sorted(r["tick"] for r in log.ticks(LogQuery(predicate=p, **q)).collect())
    assert ticks(Predicate(["x"], assert_only)) == [3, 4]
    assert ticks(Predicate(["x"], assert_only, nulls="keep")) == [2, 3, 4]
    assert ticks(Predicate(["x", "y"], lambda f: f["x"] > f["y"])) == [3]
    assert ticks(Predicate(["x"], lambda f: f["x"] / 0 if 1 / 0 else f, errors="drop")) == []
    with pytest.raises(Exception, match="ZeroDivisionError"):
        ticks(Predicate(["x"], lambda f: 1 / 0))
    plan = log.ticks(LogQuery(columns=["tick"], players=[8], predicate=Predicate(["x"], assert_only)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(steamid), EqualTo(steamid,8)]" in plan and "y:int" not in plan
