"""Late column types, events out of state in one pass, deferred events."""

import random

from pyspark.sql import functions as F

from tickloom.operators import derived
from tickloom.sources import parts


def test_append_takes_the_first_type(spark, tmp_path):
    a = spark.createDataFrame([(1, None, None)], "id int, x string, y int")
    b = spark.createDataFrame([(2, 2.5, 7)], "id int, x double, y int")
    c = spark.createDataFrame([(3, "text", None)], "id int, x string, z string")
    d = spark.createDataFrame([(4, True)], "id int, w boolean").withColumn("x", F.lit(None))
    for name, df in zip("abc", (a, b, c)):
        df.write.parquet(str(tmp_path / name))
    got = parts.read_parts(spark, [str(tmp_path / n) for n in "abc"])
    assert dict(got.dtypes) == {"id": "int", "x": "double", "y": "int", "z": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == [(1, None, None, None), (2, 2.5, 7, None), (3, None, None, None)]
    got = parts.append([d, c, b])  # void first, then text, then a number
    assert dict(got.dtypes) == {"id": "int", "w": "boolean", "x": "string", "z": "string", "y": "int"}
    assert {r["id"]: r["x"] for r in got.collect()} == {4: None, 3: "text", 2: None}
    assert dict(parts.append([a.limit(0), b]).dtypes)["x"] == "double"  # no rows: no type
    assert dict(parts.append([a, a]).dtypes)["x"] == "string" and parts.append([d.select("x"), d.select("x")]).dtypes == [("x", "void")]


def test_long_form_agrees_with_append(spark):
    r = random.Random(4)
    rows = [(p, s, prop, r.choice(["int", "float"]), r.choice([None, str(s)])) for s, (p, prop) in enumerate((r.randint(0, 5), r.choice("abc")) for _ in range(200))]
    own = {}
    for p, s, prop, kind, value in sorted(rows):
        if value is not None:
            own.setdefault(prop, kind)
    got = parts.by_first_type(spark.createDataFrame(rows, "part int, seq int, prop string, type string, value string"), "part", ["seq"]).collect()
    assert {r["seq"]: (r["type"], r["value"]) for r in got} == {s: (own[prop], value if kind == own[prop] else None) for p, s, prop, kind, value in rows}


def test_backfilled(spark):
    df = spark.createDataFrame([("f", 1, None), ("f", 2, 5), ("f", 3, None), ("g", 1, None)], "file string, tick int, x int")
    assert {(r["file"], r["tick"]): r["x_typed"] for r in parts.backfilled(df, ["file"], ["tick"], ["x"]).collect()} == {("f", 1): False, ("f", 2): True, ("f", 3): True, ("g", 1): False}


def test_one_pass_makes_the_rows_of_the_single_kinds(spark, tmp_path):
    r = random.Random(6)
    data = [(r.choice("xy"), t // 3, t, r.choice([1, 2]), r.choice([0, 1]), r.choice([*derived.RULES, *derived.SLOT, "player_name", "other"]), r.choice(["0", "1", "2", "bad", None])) for t in range(3000)]
    spark.createDataFrame(data, "file string, tick int, seq int, steamid int, slot int, prop string, value string").write.parquet(str(tmp_path / "changes"))
    changes = spark.read.parquet(str(tmp_path / "changes"))
    got = derived.state_events(changes)
    flat = lambda df: sorted((x["file"], x["seq"], x["name"], sorted((k, v) for k, v in x["fields"].items())) for x in df.collect())
    rounds = derived.round_events(changes.where(F.col("prop").isin(*derived.RULES)).select("file", "tick", "seq", "prop", "value"))
    names = ("round_start", "round_officially_ended", "round_end", "cs_win_panel_match")
    assert flat(got.where(F.col("name").isin(*names))) == flat(rounds) and rounds.count() > 50
    bought = derived.purchases(changes)
    want = sorted((x["file"], x["steamid"], x["slot"], x["seq"], x["name"], *(None if x[c] is None else str(x[c]) for c in ("def_index", "cost", "handle"))) for x in bought.collect())
    mine = got.where("name LIKE 'item_%'").collect()
    assert sorted((x["file"], x["steamid"], x["slot"], x["seq"], x["name"], *(x["fields"][c] for c in ("def_index", "cost", "handle"))) for x in mine) == want and len(want) > 20
    connects = derived.first_connects(changes.where("prop = 'player_name'")).select("seq").collect()
    assert sorted(x["seq"] for x in got.where("name = 'player_first_connect'").collect()) == sorted(x["seq"] for x in connects)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_deferred_events(spark):
    state = spark.createDataFrame([("f", 1, 1, "a"), ("f", 1, 9, "b"), ("f", 3, 2, "c"), ("g", 1, 1, "z")], "file string, packet int, place int, v string")
    events = spark.createDataFrame([("f", 1, 0, "plain"), ("f", 1, 5, "plain"), ("f", 1, 5, "late"), ("f", 2, 0, "late"), ("f", 3, 2, "plain"), ("h", 1, 1, "late")], "file string, packet int, place int, name string")
    got = derived.with_deferred_state(events, state, ["file"], ["v"], ["late"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("f", 1, 0, "plain", None), ("f", 1, 5, "plain", "a"), ("f", 1, 5, "late", "b"), ("f", 2, 0, "late", "b"), ("f", 3, 2, "plain", "c"), ("h", 1, 1, "late", None)], key=str)
