"""Every query with SQL against DuckDB on the smallest tables, and the driver's entry points."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.operators import entities
from tickloom.plans import clip_queries, item_queries, replay_queries, report_queries, upkeep_queries  # noqa: F401  they register their queries
from tickloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want


def test_whole_tables(spark, duck):
    """Nothing is left out by id: every customer with orders, every order, and each tier of the fallback."""
    one = lambda sql: duck.execute(sql).fetchone()[0]
    assert QUERIES["inventory"](spark, SF).count() == one("SELECT count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    assert QUERIES["catalog_merge"](spark, SF).count() == one("SELECT count(*) FROM orders")
    sides = QUERIES["side_fallback"](spark, SF).groupBy("side").count()
    assert sides.where("side = 'UNKNOWN'").first()["count"] == one("SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
    assert one("SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal < 0") > 0


def test_inventory_of_many_items(spark):
    """Item numbers beyond a handle's 14 bits."""
    held = spark.createDataFrame([(1, [5, 5 + (1 << 14)])], "k long, handles array<long>")
    items = spark.createDataFrame([(5, "a"), (5 + (1 << 14), "b")], "entity_id long, name string")
    assert entities.inventory(held, "handles", items, ["k"], index=lambda key: key).first()["inventory"] == ["a", "b"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def without_llm(tmp_path):
    for name in ("tickloom", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name)
    (tmp_path / "tickloom").unlink()
    (tmp_path / "tickloom").mkdir()
    for p in (REPO / "tickloom").iterdir():
        if p.name != "llm":
            (tmp_path / "tickloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_without_the_llm_folders(tmp_path):
    without_llm(tmp_path)


def test_entry_with_an_empty_llm_folder(tmp_path):
    """What deleting sources leaves behind: a folder that only looks like a package."""
    (tmp_path / "rest" / "__pycache__").mkdir(parents=True)
    there = tmp_path / "there"
    there.mkdir()
    (there / "corpus_pipeline.py").write_text("from tickloom.llm import queries")
    without_llm(there)
    (there / "tickloom" / "llm").symlink_to(tmp_path / "rest")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=there, check=True, env=os.environ | {"PYTHONPATH": str(there)})


@pytest.mark.skipif(not (REPO / "tickloom" / "llm" / "queries.py").exists(), reason="without the training-data operators")
def test_entry_has_all_training_data_queries():
    found = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert found == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()
