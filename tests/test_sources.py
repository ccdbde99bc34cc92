"""The log source against logs that are encoded here, and the sinks and streams."""

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.sources import replaylog as log
from tickloom.sources import sinks
from tickloom.streaming import live


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def pb(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def packet(*messages):
    bits, at = 0, 0

    def put(value, n):
        nonlocal bits, at
        bits |= value << at
        at += n

    for kind, data in messages:
        if kind < 16:
            put(kind, 6)
        elif kind < 256:
            put(kind & 15 | 16, 6)
            put(kind >> 4, 4)
        for b in varint(len(data)) + data:
            put(b, 8)
    return pb(3, bits.to_bytes(-(-at // 8), "little"))


def frame(command, tick, data, packed=False):
    if packed:
        data = pa.compress(data, codec="snappy", asbytes=True)
    return varint(command | (64 if packed else 0)) + varint(tick & 0xFFFFFFFF) + varint(len(data)) + data


def sample(packed):
    key = lambda kind, name: pb(3, pb(1, kind) + pb(2, name))
    events = pb(1, pb(1, 9) + pb(2, "player_death") + key(4, "userid") + key(1, "weapon") + key(2, "dist"))
    value = lambda number, v: pb(3, pb(1, 1) + pb(number, v))
    death = pb(2, 9) + value(5, 3) + value(2, "ak47") + pb(3, pb(1, 2) + varint(3 << 3 | 5) + struct.pack("<f", 1.5))
    convar = pb(1, pb(1, pb(1, "mp_x") + pb(2, "1")))
    chat = pb(4, "Ann") + pb(5, "hi")
    return (
        b"PBDEMS2\0" + bytes(8)
        + frame(1, -1, pb(1, "PBDEMS2") + pb(5, "de_x"), packed)
        + frame(8, -1, packet((205, events), (6, convar)), packed)
        + frame(5, -1, pb(1, pb(1, 4) + pb(2, "CPawn") + pb(3, "t")), packed)
        + frame(13, 0, pb(1, pb(1, pb(1, "userinfo") + pb(2, pb(1, "2") + pb(2, pb(1, "Ann") + pb(3, 258) + pb(4, 76561198000000001))))) + pb(2, packet((118, chat))), packed)
        + frame(7, 10, packet((207, death)), packed)
        + frame(7, 20, packet((207, death), (118, chat)), packed)
        + frame(0, 20, b"")
    )


def test_lanes(spark, tmp_path):
    (tmp_path / "a.dem").write_bytes(sample(False))
    (tmp_path / "b.dem").write_bytes(sample(True))
    (tmp_path / "cut.dem").write_bytes(sample(False)[:-20])
    lane = lambda name: log.read_lane(spark, str(tmp_path), name)
    name = F.element_at(F.split("file", "/"), -1)
    assert [r["n"] for r in lane("frames").groupBy(name.alias("f")).agg(F.count("*").alias("n")).orderBy("f").collect()] == [7, 7, 5]
    assert {r["header"]["map_name"] for r in lane("header").collect()} == {"de_x"}
    deaths = log.event_table(lane("events"), "player_death", {"userid": "int", "weapon": "string", "dist": "double", "none": "int"})
    got = [tuple(r) for r in deaths.where(name == "b.dem").select("tick", "userid", "weapon", "dist", "none").orderBy("tick").collect()]
    assert got == [(10, 3, "ak47", 1.5, None), (20, 3, "ak47", 1.5, None)]
    assert lane("convars").where(name == "a.dem").select("name", "value").first() == ("mp_x", "1")
    assert lane("chat").where(name == "a.dem").count() == 2
    assert lane("messages").where(name == "a.dem").count() == 6
    assert [tuple(r)[3:] for r in lane("users").where(name == "b.dem").collect()] == [(2, "Ann", 76561198000000001, 258, False, False)]
    assert [tuple(r)[1:] for r in lane("classes").where(name == "a.dem").collect()] == [(4, "CPawn", "t")]
    assert lane("event_list").where(name == "a.dem").first()["keys"] == {"userid": 4, "weapon": 1, "dist": 2}
    assert lane("string_tables").where(name == "a.dem").count() == 1
    plan = log.trim_plan(lane("frames").where(name == "a.dem"), 5, 15).orderBy("frame").collect()
    assert [r["frame"] for r in plan] == [0, 1, 2, 3, 4, 6]
    assert {r["kind"] for r in log.census(lane("frames")).collect()} >= {"packet", "header"}


def test_sinks(spark):
    df = spark.createDataFrame([(1, 10, 7, 1.0), (1, 11, 7, 2.0), (1, 11, 8, 3.0)], "clip int, tick int, steamid long, x double")
    row = sinks.dense_arrays(df, ["clip"], "tick", "steamid", ["x"]).first()
    arrays = np.load(io.BytesIO(row["npz"]))
    assert arrays["x"].shape == (2, 2) and np.isnan(arrays["x"][0, 1]) and arrays["x"][1].tolist() == [2.0, 3.0]
    assert sorted(tuple(r) for r in sinks.read_dense(sinks.dense_arrays(df, ["clip"], "tick", "steamid", ["x"]), ["clip"], ["x"]).collect()) == [(1, 10, 7, 1.0), (1, 11, 7, 2.0), (1, 11, 8, 3.0)]
    assert tuple(sinks.csr(df, ["clip"], "tick", ["x"]).first()) == (1, 3, [10, 11, 11], [1.0, 2.0, 3.0])
    assert sinks.fnv1a(spark.createDataFrame([(b"a",), (b"",)], "b binary"), "b").collect()[0]["checksum"] == 0xAF63DC4C8601EC8C - (1 << 64)
    doc = sinks.sections(df.withColumn("lane", F.lit("ticks")), ["clip"], {"ticks": ["x"]}, "tick").first()["document"]
    assert doc.count('"tick"') == 3


def test_streams(spark, tmp_path):
    data = [(1, 5, 1.0, True, "2024-01-01 00:00:05"), (1, 7, 0.0, False, "2024-01-01 00:00:07"), (1, 7, 0.0, False, "2024-01-01 00:00:07"), (2, 9, 0.0, False, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(data, "k long, tick long, v double, s boolean, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    df.write.parquet(str(tmp_path / "in"))

    def run(make, mode, name):
        stream = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [tuple(r) for r in spark.table(name).collect()]

    carried = run(lambda s: live.carried(s, "k", "tick", "v", "s"), "append", "carried")
    assert sorted(carried, key=lambda r: r[:2]) == [(1, 5, 1.0), (1, 7, 1.0), (1, 7, 1.0), (2, 9, None)]
    assert len(run(lambda s: live.deduplicated(s, ["k", "tick"]), "append", "once")) == 3
    assert (1, 3) in {r[2:4] for r in run(lambda s: live.windowed(s, ["k"], "v"), "append", "hours")}
    assert (1, 3) in {r[2:] for r in run(lambda s: live.bursts(s, ["k"]), "append", "bursts")}


def test_bits():
    bits = log.Bits(bytes([0b10000101]) + varint(300) + varint(5))
    assert bits.small() == 5 and bits.bits(2) == 2 and bits.varint() == 300 and bits.signed() == -3
    assert log.Bits(bytes([0])).coordinate() == 0.0 and log.Bits((0b1 | 0b1 << 2 | 6 << 3).to_bytes(4, "little")).coordinate() == -7.0
    assert log.Bits(bytes([255])).quantised(8, -1.0, 1.0) == 1.0
