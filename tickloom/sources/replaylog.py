"""Replay logs as DataFrames: frames, header, messages, game events, console variables, chat and voice.

Files come in through Spark's own binary file source, so any store that Spark reads will do, files are pruned by path and spread
over tasks, and a lost task reads its file again. Each lane has a declared schema; a row carries (file, frame, message) as its order.
Decoding entity fields needs a table of path codes that is not public with the format; lanes that need it are not offered.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES, COMPRESSED, ROWS = 16, 64, 5000
# Fixed values of the format: frame commands and message types that the lanes use.
COMMANDS = {0: "stop", 1: "header", 2: "info", 3: "sync", 4: "send_tables", 5: "class_info", 6: "string_tables", 7: "packet", 8: "signon", 9: "console", 13: "full_packet", 15: "spawn_groups"}
PACKET, SIGNON, FULL_PACKET, FILE_HEADER, CLASS_INFO, STRING_TABLES = 7, 8, 13, 1, 5, 6
SET_CONVAR, VOICE, EVENT_LIST, EVENT, CHAT, SERVER_TEXT = 6, 47, 205, 207, 118, 124
HEADER_FIELDS = {
    1: "demo_file_stamp",
    2: "network_protocol",
    3: "server_name",
    4: "client_name",
    5: "map_name",
    6: "game_directory",
    7: "fullpackets_version",
    8: "allow_clientside_entities",
    9: "allow_clientside_particles",
    10: "addons",
    11: "demo_version_name",
    12: "demo_version_guid",
    13: "build_num",
    14: "game",
}


class Bits:
    """Reads little-endian bits, and the numbers that they encode."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)

    def bits(self, n: int) -> int:
        out = self.value >> self.at & ((1 << n) - 1)
        self.at += n
        return out

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.bits(8)
            out |= (b & 127) << shift
            shift += 7
            if b < 128 or shift >= 35:
                return out & 0xFFFFFFFF

    def small(self) -> int:
        """Six bits whose upper two say how many more follow."""
        first = self.bits(6)
        more = {0: 0, 1: 4, 2: 8, 3: 28}[first >> 4]
        return first if not more else first & 15 | self.bits(more) << 4

    def signed(self) -> int:
        """A varint in zig-zag order."""
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def coordinate(self) -> float:
        """Flags for a whole and a fractional part, a sign, 14 bits (from 1 on) and 32nds."""
        whole, part = self.bits(1), self.bits(1)
        if not whole and not part:
            return 0.0
        minus = self.bits(1)
        value = (self.bits(14) + 1 if whole else 0) + (self.bits(5) / 32 if part else 0.0)
        return -value if minus else value

    def quantised(self, bits: int, low: float, high: float) -> float:
        """A number of `bits` bits that spans [low, high]."""
        return low + (high - low) * self.bits(bits) / ((1 << bits) - 1)

    @property
    def left(self) -> int:
        return self.end - self.at


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: whole numbers, or the bytes of fixed and delimited fields."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size = 8 if kind == 1 else 4 if kind == 5 else None
            if size is None:
                size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def text(value: int | bytes) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def frames_of(content: bytes) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(number, command, compressed, tick, offset of the payload, its size); a cut-off last frame ends the file."""
    at, number = HEADER_BYTES, 0
    while at < len(content):
        try:
            command, at = varint(content, at)
            tick, at = varint(content, at)
            size, at = varint(content, at)
        except IndexError:
            return
        if at + size > len(content):
            return
        yield number, command & ~COMPRESSED, int(bool(command & COMPRESSED)), tick - (1 << 32) if tick >= 1 << 31 else tick, at, size
        at, number = at + size, number + 1
        if command & ~COMPRESSED == 0:
            return


def payload(content: bytes, compressed: int, offset: int, size: int) -> bytes:
    data = content[offset : offset + size]
    if not compressed:
        return data
    whole, _ = varint(data, 0)
    return pa.decompress(data, whole, codec="snappy", asbytes=True)


def messages_of(packet: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, bytes) of a packet's messages."""
    data = next((v for k, v in fields(packet) if k == 3 and isinstance(v, bytes)), b"")
    bits = Bits(data)
    while bits.left > 8:
        kind, size = bits.small(), bits.varint()
        yield kind, bits.bits(8 * size).to_bytes(size, "little")


def packets(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(frame, tick, packet) of frames that hold messages; a full packet's own packet is its second field."""
    for number, command, compressed, tick, offset, size in frames_of(content):
        if command in (PACKET, SIGNON, FULL_PACKET):
            data = payload(content, compressed, offset, size)
            if command == FULL_PACKET:
                data = next((v for k, v in fields(data) if k == 2 and isinstance(v, bytes)), b"")
            yield number, tick, data


def _event_names(content: bytes) -> dict[int, tuple[str, list[tuple[int, str]]]]:
    """id → (name, [(type, key)]) of the first event list."""
    for _, _, packet in packets(content):
        for kind, data in messages_of(packet):
            if kind == EVENT_LIST:
                found = {}
                for k, one in fields(data):
                    if k == 1:
                        parts = list(fields(one))
                        keys = [dict(fields(v)) for n, v in parts if n == 3]
                        found[next(v for n, v in parts if n == 1)] = (text(next(v for n, v in parts if n == 2)), [(x.get(1, 0), text(x.get(2, b""))) for x in keys])
                return found
    return {}


def _key_value(data: bytes) -> str | None:
    import struct

    for k, v in fields(data):
        if k == 2:
            return text(v)
        if k == 3:
            return repr(round(struct.unpack("<f", v)[0], 6))
        if k in (4, 5, 6):
            return str(v - (1 << 64) if v >= 1 << 63 else v)
        if k == 7:
            return "true" if v else "false"
        if k == 8:
            return str(v)
    return None


def _frames(content: bytes) -> Iterator[tuple]:
    for number, command, compressed, tick, offset, size in frames_of(content):
        yield number, command, COMMANDS.get(command, "other"), bool(compressed), tick, offset, size


def _header(content: bytes) -> Iterator[tuple]:
    for number, command, compressed, _, offset, size in frames_of(content):
        if command == FILE_HEADER:
            yield ({HEADER_FIELDS[k]: text(v) for k, v in fields(payload(content, compressed, offset, size)) if k in HEADER_FIELDS},)
            return


def _messages(content: bytes) -> Iterator[tuple]:
    for frame, tick, packet in packets(content):
        for i, (kind, data) in enumerate(messages_of(packet)):
            yield frame, i, tick, kind, len(data)


def _events(content: bytes) -> Iterator[tuple]:
    names = _event_names(content)
    for frame, tick, packet in packets(content):
        for i, (kind, data) in enumerate(messages_of(packet)):
            if kind == EVENT:
                parts = list(fields(data))
                name, keys = names.get(next((v for n, v in parts if n == 2), -1), (text(next((v for n, v in parts if n == 1), b"")), []))
                values = [_key_value(v) for n, v in parts if n == 3]
                yield frame, i, tick, name, {k: v for (_, k), v in zip(keys, values) if v is not None}


def _convars(content: bytes) -> Iterator[tuple]:
    for frame, tick, packet in packets(content):
        for i, (kind, data) in enumerate(messages_of(packet)):
            if kind == SET_CONVAR:
                for k, all_vars in fields(data):
                    for n, one in fields(all_vars) if k == 1 else ():
                        pair = dict(fields(one)) if n == 1 else {}
                        if pair:
                            yield frame, i, tick, text(pair.get(1, b"")), text(pair.get(2, b""))


def _chat(content: bytes) -> Iterator[tuple]:
    for frame, tick, packet in packets(content):
        for i, (kind, data) in enumerate(messages_of(packet)):
            if kind == CHAT:
                got = dict(fields(data))
                yield frame, i, tick, text(got.get(4, b"")), text(got.get(5, b""))


def _voice(content: bytes) -> Iterator[tuple]:
    for frame, tick, packet in packets(content):
        for i, (kind, data) in enumerate(messages_of(packet)):
            if kind == VOICE:
                got = dict(fields(data))
                audio = dict(fields(got.get(1, b"") if isinstance(got.get(1, b""), bytes) else b""))
                xuid = got.get(4, 0)
                yield frame, i, tick, int.from_bytes(xuid, "little") if isinstance(xuid, bytes) else xuid, audio.get(2, b"")


def _string_tables(content: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """(frame, tick, table, key, value) of the tables that a log repeats whole, in frames of their own and in full packets."""
    for frame, command, compressed, tick, offset, size in frames_of(content):
        if command in (STRING_TABLES, FULL_PACKET):
            data = payload(content, compressed, offset, size)
            if command == FULL_PACKET:
                data = next((v for k, v in fields(data) if k == 1 and isinstance(v, bytes)), b"")
            for k, one in fields(data):
                parts = list(fields(one)) if k == 1 and isinstance(one, bytes) else []
                name = text(next((v for n, v in parts if n == 1), b""))
                for n, item in parts:
                    if n == 2:
                        got = dict(fields(item))
                        yield frame, tick, name, text(got.get(1, b"")), got.get(2, b"")


def _tables(content: bytes) -> Iterator[tuple]:
    for frame, tick, name, key, value in _string_tables(content):
        yield frame, tick, name, key, len(value)


def _users(content: bytes) -> Iterator[tuple]:
    long = lambda v: int.from_bytes(v, "little") if isinstance(v, bytes) else v
    for frame, tick, name, key, value in _string_tables(content):
        if name == "userinfo" and value:
            got = dict(fields(value))
            yield frame, tick, int(key) if key.isdigit() else None, text(got.get(1, b"")), long(got.get(4, got.get(2, 0))), got.get(3), bool(got.get(5, 0)), bool(got.get(6, 0))


def _classes(content: bytes) -> Iterator[tuple]:
    for _, command, compressed, _, offset, size in frames_of(content):
        if command == CLASS_INFO:
            for k, one in fields(payload(content, compressed, offset, size)):
                if k == 1:
                    got = dict(fields(one))
                    yield got.get(1, 0), text(got.get(2, b"")), text(got.get(3, b""))
            return


def _event_list(content: bytes) -> Iterator[tuple]:
    for number, (name, keys) in _event_names(content).items():
        yield number, name, {k: kind for kind, k in keys}


#: lane → (rows of a file, columns after `file`)
LANES: dict[str, tuple[Callable[[bytes], Iterator[tuple]], str]] = {
    "frames": (_frames, "frame long, command int, kind string, compressed boolean, tick int, offset long, size long"),
    "header": (_header, "header map<string,string>"),
    "messages": (_messages, "frame long, message int, tick int, type int, size long"),
    "events": (_events, "frame long, message int, tick int, name string, fields map<string,string>"),
    "convars": (_convars, "frame long, message int, tick int, name string, value string"),
    "chat": (_chat, "frame long, message int, tick int, sender string, text string"),
    "string_tables": (_tables, "frame long, tick int, name string, key string, size long"),
    "users": (_users, "frame long, tick int, slot int, name string, steamid long, userid int, bot boolean, hltv boolean"),
    "classes": (_classes, "class_id int, network_name string, table_name string"),
    "event_list": (_event_list, "event_id int, name string, keys map<string,int>"),
    "voice": (_voice, "frame long, message int, tick int, steamid long, audio binary"),
}


def read_lane(spark: SparkSession, path: str | list[str], lane: str, pattern: str = "*.dem*") -> DataFrame:
    """One lane of all logs under path; rows leave a task in blocks, so a long log is not held as rows."""
    decode, columns = LANES[lane]
    names = ["file"] + [c.strip().split(" ")[0] for c in columns.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for row in decode(plain(content)):
                    rows.append((file, *row))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, "file string, " + columns)


def event_table(events: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """Rows of one event with its fields as typed columns; a missing field is null."""
    return events.where(F.col("name") == name).select("file", "frame", "message", "tick", *[F.col("fields")[k].try_cast(t).alias(k) for k, t in columns.items()])


def census(frames: DataFrame) -> DataFrame:
    """Count, bytes and first and last tick per kind of frame."""
    return frames.groupBy("file", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))


def trim_plan(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames that a clip of [start, end] needs: all before the first packet, from the last full packet at or before start, up to end."""
    base = frames.groupBy("file").agg(
        F.max(F.when((F.col("command") == FULL_PACKET) & (F.col("tick") <= start), F.col("frame"))).alias("checkpoint"),
        F.min(F.when(F.col("command").isin(PACKET, FULL_PACKET), F.col("frame"))).alias("body"),
    )
    body = F.col("frame") >= F.coalesce("checkpoint", "body", F.lit(0))
    return frames.join(base, "file").where((F.col("frame") < F.coalesce("body", F.lit(2**62))) | (body & (F.col("tick") <= end)) | (F.col("command") == 0)).drop("checkpoint", "body")


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text, as the row-oriented bindings return them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("row"))


def header_dict(spark: SparkSession, path: str) -> dict[str, str]:
    """The header of one log."""
    row = read_lane(spark, path, "header", "*").first()
    return json.loads(json.dumps(row["header"])) if row else {}
