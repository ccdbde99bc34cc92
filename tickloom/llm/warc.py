"""Web archives: index first, then coalesced byte-range reads of the selected records.

Writing gives every page a record in a WARC 1.1 file, each record a gzip member of its own, and an index row with
its file, offset, length, URL and payload digest. Of pages with equal payloads of a least size the one with the
smallest id is the response and the others are revisits that refer to it. Reading takes index rows: those of one
file are sorted by offset, ranges that lie close together become one read, and the members are parsed from it.

Files are written by the tasks through the shared folder's file system under names of their own, so a task that runs
again writes other files, and the index, written by Spark's committed writer, names only those of tasks that succeeded.

Defined results: null html is an empty payload; a null URL leaves the header out; repeated page ids are records of
their own, and of equal payloads every row with the smallest id is a response; a null id is never the smallest;
a group whose ids are all null has responses only; extra columns are ignored; no pages give no files and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, new_path, sized, written

#: Payloads under so many bytes are never revisits. A file is closed at so many bytes or records.
LEAST, FILE_BYTES, FILE_RECORDS = 100, 64 << 20, 20_000
#: Ranges at most so far apart become one read of at most so many bytes.
GAP, READ_BYTES = 64 << 10, 8 << 20
#: Tasks that read, at most; beyond it a task reads several files.
TASKS = 20_000
#: Payloads that make up so large a part of the repeated ones, or more, are joined by broadcast; they are at most HOT.
HOT = 1000
INDEX = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]
)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names, for use inside tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def with_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    brief = rows.select("page_id", "digest", F.octet_length("payload").alias("size"))
    # only payloads that occur more than once, written so that the joins below see a plain table and its size
    firsts = brief.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts, "warc-firsts")
    # a payload that many pages have does not meet its first page by a shuffle, which would bring all of them to one task
    most = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(firsts.where(F.col("n") * HOT >= most).select("digest", F.lit(True).alias("hot"), F.col("first_id").alias("hot_id")))
    rest = firsts.where(F.col("n") * HOT < most).select(F.col("digest").alias("key"), "first_id")
    # rows of hot payloads keep apart: their keys match nothing
    key = F.when(F.col("hot"), F.concat_ws("-", F.lit(""), F.xxhash64("page_id", "url"))).otherwise(F.col("digest"))
    joined = rows.join(hot, "digest", "left").withColumn("key", key).join(rest, "key", "left").withColumn("first_id", F.when(F.col("hot"), F.col("hot_id")).otherwise(F.col("first_id")))
    later = F.col("first_id").isNotNull() & F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    return joined.select("page_id", "url", "payload", "digest", F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the response's HTTP headers only; Content-Length there is the payload's."""
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; a revisit has the stated digest and size of its response's payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])}
    number = lambda key: int(v) if (v := headers.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    stated = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    digest = stated if revisit else hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return {
        "page_id": number("warc-record-id"),
        "url": headers.get("warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": int(http_headers["content-length"]),
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "refers_to": number("warc-refers-to"),
    }


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives into folder; returns the index (already written)."""
    bounded(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        out, name, at, rows = None, "", 0, []
        try:
            for batch in sized(batches):
                for row in batch.to_pylist():
                    if out is None:
                        name, at, rows = f"{uuid4().hex}.warc.gz", 0, []
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip_member(record(**row))
                    out.write(member)
                    rows.append({"file": name, "offset": at, "length": len(member), **{c: row[c] for c in ("url", "digest", "page_id", "record_type")}})
                    at += len(member)
                    if at >= FILE_BYTES or len(rows) >= FILE_RECORDS:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pylist(rows, schema=INDEX)
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pylist(rows, schema=INDEX)
        finally:
            if out is not None and not out.closed:
                out.close()

    return written(with_types(pages, least).mapInArrow(run, "file string, offset long, length long, url string, digest string, page_id long, record_type string"), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges in lists that are read at once."""
    some: list[tuple[int, int]] = []
    for offset, length in ranges:
        if some and (offset - sum(some[-1]) > gap or offset + length - some[0][0] > most):
            yield some
            some = []
        some.append((offset, length))
    if some:
        yield some


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that the index rows select, a file per group: at most FILE_RECORDS rows and READ_BYTES at a time.

    Files, of FILE_BYTES or one record more each, are spread over as many tasks as there are files, TASKS at most, however few bytes their index rows have.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def read_file(pdf: pd.DataFrame) -> pd.DataFrame:
        store, root = open_fs(folder)
        found = []
        with store.open_input_file(f"{root}/{pdf['file'].iloc[0]}") as f:
            for some in coalesced(sorted(zip(pdf["offset"].tolist(), pdf["length"].tolist()))):
                f.seek(start := some[0][0])
                data = f.read(sum(some[-1]) - start)
                for offset, length in some:
                    parsed = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                    found.append({k: parsed[k] for k in names})
        out = pd.DataFrame(found, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    files = index.agg(F.count_distinct("file")).first()[0]
    return index.select("file", "offset", "length").repartition(max(1, min(TASKS, files)), "file").groupBy("file").applyInPandas(read_file, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder and reads them all back."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
