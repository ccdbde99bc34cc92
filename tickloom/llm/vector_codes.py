"""Product codes of vectors by Lloyd's rounds with Exponion search, in whole numbers.

A vector is cut into equal parts, and each part position has a codebook of entries. To find a part's nearest entry, the search starts at
the entry the part had before, at distance r. An entry further than 2 r from that one is further than r from the part, so only
the start's neighbours inside 2 r are looked at, in order of their distance to it; the list of them is sorted once a round. Distances are squared
and exact: "inside" is D <= 4 r^2 with equality kept, so that ties go to the lower index as in a full comparison.

A round is one pass that writes vectors and codes, and one that adds up the parts of each entry inside the tasks: what is shuffled
and collected is one row for each part, entry and task, and for each part and entry.

Defined results: rows whose vector is null, has no components, or holds null, NaN or infinite ones take no part; the codebook
starts from the smallest keys (of equal keys the smaller vector first, null keys last); fewer rows than entries make a smaller codebook;
repeated rows are rows of their own; extra columns are ignored; no usable rows give no rows. All usable vectors must have one length, a multiple of
the number of parts, or a ValueError is raised. Whole components must fit 64 bits; where their distances do not, Python's numbers are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded, dropped, record_batch, sized, small, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Labels' sums that a join may broadcast take so many bytes each.
LABEL_BYTES = 64


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v array<long>: floor(256 x) of the components of the vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.where((F.size(vector) > 0) & ~bad)
    return usable.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)


class Codebook:
    """One part's entries with, for each, the others in order of distance (then index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squares(entries[:, None] - entries[None])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, 1)

    def nearest(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry, found from the entries where they start."""
        best, index = squares(points - self.entries[start]), start.copy()
        radius = 4 * best
        inside = np.array([np.searchsorted(self.sorted[s], r, side="right") for s, r in zip(start, radius)]) if points.dtype == object else self.inside(start, radius)
        turn = np.argsort(-inside, kind="stable")  # those with the most neighbours to look at first
        left = len(points) - np.searchsorted(np.sort(inside), np.arange(len(self.entries) + 1), side="right")
        for step in range(len(self.entries)):
            rows = turn[: left[step]]
            if not len(rows):
                break
            entry = self.order[start[rows], step]
            d = squares(points[rows] - self.entries[entry])
            better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], entry[better]
        return index, best

    def inside(self, start: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """How many neighbours of each start lie within the squared radius: a binary search of all rows at once."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.entries))
        for _ in range(len(self.entries).bit_length()):
            middle = np.minimum((low + high) // 2, len(self.entries) - 1)
            more = (self.sorted[start, middle] <= radius) & (low < high)
            low, high = np.where(more, middle + 1, low), np.where(more, high, middle)
        return low


def far(v: np.ndarray) -> int:
    """The largest component's size."""
    return max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0


def vectors_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with code (one byte or two for each part) and error. books: parts x entries x components. A code of before is where the search starts."""
    parts, entries, width = books.shape
    kind = np.dtype("u1") if entries <= 256 else np.dtype("<u2")
    has_code, label, reach = "code" in rows.columns, dict(rows.dtypes)["label"], far(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = None
        for batch in sized(batches):
            v = vectors_of(batch, parts * width)
            big = 4 * parts * width * (2 * max(reach, far(v))) ** 2 >= 1 << 63  # beyond it 64 bits do not hold radii and errors
            if big:
                v, found = v.astype(object), [Codebook(b.astype(object)) for b in books]
            else:
                found = plain = plain or [Codebook(b) for b in books]
            before = np.frombuffer(b"".join(batch.column("code").to_pylist()), kind).reshape(-1, parts).astype(np.int64) if has_code else np.zeros((batch.num_rows, parts), np.int64)
            code, error = np.empty((batch.num_rows, parts), kind), 0
            for p in range(parts):
                code[:, p], d = found[p].nearest(v[:, p * width : (p + 1) * width], before[:, p])
                error = error + d
            columns = {n: batch.column(n) for n in ("vec_id", "label", "v")}
            columns |= {"code": pa.array([r.tobytes() for r in code], pa.binary()), "error": pa.array([int(e) for e in error], pa.decimal128(38, 0))}
            yield pa.RecordBatch.from_pydict(columns)

    bounded(rows.sparkSession)
    return rows.select("vec_id", "label", "v", *["code"] * has_code).mapInArrow(run, f"vec_id long, label {label}, v array<long>, code binary, error decimal(38,0)")


def next_books(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's floor of the mean of its parts; unused entries stay. Tasks add up their own rows, so one row an entry and task is shuffled."""
    parts, entries, width = books.shape
    kind = np.dtype("u1") if entries <= 256 else np.dtype("<u2")
    schema = pa.schema([("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)
        for batch in sized(batches):
            v = vectors_of(batch, parts * width).reshape(-1, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), kind).reshape(-1, parts)
            flat = (code + np.arange(parts) * entries).reshape(-1)
            n += np.bincount(flat, minlength=len(n))
            if far(v) * len(v) >= 1 << 52:  # beyond what doubles add exactly
                np.add.at(sums, flat, v.astype(object))
            else:
                for c in range(width):
                    sums[:, c] += np.bincount(flat, weights=v[:, c], minlength=len(n)).astype(np.int64)
        used = np.flatnonzero(n)
        if len(used):
            yield record_batch(schema, entry=used, n=n[used], sums=[[int(x) for x in row] for row in sums[used]])

    bounded(coded.sparkSession)
    each = coded.select("v", "code").mapInArrow(run, "entry int, n long, sums array<decimal(38,0)>")
    total = each.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[c]).alias(f"s{c}") for c in range(width)])
    out = books.copy()
    for row in total.toLocalIterator():  # one row for each part and entry at most
        out[row["entry"] // entries, row["entry"] % entries] = [int(row[f"s{c}"]) // row["n"] for c in range(width)]
    return out


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors with the smallest keys; None without rows."""
    some = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if not some:
        return None
    if sizes[0] != sizes[1] or sizes[0] % parts:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components cannot be cut into {parts} equal parts")
    return np.array(some, np.int64).reshape(len(some), parts, -1).transpose(1, 0, 2)


def codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """rows (vec_id, label, v) with their final code and error, and the codebooks: parts x entries x components."""
    books = first_books(rows, parts, entries)
    if books is None:
        return rows.limit(0).select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error")), None
    before = None
    for k in range(rounds + 1):
        coded = written(assigned(rows if before is None else before, books), f"codes-{k}")
        if before is not None:
            dropped(before)
        before = coded
        books = next_books(coded, books) if k < rounds else books
    return before.select("vec_id", "label", "code", "error"), books


def digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in (books.reshape(-1) if books is not None else [])).encode()).hexdigest()


def report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over the rows of the label, nulls together), codebooks_sha256."""
    found, books = codes(whole(vectors), parts, entries, rounds)
    sums = small(found.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), LABEL_BYTES)
    out = found.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), F.col("error").cast("long").alias("error"), F.col("label_error").cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
