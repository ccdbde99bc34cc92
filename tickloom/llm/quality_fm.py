"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

A document's features are its words, hashed into a fixed number of buckets and weighted by the log of their counts,
and a few statistics of its form (shares of character classes, repeats, line shapes, length). The model adds to a
linear part the products of all pairs of features, each weighted by the inner product of two short vectors; the
sum-of-squares identity gives that sum in time linear in the features. It learns by AdaGrad on a bounded sample of
labelled documents (`per_class` of each label) that are not held out; every document is scored whole.

Defined results: null text counts as empty and gets a score from its structure statistics alone; repeated rows and ids
are scored one by one; without labels of both kinds every score is 0.5; extra columns are ignored. Language, source,
id and labels are no features.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded, held_out, kept, labelled_sample, record_batch, sized, with_text

#: Word buckets; the statistics follow them. Rank of the interactions. Bound of the sample.
BUCKETS, RANK, PER_CLASS, LONGEST = 1 << 16, 8, 3000, 200_000
KEEP = 0.3
CACHE = 300_000

#: Class of each UTF-8 byte: lower case, upper case, digit, space, newline, full stop or comma, other sign, beyond ASCII.
BYTE_CLASS = np.full(256, 6, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,")):
    BYTE_CLASS[list(_bytes)] = _k
BYTE_CLASS[128:] = 7
STATISTICS = ("lower", "upper", "digit", "space", "newline", "stop", "sign", "beyond", "word_length", "distinct_words", "neighbour_repeats", "distinct_lines", "line_words", "size", "bias")


class Words(dict):
    """word → bucket, kept per worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, one after the other, and where each text's begin."""
    stats = np.zeros((len(texts), len(STATISTICS)), dtype=np.float32)
    ids, counts = [], np.zeros(len(texts), dtype=np.int64)
    bucket_of = kept(("quality words",), Words).__getitem__
    for k, text in enumerate(texts):
        words = text.split()
        found = np.fromiter(map(bucket_of, words), dtype=np.int64, count=len(words))
        ids.append(found)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n, w = max(1, raw.size), max(1, len(words))
        stats[k, :8] = np.bincount(BYTE_CLASS[raw], minlength=8) / n
        lines = text.split("\n")
        counts[k] = len(words)
        stats[k, 8] = min(2.0, n / w / 10)
        stats[k, 10] = float((found[1:] == found[:-1]).sum()) / w
        stats[k, 11] = len(set(lines)) / len(lines)
        stats[k, 12] = min(2.0, w / len(lines) / 100)
        stats[k, 13] = np.log1p(raw.size) / 12
        stats[k, 14] = 1.0
    doc = np.repeat(np.arange(len(texts)), counts)
    key, times = np.unique(doc * BUCKETS + (np.concatenate(ids) if ids else np.zeros(0, np.int64)), return_counts=True)
    doc, bucket, value = key // BUCKETS, key % BUCKETS, np.log1p(times).astype(np.float32)
    kinds = np.bincount(doc, minlength=len(texts))
    stats[:, 9] = kinds / np.maximum(1, counts)
    norm = np.sqrt(np.bincount(doc, weights=value.astype(np.float64) ** 2, minlength=len(texts))).astype(np.float32)
    value = value / norm[doc]
    # each text's statistics come before its words
    size = kinds + len(STATISTICS)
    starts = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    number, x = np.empty(int(size.sum()), dtype=np.int64), np.empty(int(size.sum()), dtype=np.float32)
    at = (starts[:, None] + np.arange(len(STATISTICS))).ravel()
    number[at], x[at] = np.tile(BUCKETS + np.arange(len(STATISTICS)), len(texts)), stats.ravel()
    first = np.concatenate(([0], np.cumsum(kinds)[:-1])).astype(np.int64)
    at = starts[doc] + len(STATISTICS) + np.arange(doc.size) - first[doc]
    number[at], x[at] = bucket, value
    return number, x, starts


class Machine:
    """Weights w and vectors v of the features."""

    def __init__(self, w: np.ndarray, v: np.ndarray):
        self.w, self.v, self.squares = w, v, (v * v).sum(1)

    def logits(self, number: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """w·x plus half of (sum of v·x) squared less the sum of squares, in time linear in the features."""
        if not starts.size:
            return np.zeros(0)
        summed = np.add.reduceat(self.v[number] * x[:, None], starts, axis=0)
        own = np.add.reduceat(self.w[number] * x - 0.5 * self.squares[number] * x * x, starts)
        return own + 0.5 * (summed * summed).sum(1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(texts)), -30, 30)))


def fit(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 64, rate: float = 0.1, seed: int = 3) -> Machine:
    """Logistic loss; documents of each label weigh as much as half of all."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATISTICS)
    w, v = np.zeros(size, dtype=np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
    y = np.array(labels, dtype=np.float32)
    if not y.size or y.min() == y.max():
        return Machine(w, v * 0)
    gw, gv = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32)
    parts = [features([t]) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), batch):
            some = order[first : first + batch]
            number = np.concatenate([parts[i][0] for i in some])
            x = np.concatenate([parts[i][1] for i in some])
            sizes = np.array([parts[i][0].size for i in some])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            vx = v[number] * x[:, None]
            summed = np.add.reduceat(vx, starts, axis=0)
            logit = np.add.reduceat(w[number] * x, starts) + 0.5 * ((summed**2).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]) / len(some)
            e = np.repeat(error, sizes)[:, None]
            dw, dv = e[:, 0] * x, e * x[:, None] * (np.repeat(summed, sizes, axis=0) - vx)
            touched, where = np.unique(number, return_inverse=True)
            dw = np.bincount(where, weights=dw, minlength=touched.size).astype(np.float32) + 1e-6 * w[touched]
            dv = np.stack([np.bincount(where, weights=dv[:, f], minlength=touched.size) for f in range(RANK)], axis=1).astype(np.float32) + 1e-5 * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.5 * rate * dv / np.sqrt(gv[touched])
    return Machine(w, v)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Fits on the driver on at most per_class documents of each label."""
    rows = labelled_sample(docs, labels, "quality", per_class, LONGEST).collect()
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, machine: Machine, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. The model's size is fixed by BUCKETS and RANK."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    model = docs.sparkSession.sparkContext.broadcast((machine.w, machine.v))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = Machine(*model.value).scores(batch.column(1).to_pylist())
        return record_batch(schema, doc_id=batch.column(0), held_out=batch.column(2), score=scores.astype(np.float64), predicted=(scores >= keep).astype(np.int32))

    return arrow_map(with_text(docs).withColumn("held_out", held_out()), work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine, keep: float = KEEP) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least keep."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w, machine.v))

    bounded(docs.sparkSession)

    def good(batches):
        found = None
        for batch in batches:
            for some in sized([batch]):
                found = found or Machine(*model.value)
                scores = found.scores([t or "" for t in some.column(some.schema.get_field_index("text")).to_pylist()])
                yield some.filter(pa.array(scores >= keep))

    return docs.mapInArrow(good, docs.schema)
