"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification, connected classes.

A document's shingles are its runs of five lower-case words, weighted by how often they occur (a document of fewer
words is one shingle; an empty one has none and only equals empty ones). ProbMinHash lets each shingle arrive as a Poisson process
whose rate is its weight; every arrival goes to a random register, which keeps its earliest shingle, and a shingle stops
once its next arrival comes after the latest register. Two documents agree in a register with their probability Jaccard.
Registers in bands of four give bucket keys. A document with repeated shingles has the bands of its plain set too (all weights 1, where
two documents agree in a register with the Jaccard of their sets, which is what links are verified by). Equal texts are one node. In each bucket all nodes are compared with one pivot,
the node whose buckets hold the most nodes, by the exact Jaccard of their shingle sets; links of 0.8 or more join classes.
Then, of the nodes of buckets that still hold several classes, those of different classes are compared that an exact prefix filter over
their rarest shingles cannot tell apart. So no pair that shares a bucket and could link two classes is skipped,
and a large group costs one comparison per node and bucket.

With 20 bands of four, a pair whose sets have a Jaccard of 0.8 shares a bucket with probability 0.99997, however often its shingles occur.

Defined results: null text counts as empty; rows that repeat an id are one document (their texts' classes join); rows
without an id have no class (null); extra columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, dropped, kept, record_batch, small, with_text, written

WORDS, BANDS, ROWS, NUMERATOR, DENOMINATOR = 5, 20, 4, 4, 5
REGISTERS = BANDS * ROWS
CACHE = 300_000
#: Most ids that are broadcast.
ID_BYTES = 32
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finishing steps: spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word → 64-bit hash, kept per worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes and how often each occurs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(kept(("word hashes",), WordHashes).__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < WORDS:
        h = np.concatenate((h, np.zeros(WORDS - len(h), np.uint64)))
    n = len(h) - WORDS + 1
    total = h[:n].copy()
    for k in range(1, WORDS):
        total = mixed(total * GOLDEN + h[k : k + n])
    return np.unique(total, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of weighted sets: per set and register the element that arrives first (0 where the set is empty)."""
    docs = len(sets)
    first = np.full(docs * registers, np.inf)
    owner = np.zeros(docs * registers, dtype=np.uint64)
    doc = np.repeat(np.arange(docs), [len(h) for h, _ in sets])
    if not doc.size:
        return owner.reshape(docs, registers)
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    time, step = np.zeros(doc.size), np.uint64(0)
    with np.errstate(over="ignore"):
        while doc.size:
            step += np.uint64(1)
            u = mixed(element + step * GOLDEN)
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
            at = doc * registers + (mixed(u ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = first[at] == time
            owner[at[won]] = element[won]
            # only elements that may still come before the latest register of their set go on
            some, place = np.unique(doc, return_inverse=True)
            latest = first.reshape(docs, registers)[some].max(axis=1)
            going = time < latest[place]
            doc, element, weight, time = doc[going], element[going], weight[going], time[going]
    return owner.reshape(docs, registers)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), BANDS, ROWS)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, (len(sig), 1))
        for k in range(ROWS):
            key = mixed(key + parts[:, :, k])
    return key.view(np.int64)


def bucket_keys(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Band keys of each set: by its counts, and where a shingle repeats, with all weights 1 as well. None for an empty set."""
    keys = [k if len(h) else k[:0] for k, (h, _) in zip(band_keys(signatures(sets)), sets)]
    again = [i for i, (_, w) in enumerate(sets) if len(w) and w.max() > 1]
    plain = band_keys(signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in again]))
    for i, k in zip(again, plain):
        keys[i] = np.unique(np.concatenate((keys[i], k)))
    return keys


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, bands of every row; no bands for a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sets = [shingles(t) for t in texts]
        return record_batch(
            schema,
            doc_id=batch.column(0),
            text_key=[hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts],
            bands=bucket_keys(sets),
        )

    return arrow_map(with_text(docs), work, "doc_id long, text_key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles array<long> (distinct) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(schema, doc_id=batch.column(0), shingles=[shingles(t)[0].view(np.int64) for t in batch.column(1).to_pylist()])

    return arrow_map(docs.select("doc_id", "text"), work, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, size_a, size_b of pairs (a, b) by their exact shingle sets."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b")
    return both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), F.size("set_a").alias("size_a"), F.size("set_b").alias("size_b"))


def sharing_rare(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (doc_id, class_id, shingles) of different classes that may have a Jaccard of 0.8.

    Shingles are ordered by how many of the nodes have them. Two such sets share a shingle before place n - 0.8 n of either, and so early in
    both that enough shingles follow; shingles of one node alone take places but match nothing. So copies that differ by words of their own meet nobody.
    """
    each = written(nodes.select(F.col("doc_id").alias("node"), "class_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "node-shingles", hashes=True)
    counts = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    common = each.join(written(counts, "shingle-counts", hashes=True), "s")
    alone = each.groupBy("node").agg(F.count("*").alias("all")).join(common.groupBy("node").agg(F.count("*").alias("shared")), "node").select("node", (F.col("all") - F.col("shared")).alias("alone"))
    ranked = common.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "s")) - 1).join(alone, "node")
    prefix = written(ranked.withColumn("i", F.col("alone") + F.col("rank")).where(f"{DENOMINATOR} * (n - i) >= {NUMERATOR} * n").select("node", "class_id", "n", "i", "s"), "prefixes", hashes=True)
    x, y = prefix.alias("x"), prefix.alias("y")
    both = (NUMERATOR * (F.col("x.n") + F.col("y.n"))).cast("long")
    close = (F.col("x.s") == F.col("y.s")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.class_id") != F.col("y.class_id"))
    close &= F.least("x.n", "y.n") * DENOMINATOR >= F.greatest("x.n", "y.n") * NUMERATOR
    close &= F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) * (NUMERATOR + DENOMINATOR) >= both
    return x.join(y, close).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def linked():
    """common / (size_a + size_b - common) ≥ 4/5, in whole numbers."""
    return F.col("common") * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.col("size_a") + F.col("size_b"))


def components(edges: DataFrame) -> DataFrame:
    """node, class_id (the smallest id it is connected with) of all nodes of the edges (a, b).

    Large-star and small-star steps until nothing changes; every step is written, so lineage stays short.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # large star: the larger neighbours of each node point to its smallest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of each node, and itself, point to its smallest
        large = written(large, "large")
        low2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "edges")
        total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        same = total(edges) == total(small)
        for old in (edges, low, large, low2):
            dropped(old)
        edges = small
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row: the smallest id of the documents it is connected with. All texts of one id are one document."""
    rows = written(signed(docs), "signatures")
    if not _repeats(rows):
        return _classes(docs, rows)
    dropped(rows)
    # rows take numbers of their own in place of ids; then the classes that hold rows of one id are joined
    own = written(with_text(docs).where("doc_id is not null").select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("doc_id"), "text"), "own-numbers")
    found = written(_classes(own, written(signed(own), "signatures")).join(own.select("doc_id", "id"), "doc_id").select("id", "class_id"), "classes")
    dropped(own)
    first = found.groupBy("id").agg(F.min("class_id").alias("a"))
    joined = components(found.join(first, "id").select("a", F.col("class_id").alias("b")))
    placed = found.join(joined.withColumnRenamed("class_id", "whole"), F.col("class_id") == F.col("node"), "left").select("id", F.coalesce("whole", "class_id").alias("whole"))
    placed = written(placed.distinct(), "placed")
    least = placed.groupBy("whole").agg(F.min("id").alias("class_id"))
    # an id is in one class only, so each row meets one
    return with_class(docs.select(F.col("doc_id").cast("long").alias("doc_id")), placed.join(least, "whole").select(F.col("id").alias("node"), "class_id"))


def _classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """classes() of documents whose ids do not repeat; rows: their signatures."""
    nodes = written(rows.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    entries = written(nodes.select(F.explode("bands").alias("bucket"), "node").distinct(), "entries")
    # buckets of two nodes and more, and for each the node that stands in the fullest buckets
    full = written(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = written(entries.join(full, "bucket"), "shared")
    dropped(entries)
    weight = written(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    pivots = written(shared.join(weight, "node").groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("weight"), F.col("node"))).alias("pivot")), "pivots")
    stars = written(shared.join(pivots, "bucket").select("bucket", "node", "pivot"), "stars")
    dropped(shared)
    # shingle sets of the nodes in question only; a node's id has one row, so its text is the node's
    asked = with_text(docs).join(weight.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = written(shingle_sets(asked), "shingles")
    first = written(verified(stars.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets), "star-links")
    copies = rows.where("doc_id is not null").join(nodes.select("text_key", "node"), "text_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    links = first.where(linked()).select("a", "b")
    found = written(components(links), "classes")
    # nodes of buckets that still hold several classes: of those in different classes, pairs that share rare shingles (an exact prefix filter)
    placed = stars.join(found, "node", "left").select("bucket", "node", F.coalesce("class_id", "node").alias("class_id"))
    mixed_buckets = written(placed.groupBy("bucket").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("bucket"), "mixed")
    asked = placed.join(mixed_buckets, "bucket").select(F.col("node").alias("doc_id"), "class_id").distinct()
    more = written(sharing_rare(sets.join(written(asked, "mixed-nodes"), "doc_id")), "cross-pairs")
    second = verified(more, sets).where(linked()).select("a", "b")
    final = written(components(written(links.unionByName(second).unionByName(copies), "links")), "classes")
    return with_class(rows, final)


def with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    joined = rows.select("doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _repeats(rows: DataFrame) -> bool:
    counts = rows.where("doc_id is not null").agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    return counts["n"] != counts["ids"]


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with all their columns; of each class only the document with the smallest id, once. Rows without an id stay."""
    found = written(classes(docs), "doc-classes")
    others = found.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(small(others.withColumnRenamed("doc_id", "__gone_id"), ID_BYTES), F.col("doc_id").cast("long") == F.col("__gone_id"), "left_anti")
    if not _repeats(found):
        return kept
    # of rows that repeat an id the one with the smallest text stays
    same = kept.where("doc_id is not null").withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__n = 1").drop("__n")
    return kept.where("doc_id is null").unionByName(same)
