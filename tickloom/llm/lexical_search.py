"""Ranked lexical search for a set of items: thresholds out of stored kth impacts, safe pruning, exact rescoring.

1. Index: one pass over the texts keeps, of each document, its number of terms and the frequencies of the items' terms (written).
2. Impacts: what one occurrence-weighted term adds to a document's score, before the term's weight. Each task keeps a term's k
   largest; merged in two levels they give, per term, the documents that hold it, its largest impact and its kth.
3. Thresholds: if k documents hold a term, k documents score at least its weight times its kth impact. The best term of an item
   bounds the item's kth score from below. The item's terms are put in falling order of their largest contributions; those at the
   end whose contributions together stay under the threshold are not essential: a document with none but them is out.
4. Join: postings of essential terms meet the items that have them; a document's sum so far and the largest contributions of the
   rest must reach the threshold, which a task raises as its own kth scores grow. Who is left is rescored over all terms, exactly.
   Each task hands on k documents an item at most; these are ranked in two levels.

Items go through all steps in slices of bounded size, so neither the driver nor a task ever holds more than a slice and a batch of documents.

Defined results: a null or empty text has no terms and is never found; an item without terms gives no rows; documents and items are rows,
so repeated ids stand for themselves (items with one id: each with its own ranks); equal scores by doc_id, nulls last; extra
columns are ignored; empty tables give no rows. A number of terms so large that 25 * n * N leaves 64 bits is divided exactly all the same.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, bounded, dropped, record_batch, sized, with_text, written

K = 20
#: Bytes of items' texts that are searched for at a time, about: what the driver and each task hold of them.
ITEM_BYTES = 2 << 20
#: Parts in which a term's and an item's best rows are merged first.
SALTS = 64
#: Impacts that a task gathers before it keeps only the largest.
GATHER = 1 << 20
#: Postings that meet items at a time.
PAIRS = 1 << 21
#: ASCII letters and digits and all bytes beyond ASCII are terms' bytes; A to Z count as a to z, the rest parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Items:
    """A slice of the query set: ids and, of each item, its distinct terms' numbers and counts; vocabulary: term → number."""

    ids: list
    terms: list[list[int]]
    counts: list[list[int]]
    vocabulary: dict[bytes, int]


def items_of(items: DataFrame) -> Items:
    out = Items([], [], [], {})
    for row in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        counted = Counter(terms_of(row["text"].encode()))
        if counted:
            out.ids.append(row["item_id"])
            out.terms.append([out.vocabulary.setdefault(t, len(out.vocabulary)) for t in counted])
            out.counts.append(list(counted.values()))
    return out


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term: all its terms counted, the vocabulary's with their frequencies."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    get = vocabulary.get

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ns, terms, tfs = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = terms_of(text)
            if words:
                found = np.array([t for t in map(get, words) if t is not None], np.int32)
                kinds, tf = np.unique(found, return_counts=True)
                ids.append(doc_id)
                ns.append(len(words))
                terms.append(kinds)
                tfs.append(tf)
        return record_batch(schema, doc_id=ids, n=ns, terms=terms, tfs=tfs)

    return arrow_map(with_text(docs), work, "doc_id long, n long, terms array<int>, tfs array<int>")


def lengths(n: np.ndarray, total: int, documents: int) -> np.ndarray:
    """m of each document; whole numbers of any size."""
    return np.array([75 + 25 * x * documents // total for x in n.tolist()], np.int64)


def postings(batch: pa.RecordBatch, total: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document's place in the batch, term and impact of each posting, by document and term."""
    terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy().astype(np.int64)
    sizes = terms.value_lengths().to_numpy()
    docs = np.repeat(np.arange(len(sizes)), sizes)
    m = lengths(batch.column("n").to_numpy(), total, documents)
    return docs, terms.flatten().to_numpy().astype(np.int64), 1_000_000_000 * tfs // (1000 * tfs + 12 * m[docs])


def largest(term: np.ndarray, impact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest impacts of each term."""
    order = np.lexsort((-impact, term))
    term, impact = term[order], impact[order]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    place = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
    return term[place < k], impact[place < k]


def term_table(indexed: DataFrame, total: int, documents: int, k: int = K) -> DataFrame:
    """term, df, top (its k largest impacts, falling): df and tops of each task's documents, merged in two levels."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64()), ("top", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        term, impact = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting = [(term, impact)]
        for batch in (b for whole in batches for b in sized([whole])):
            _, t, i = postings(batch, total, documents)
            kinds, n = np.unique(t, return_counts=True)
            df.update(dict(zip(kinds.tolist(), n.tolist())))
            waiting.append((t, i))
            if sum(len(t) for t, _ in waiting) > GATHER + len(term):
                term, impact = largest(np.concatenate([t for t, _ in waiting]), np.concatenate([i for _, i in waiting]), k)
                waiting = [(term, impact)]
        term, impact = largest(np.concatenate([t for t, _ in waiting]), np.concatenate([i for _, i in waiting]), k)
        kinds, starts = np.unique(term, return_index=True)
        if len(kinds):
            yield record_batch(schema, term=kinds, df=[df[t] for t in kinds.tolist()], top=np.split(impact, starts[1:]))

    bounded(indexed.sparkSession)
    parts = indexed.mapInArrow(run, "term int, df long, top array<long>").withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top")
    return parts.groupBy("term", "__salt").agg(F.sum("df").alias("df"), merged).groupBy("term").agg(F.sum("df").alias("df"), merged)


class Plan:
    """Items' terms in falling order of their largest contributions, item after item.

    start[i]:start[i + 1] are item i's terms; factor: weight times count; floor: a score that the item's kth reaches; essential:
    terms without which no document gets there; rest: what all other terms can add together.
    """

    def __init__(self, items: Items, table: dict[int, tuple[int, int, int | None]], documents: int):
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, (df, _, _) in table.items()}
        known = [sorted(((c * weight[t] * table[t][1], t, c * weight[t]) for t, c in zip(terms, counts) if t in table), reverse=True) for terms, counts in zip(items.terms, items.counts)]
        sizes = [len(x) for x in known]
        most, self.term, self.factor = (np.array([row[c] for x in known for row in x], np.int64) for c in range(3))
        self.start, self.item = np.append(0, np.cumsum(sizes)).astype(np.int64), np.repeat(np.arange(len(known)), sizes)
        # only scores above 0 count
        self.floor = np.array([max([1, *(f * table[t][2] for _, t, f in x if table[t][2] is not None)]) for x in known], np.int64)
        sums = np.append(np.cumsum(most[::-1])[::-1], 0)
        on = sums[:-1] - sums[self.start[self.item + 1]]  # of the term and those after it
        self.essential = on >= self.floor[self.item]
        self.rest = np.zeros(len(known), np.int64)
        np.add.at(self.rest, self.item[~self.essential], most[~self.essential])


class Matcher:
    """One task's search: candidates of batches of documents, and the k best of each item so far."""

    def __init__(self, plan: Plan, vocabulary: int, k: int):
        self.plan, self.vocabulary, self.k, self.floor = plan, vocabulary, k, plan.floor.copy()
        self.best: dict[int, list[tuple]] = {}
        essential = np.flatnonzero(plan.essential)
        self.by_term = essential[np.argsort(plan.term[essential], kind="stable")]
        self.first = np.searchsorted(plan.term[self.by_term], np.arange(vocabulary + 1))

    def candidates(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, document) pairs that may reach the item's floor: the sums of the essential terms and what the rest can add."""
        meets = self.first[terms + 1] - self.first[terms]
        keys, sums = [], []
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(meets), np.arange(0, meets.sum() + PAIRS, PAIRS), side="left"), len(terms)))
        # a document's postings stay together
        cuts = np.unique(np.searchsorted(docs, docs[np.minimum(cuts, len(docs) - 1)], side="left"))
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(terms)).tolist()):
            n = meets[lo:hi]
            which = np.repeat(np.arange(lo, hi), n)
            place = self.by_term[np.repeat(self.first[terms[lo:hi]], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
            key, pair = np.unique(self.plan.item[place] * n_docs + docs[which], return_inverse=True)
            got = np.zeros(len(key), np.int64)
            np.add.at(got, pair, self.plan.factor[place] * impacts[which])
            keys.append(key)
            sums.append(got)
        key, got = np.concatenate(keys), np.concatenate(sums)
        item = key // n_docs
        may = got + self.plan.rest[item] >= self.floor[item]
        return item[may], (key % n_docs)[may]

    def scores(self, item: np.ndarray, doc: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """The whole score of each pair."""
        n = self.plan.start[item + 1] - self.plan.start[item]
        pair = np.repeat(np.arange(len(item)), n)
        place = np.repeat(self.plan.start[item], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        have, want = docs * self.vocabulary + terms, doc[pair] * self.vocabulary + self.plan.term[place]
        at = np.minimum(np.searchsorted(have, want), max(0, len(have) - 1))
        hit = have[at] == want
        out = np.zeros(len(item), np.int64)
        np.add.at(out, pair[hit], self.plan.factor[place[hit]] * impacts[at[hit]])
        return out

    def see(self, batch: pa.RecordBatch, total: int, documents: int) -> None:
        docs, terms, impacts = postings(batch, total, documents)
        if not len(terms):
            return
        items, places = self.candidates(docs, terms, impacts, batch.num_rows)
        ids = batch.column("doc_id").to_pylist()
        step = max(1, PAIRS // max(1, int(np.diff(self.plan.start).max())))
        for lo in range(0, len(items), step):
            item, place = items[lo : lo + step], places[lo : lo + step]
            score = self.scores(item, place, docs, terms, impacts)
            good = score >= self.floor[item]
            for i, p, s in zip(item[good].tolist(), place[good].tolist(), score[good].tolist()):
                self.best.setdefault(i, []).append((-s, ids[p] is None, ids[p] or 0))
        for i in {*items.tolist()} & self.best.keys():
            kept = self.best[i] = sorted(self.best[i])[: self.k]
            if len(kept) == self.k:
                self.floor[i] = max(self.floor[i], -kept[-1][0])


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest scores above 0."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + size // ITEM_BYTES
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    out = None
    for n in range(slices):
        some = searched(docs, items_of(items.where(part == n)), k)
        out = some if out is None else out.unionByName(some)
    return out


def searched(docs: DataFrame, wanted: Items, k: int) -> DataFrame:
    ddl = "item int, item_id long, doc_id long, score long, part int"
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])
    indexed = written(index(docs, wanted.vocabulary), "lexical-index")
    documents, total = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    impacts = written(term_table(indexed, total, documents, k), "lexical-impacts")
    # three numbers for each term of the items
    table = {r[0]: (r[1], r[2], r[3]) for r in impacts.select("term", "df", F.col("top")[0], F.try_element_at("top", F.lit(k))).toLocalIterator()}
    plan = Plan(wanted, table, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        matcher = Matcher(plan, len(wanted.vocabulary), k)
        for batch in sized(batches):
            matcher.see(batch, total, documents)
        salt = TaskContext.get().partitionId() % SALTS
        for i, kept in matcher.best.items():
            n = len(kept)
            yield record_batch(schema, item=[i] * n, item_id=[wanted.ids[i]] * n, doc_id=[None if null else d for _, null, d in kept], score=[-s for s, _, _ in kept], part=[salt] * n)

    found = written(indexed.mapInArrow(run, ddl), "lexical-found")
    dropped(indexed)
    dropped(impacts)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
