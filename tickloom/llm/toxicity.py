"""Toxicity by compression distance: two zstandard dictionaries and the lengths of compressed windows.

One dictionary is trained on ordinary text, the other on the same base and on what recurs in toxic documents but hardly
in ordinary ones (words, or runs of bytes in them). That choice of the toxic dictionary's training text is a departure: trained on whole
windows of toxic documents, most of which are ordinary prose, the two dictionaries hardly differ where it matters (see the README's figures). Every document is cut at spaces into short windows; each window is compressed
with both, and the difference of the lengths says how much closer the window lies to toxic text. A logistic curve, calibrated
on labelled documents that neither dictionary saw, turns the figures of the differences into a probability. A few such pairs are
trained on different halves of the sample and averaged, as one pair depends on what it happened to see; a last curve, fitted on documents
that each pair had not seen, gives the score, 0.5 being the threshold of the best F1 at the share of toxic labels in the whole table. Labels come from a bounded
sample (`per_class` of each label) that leaves the held-out fifth alone; every text is scored whole.

Defined results: null text counts as empty, has one empty window and a score; repeated rows and ids are scored one by one;
without labels of both kinds (or too few to train a dictionary) every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, kept, labelled_sample, record_batch, with_text

WINDOW, LEVEL, PER_CLASS, LONGEST = 64, 3, 4000, 50_000
#: Most ordinary windows that a pair's dictionaries are trained on, chosen at random from the sample's.
WINDOWS = 80_000
#: Bytes of the shared base; sizes of the toxic part that calibration chooses from.
BASE, PARTS = 32 << 10, (512, 768, 1024, 1536, 2048, 3072)
#: Runs of bytes that mark a word as toxic recur so many times more than their share.
GRAM, EXCESS = 5, 6
FLAG = 0.5


def normal(text: str) -> bytes:
    return b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" "


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows that end at spaces where there are any; together they are data."""
    out, i, n = [], 0, len(data)
    while i < n:
        j = i + size
        if j < n and (k := data.rfind(b" ", i + 1, j)) > 0:
            j = k
        out.append(data[i:j])
        i = j
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def figures(text: str, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> list[float]:
    """Of the windows' differences: the largest, the mean, shares and counts over several thresholds, the share far below."""
    some = windows(normal(text))
    d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in some])
    n = len(some)
    over = [int((d >= t).sum()) for t in (3, 4, 5, 6)]
    return [float(d.max()), float(d.mean()) * 10, *(o / n * 10 for o in over[:3]), float((d <= -3).mean()) * 10, float(np.log1p(n)), *(float(np.log1p(o)) for o in over[1:])]


@dataclass
class Pair:
    """Contents of the two dictionaries and the curve over the figures."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def figures(self, texts: list[str], compressors: tuple | None = None) -> np.ndarray:
        a, b = compressors or (compressor(self.ordinary), compressor(self.toxic))
        return np.array([figures(t, a, b) for t in texts])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])


@dataclass
class Model:
    pairs: list[Pair]
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """A worker makes its compressors once per model."""
        owner = ("toxicity", hashlib.sha256(b"".join(p.ordinary + p.toxic for p in self.pairs)).hexdigest())
        made = kept(owner, lambda: [(compressor(p.ordinary), compressor(p.toxic)) for p in self.pairs])
        mean = np.mean([p.scores(p.figures(texts, c)) for p, c in zip(self.pairs, made)], axis=0)
        return sigmoid(self.slope * logit(mean) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def newton(a: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic curve over the columns of a."""
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = sigmoid(a @ w)
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(len(w)), a.T @ (p - y) + ridge * w)
    return w


def _calibrated(pair: Pair, x: np.ndarray, y: np.ndarray) -> float:
    """Fits the pair's curve; returns the mean log loss."""
    pair.mean, pair.scale = x.mean(0), x.std(0) + 1e-6
    pair.weights = newton(np.c_[(x - pair.mean) / pair.scale, np.ones(len(y))], y, 0.5)
    p = np.clip(pair.scores(x), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def grams(word: bytes) -> set[bytes]:
    """The runs of GRAM bytes in a word with the space before it (a shorter word: itself)."""
    word = b" " + word.strip(b".,;:!?")
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def recurring(toxic: list[bytes], ordinary: list[bytes], parts: Callable[[bytes], set[bytes]] = grams) -> list[bytes]:
    """Of each toxic document the words with parts that recur among toxic documents far more than among ordinary ones."""
    in_toxic, in_ordinary = (Counter(g for d in some for g in set().union(*map(parts, set(d.split())))) for some in (toxic, ordinary))
    usual, least = len(toxic) / max(1, len(ordinary)), max(3, len(toxic) // 150)
    signs = {g for g, n in in_toxic.items() if n >= least and n > EXCESS * usual * (in_ordinary[g] + 0.5)}
    found = (b" " + b" ".join(w.strip(b".,;:!?") for w in d.split() if not signs.isdisjoint(parts(w))) + b" " for d in toxic)
    return [x for x in found if len(x) > 2]


def whole_word(word: bytes) -> set[bytes]:
    return {word.strip(b".,;:!?")}


def fit_pair(data: list[bytes], texts: list[str], labels: np.ndarray, learn: np.ndarray, parts: Callable[[bytes], set[bytes]], rng: np.random.Generator) -> tuple[Pair, np.ndarray] | None:
    """The pair whose size calibrates best, and the probabilities of the documents that it did not learn from."""
    toxic = [d for d, y, own in zip(data, labels, learn) if y and own]
    ordinary = [d for d, y, own in zip(data, labels, learn) if not y and own]
    y = labels[~learn].astype(float)
    if not toxic or not ordinary or not y.size or y.min() == y.max():
        return None
    plain = [w for d in ordinary for w in windows(d)]
    plain = [plain[i] for i in rng.permutation(len(plain))[:WINDOWS]]
    half = len(plain) // 2
    signs = recurring(toxic, ordinary, parts)
    rest = [t for t, own in zip(texts, learn) if not own]
    best: tuple[float, Pair, np.ndarray] | None = None
    for size in PARTS:
        try:
            base = zstandard.train_dictionary(BASE, plain[:half], k=32, d=8).as_bytes()
            own = zstandard.train_dictionary(size, plain[half:], k=32, d=8).as_bytes()
            marked = zstandard.train_dictionary(size, signs, k=16, d=6).as_bytes()
        except zstandard.ZstdError:  # too few samples for this size
            continue
        pair = Pair(own + base, marked + base, np.zeros(0), np.ones(0), np.zeros(0))
        x = pair.figures(rest)
        loss = _calibrated(pair, x, y)
        if best is None or loss < best[0]:
            best = loss, pair, pair.scores(x)
    return best and best[1:]


def best_threshold(z: np.ndarray, y: np.ndarray, odds: float | None) -> float:
    """The threshold of the best F1, where ordinary documents weigh as they do in the whole table; it becomes the score 0.5."""
    weight = y.sum() / odds / max(1.0, (1 - y).sum()) if odds else 1.0
    order = np.argsort(-z, kind="stable")
    hits, false = np.cumsum(y[order]), np.cumsum(1 - y[order]) * weight
    k = int((2 * hits / (hits + false + y.sum())).argmax())
    return float(z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2


def fit(texts: list[str], labels: list[int], odds: float | None = None, seed: int = 5) -> Model | None:
    """Pairs that each learn from two thirds of the documents, and the last curve. odds: of toxic to ordinary in the whole table.

    None where no pair can be trained.
    """
    rng = np.random.default_rng(seed)
    data, y = [normal(t) for t in texts], np.array(labels, dtype=int)
    pairs, total, seen = [], np.zeros(len(texts)), np.zeros(len(texts))
    for parts in (whole_word, grams, grams):
        learn = rng.random(len(texts)) < 0.65
        if found := fit_pair(data, texts, y, learn, parts, rng):
            pairs.append(found[0])
            total[~learn] += found[1]
            seen[~learn] += 1
    if not pairs:
        return None
    out = seen > 0
    x, known = logit(total[out] / seen[out]), y[out].astype(float)
    slope = newton(np.c_[x, np.ones(len(x))], known, 0.05)[0]
    shift = -best_threshold(slope * x, known, odds)
    return Model(pairs, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fits on the driver on at most per_class documents of each label, of at most LONGEST characters, and WINDOWS ordinary windows a pair."""
    rows = labelled_sample(docs, labels, "toxic", per_class, LONGEST).collect()
    known = {r["toxic"]: r["n"] for r in labels.where(~held_out()).where("toxic in (0, 1)").groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    return fit([r["text"] for r in rows], [r["label"] for r in rows], known.get(1, 0) / max(1, known.get(0, 0)))


def score(docs: DataFrame, model: Model | None, flag: float = FLAG) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the model is some 200 kB whatever the input."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        scores = model.scores(texts) if model and texts else np.zeros(len(texts))
        return record_batch(schema, doc_id=batch.column(0), held_out=batch.column(2), score=scores, predicted=(scores >= flag).astype(np.int32))

    return arrow_map(with_text(docs).withColumn("held_out", held_out()), work, "doc_id long, held_out boolean, score double, predicted int")
