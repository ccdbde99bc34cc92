"""Packing documents into sequences of a fixed length: first-fit decreasing with a tournament tree.

Every document becomes its token ids and one end id. A document longer than a sequence is cut into full
sequences and a rest. The rests are dealt into randomised groups of about equal size; each group is packed on
its own, so no task holds more than a group. Within a group the rests go, longest first, each into the first bin
that has room. A tournament tree over the bins holds the larger room of each pair of bins, so the first bin
with room is found in log2(bins) steps.

Defined results: null text counts as empty and is one piece, the end id; repeated rows and ids are documents of
their own; equal lengths are placed by document id and row; extra columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import zlib
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept, record_batch, with_text, written

LENGTH, END_ID, GROUP = 4096, 2, 2048
#: Words and longest word that a task keeps the ids of.
CACHE, CACHE_KEY = 1_200_000, 40
#: Signs that stand after a word and are ids of their own there.
SIGNS = tuple(".,;:!?")


class WordIds:
    """Ids of texts by a tokenizer file, added tokens' strings included. White space never joins tokens here, so words are encoded apart and kept."""

    @classmethod
    def of(cls, path: str, words: int = CACHE) -> WordIds:
        return kept(("word ids", path, words), lambda: cls(path, words))

    def __init__(self, path: str, words: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = words
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a word, by the vocabulary's mark; the ids of single signs.
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.sign = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in SIGNS}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that the cache lacks. Words of letters, but for a last sign, go through the tokenizer in one text by their lower case."""
        letters: dict[str, str] = {}  # word → the lower-case letters that stand for it
        for w in words:
            base = w[:-1] if w[-1:] in SIGNS else w
            if base.isalpha() and (base.isascii() or is_normalized("NFC", base)):
                low = base.lower()
                if low.isascii() or ("Σ" not in base and low.isalpha() and is_normalized("NFC", low)):
                    letters[w] = low
        found = {}
        bases = [b for b in dict.fromkeys(letters.values()) if b not in self.cache]
        ids = np.array(self.tokenizer.encode(" ".join(bases), add_special_tokens=False).ids if bases else [], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(bases):  # each base is one word to the tokenizer
            flat, cuts = ids.tobytes(), (ends * 4).tolist()
            found = {b: flat[i:j] for b, i, j in zip(bases, [0, *cuts], cuts)}
            for w, b in letters.items():
                own = found[b] if b in found else self.cache[b]
                found[w] = own + self.sign[w[-1]] if w[-1] in SIGNS else own
        rest = [w for w in words if w not in found]
        found |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))}
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        wanted: set[str] = set().union(*split)
        found = self.learn(list(wanted.difference(self.cache)))
        self.cache.update(found)
        get = self.cache.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in found:
            if len(w) > CACHE_KEY:
                del self.cache[w]
        if len(self.cache) > self.words:  # only words of the last batch stay
            self.cache = {w: self.cache[w] for w in wanted if w in self.cache}
        return out


def pieces_of(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, words: int = CACHE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full sequences and a rest of each document."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    end = np.array([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, ids in zip(batch.column(0).to_pylist(), WordIds.of(tokenizer_path, words).encode_batch(batch.column(1).to_pylist())):
            ids += end
            for start in range(0, len(ids), 4 * length):
                piece = ids[start : start + 4 * length]
                for name, value in zip(cols, (doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                    cols[name].append(value)
        return record_batch(schema, **cols)

    return arrow_map(with_text(docs), work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (all at most capacity); sizes must be in falling order."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)  # room[1] is the most room of any bin
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node >>= 1
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, seed: int = 17, words: int = CACHE) -> DataFrame:
    """One row per piece with its sequence and offset. words: how many words' ids a worker keeps; fewer take less memory and more time."""
    pieces = written(pieces_of(docs, tokenizer_path, length, end_id, words), "pieces")
    # the written rows have a fixed order, so their numbers are the same whenever a task runs again
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == length).select(*pieces.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = max(1, round(pieces.where(F.col("length") < length).count() / group))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "row"], ascending=[False, True, True])
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=pdf["part"].astype("int64") * (1 << 32) + bins, offset=offsets).drop(columns=["row", "part"])

    rests = numbered.where(F.col("length") < length).withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).cast("int"))
    packed = rests.groupBy("part").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.unionByName(whole)
