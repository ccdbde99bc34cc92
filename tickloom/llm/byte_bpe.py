"""Byte-level BPE encoding and decoding with a segment tree per piece.

A piece (one match of the splitting pattern) starts as its bytes. A segment tree over the byte positions holds,
at each leaf, the rank of the pair that starts there and, at each node, the smallest rank with the leftmost
position. The root names the next merge; the merge changes at most three leaves (the pair's own, the one
before and the one swallowed), each a walk of log2(n) nodes up the tree. Short pieces of one size are merged
together: their trees are rows of one array, and each step does every piece's next merge. Long pieces have a
tree of their own, so a piece of n bytes costs O(n log n).

Each task keeps the pieces that it has met in a cache of a fixed number of entries; a miss is computed anew.

Defined results: null text counts as empty and has no ids; rows are handled one by one, so repeated rows and ids
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, kept, record_batch, with_text

#: Pieces up to so many bytes share arrays; entries and longest key of the cache.
SHORT, CACHE, CACHE_KEY = 64, 400_000, 48
NONE = np.int64(1) << 62


class Codec:
    """The rank file's vocabulary; ranks are ids. Made once per Python worker."""

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        return kept(("codec", ranks_path, pattern), lambda: cls(ranks_path, pattern))

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: (left id, right id) → id of the two together, for every split of every token.
        self.pair = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.width = len(self.token)
        keys = np.array([a * self.width + b for a, b in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = np.append(keys[order], NONE), np.append(np.fromiter(self.pair.values(), dtype=np.int64, count=len(keys))[order], NONE)
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no token (an id below 0 stands for no neighbour)."""
        want = left * self.width + right
        at = np.searchsorted(self.keys, want)
        return np.where((self.keys[at] == want) & (right >= 0) & (left >= 0), self.merged[at], NONE)

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece with a tree of its own."""
        n = len(piece)
        ids, pair, none = self.byte[np.frombuffer(piece, np.uint8)].tolist(), self.pair, (1 << 62, 0)
        size = 1 << max(0, (n - 1).bit_length())
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (rank := pair.get((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = (rank, i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: tuple[int, int]) -> None:
            node = size + i
            if tree[node] == value:
                return
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        while tree[1] is not none and tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            ids[i], ids[gone] = rank, -1
            after[i] = right = after[gone]
            put(gone, none)
            if right < n:
                before[right] = i
                put(i, none if (r := pair.get((rank, ids[right]))) is None else (r, i))
            else:
                put(i, none)
            if (left := before[i]) >= 0:
                put(left, none if (r := pair.get((ids[left], rank))) is None else (r, left))
        return [x for x in ids if x >= 0]

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of at most SHORT bytes, by size; their trees are rows of one array. Little-endian 32-bit ids of each."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_size.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(k)
        for size, members in by_size.items():
            for first in range(0, len(members), 4096):
                some = members[first : first + 4096]
                for k, ids in zip(some, self._merge_rows([pieces[k] for k in some], size)):
                    out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        rows, width = len(pieces), size + 1
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
        length = np.array([len(p) for p in pieces])
        live = np.arange(size) < length[:, None]
        # column `size` stands for no neighbour, on either side
        ids = np.full((rows, width), -1, dtype=np.int64)
        ids[:, :size] = np.where(live, self.byte[raw], -1)
        after = np.minimum(np.tile(np.arange(1, width + 1), (rows, 1)), size)
        after[np.arange(rows), length - 1] = size
        before = np.tile(np.arange(-1, size), (rows, 1))
        before[:, 0] = size
        tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
        rank = self.ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, size)
        tree[:, size:] = np.where(rank == NONE, NONE, rank * size + np.arange(size))
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(r: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
            node = i + size
            tree[r, node] = np.where(rank == NONE, NONE, rank * size + i)
            while node.size and node[0] > 1:  # all leaves are on one level
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        r = np.flatnonzero(tree[:, 1] < NONE)
        while r.size:
            new, i = tree[r, 1] // size, tree[r, 1] % size
            gone = after[r, i]
            right = after[r, gone]
            ids[r, i], ids[r, gone] = new, -1
            after[r, i], before[r, right] = right, i
            put(r, gone, np.full(r.size, NONE))
            put(r, i, self.ranks_of(new, ids[r, right]))
            left = before[r, i]
            has = left < size
            put(r[has], left[has], self.ranks_of(ids[r[has], left[has]], new[has]))
            r = r[tree[r, 1] < NONE]
        kept = ids[:, :size]
        flat, ends = kept[kept >= 0].astype("<u4").tobytes(), np.cumsum((kept >= 0).sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks; the cache starts anew when it is full."""
        data = [(p, p.encode("utf-8", "surrogatepass")) for p in pieces]
        short = [x for x in data if len(x[1]) <= SHORT]
        found = {p: ids for (p, _), ids in zip(short, self.encode_short([b for _, b in short]))}
        found |= {p: np.array(self.encode_long(b), dtype="<u4").tobytes() for p, b in data if len(b) > SHORT}
        if len(self.cache) + len(found) > CACHE:
            self.cache.clear()
        self.cache.update((p, ids) for p, ids in found.items() if len(p) <= CACHE_KEY)
        return found

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """32-bit ids of each text, as encode_ordinary gives them."""
        split = [self.find(t) for t in texts]
        wanted: set[str] = set().union(*split)
        missing = wanted.difference(self.cache)
        known = self.cache
        if missing:  # learn() may empty the cache: what the batch needs is held apart
            known = {p: self.cache[p] for p in wanted - missing}
            known |= self.learn(missing)
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), "<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(ranks_path, pattern)
        return record_batch(schema, doc_id=batch.column(0), ids=[x.astype(np.int32) for x in codec.encode_batch(batch.column(1).to_pylist())])

    return arrow_map(with_text(docs), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, data binary: the bytes that the ids stand for. Null ids count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(ranks_path, pattern)
        return record_batch(schema, doc_id=batch.column(0), data=[codec.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()])

    return arrow_map(encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids"), work, "doc_id long, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every document in one pass and keeps digests of both."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(ranks_path, pattern)
        ids = codec.encode_batch(batch.column(1).to_pylist())
        return record_batch(
            schema,
            doc_id=batch.column(0),
            n_tokens=[len(x) for x in ids],
            ids_sha256=[hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids],
            decoded_sha256=[hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
        )

    return arrow_map(with_text(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
