"""Token counts of a word-end byte-pair vocabulary: strings proven to be one token are counted, only the rest is merged.

A pre-token (a run of letters, a digit, a run of other signs, an English ending) is merged by itself, so its count depends on
nothing around it. Before any text is read, every vocabulary string that can end a word goes through the merges alone; those that
come out as their own single token are the whole tokens. A pre-token among them counts one. All others are merged, and what a word
counts is kept for the task's next texts.

Words are what lies between blanks and line ends: neither the composition of characters nor a pre-token crosses those. Strings of
added tokens are taken out of a word first and count one each, as in the library.

Defined results: null text counts as empty and has no tokens; a null id stays null; repeated rows are rows of their own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import json
import re
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import arrow_map, kept, record_batch, with_text

LIMIT = 2048
#: Words that a task keeps the counts of, and the longest of them. Both bound memory only.
CACHE, CACHE_KEY = 600_000, 40
#: Signs that are whole tokens after a word.
SIGNS = frozenset(".,;:!?")
#: The pre-tokens of a lower-case ASCII word; other words go through the library's own splitter.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: What the shortcut takes for granted of a tokenizer file (fixed values).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def library(path: str):
    """The tokenizer of a file, if its words can be counted apart; ValueError otherwise."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
    split, *byte_level = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    added = parts["added_tokens"]
    if steps != NORMALIZERS or split.get("pattern") != {"Regex": SPLIT} or [x["type"] for x in byte_level] != ["ByteLevel"] or parts["model"]["end_of_word_suffix"] != "</w>":
        raise ValueError(f"{path}: not a lower-casing byte-pair vocabulary with word ends")
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or re.search(r"\s", x["content"]) for x in added):
        raise ValueError(f"{path}: an added token takes more than its own string")
    return tokenizer, [x["content"] for x in added]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file's tokens → the byte: printable bytes are themselves, the others follow from 256 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}


def whole_tokens(path: str) -> frozenset[str]:
    """The strings whose pre-token the merges alone turn into one token, their own: each word-ending string of the vocabulary is tried."""
    tokenizer, _ = library(path)
    letters, found = byte_letters(), set()
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        stem = token.removesuffix("</w>")
        if stem and stem != token and [t.id for t in tokenizer.model.tokenize(stem)] == [number]:
            with contextlib.suppress(UnicodeDecodeError):  # a part of a character is no pre-token
                found.add(bytes(letters[c] for c in stem).decode())
    return frozenset(found)


class Counts:
    """What a Python worker knows of words: tokens << 32 | merged tokens."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, added = library(path)
        self.whole, self.known = whole, {"": 0}
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")" if added else r"(?!)()")
        self.spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def pre_tokens(self, part: str) -> list[str]:
        if part.isascii() and part.isprintable():
            return ASCII.findall(part.lower())
        plain = self.tokenizer.normalizer.normalize_str(part)
        return [plain[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def merged(self, rest: list[str], plain: set[str]) -> dict[str, int]:
        """Tokens of pre-tokens. Those that the library would not change (`plain`, and what it leaves alone) go through it in one text; each ends
        with the one token that ends a word."""
        stable = [p for p in rest if p in plain or p.isascii() or self.tokenizer.normalizer.normalize_str(p) == p]
        ends = np.flatnonzero(self.last[np.array(self.tokenizer.encode(" ".join(stable), add_special_tokens=False).ids, dtype=np.int64)]) if stable else []
        found = dict(zip(stable, np.diff(ends, prepend=-1).tolist())) if len(ends) == len(stable) else {}
        return found | {p: len(self.tokenizer.model.tokenize(self.spelled(p)[0][0])) for p in rest if p not in found}

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of words that are not known yet."""
        counts: dict[str, int] = {}
        waiting: dict[str, list[str]] = {}  # words with pre-tokens that have to be merged
        plain: set[str] = set()  # lower-case letters in composed form
        whole = self.whole
        for word in words:
            sign = word[-1] in SIGNS
            base = word[:-1] if sign else word
            low = base.lower()
            if low.isalpha() and (base.isascii() or low.isascii() or "Σ" not in base and is_normalized("NFC", base) and is_normalized("NFC", low)):
                # letters, and one sign after them at most; neither holds an added token's string
                counts[word] = sign + (low in whole)
                if low not in whole:
                    waiting[word] = [low]
                    plain.add(low)
                continue
            tokens, rest = 0, []
            for k, part in enumerate(self.added.split(word)):
                if k % 2:
                    tokens += 1  # an added token's string
                    continue
                pre = self.pre_tokens(part)
                more = [p for p in pre if p not in whole]
                tokens += len(pre) - len(more)
                rest += more
            counts[word] = tokens
            if rest:
                waiting[word] = rest
        tokens_of = self.merged(list({p for rest in waiting.values() for p in rest}), plain)
        for word, rest in waiting.items():
            n = sum(map(tokens_of.__getitem__, rest)) if len(rest) > 1 else tokens_of[rest[0]]
            counts[word] = counts[word] + n << 32 | n
        return {w: n if w in waiting else n << 32 for w, n in counts.items()}

    def of_texts(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        wanted: set[str] = set().union(*split)
        found = self.learn(list(wanted.difference(self.known)))
        self.known.update(found)
        get = self.known.__getitem__
        out = [sum(map(get, words)) for words in split]
        for w in found:
            if len(w) > CACHE_KEY:
                del self.known[w]
        if len(self.known) > CACHE:
            self.known = {"": 0} | {w: self.known[w] for w in wanted if w in self.known}
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, and n_merged: how many of the tokens had to be merged."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_merged", pa.int64())])
    whole = whole_tokens(tokenizer_path)  # at most the vocabulary's size, sent with the task

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        packed = kept(("token counts", tokenizer_path), lambda: Counts(tokenizer_path, whole)).of_texts(texts.to_pylist())
        tokens = [p >> 32 for p in packed]
        n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
        return record_batch(schema, doc_id=batch.column(0), n_bytes=n_bytes, n_tokens=tokens, over_limit=[n > limit for n in tokens], n_merged=[p & 0xFFFFFFFF for p in packed])

    return arrow_map(with_text(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_merged long")
