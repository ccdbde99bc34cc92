"""Secret scan: fixed patterns, and guess-cost estimates of values that stand in credential contexts.

Base spans come from three patterns. The method looks at every value that follows a credential word and
finds the cheapest way to guess it: dynamic programming over the value's positions, where a step is a listed
word (also capitalised or with digits for letters), a date, a repeat of a block, a walk along a keyboard row or
alphabet, or one brute-force character. Words are those that guessers try first, then the whole words of a public tokenizer by
its ranks, then the words that most documents hold outside such values (at most 50,000). Final punctuation is not priced. Costs are log10 of guesses and add up. Values at or over a threshold become
spans of kind "guess"; base spans stay.

Defined results: null text counts as empty and has no spans; rows are handled one by one, so repeated rows and
ids give repeated results; extra columns of the input are ignored. Values of any length are scanned whole; what costs the threshold
already is not looked into further, and repeats and walks are followed only while they may be the cheapest.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from math import inf, log10

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded, dropped, kept, record_batch, with_text, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Contexts of the method: more words and separators than ASSIGN; the value is any run without spaces or quotes.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credential|private[_-]?key)s?["']?\x20{0,3}(?:[:=]|=>|\x20is\x20)\x20{0,3}["'`]?([^\s"'`,;<>]+)""",
    re.I | re.A,
)
#: Words that guessers try first, commonest first; the rank is the number of guesses.
WORDS = (
    "password qwerty admin letmein welcome monkey dragon master login princess football shadow sunshine baseball "
    "superman trustno1 hello freedom whatever test secret root pass guest default changeme summer winter spring "
    "autumn love charlie michael jordan ashley jennifer hunter soccer batman starwars computer internet service "
    "access server user system manager backup oracle example temp demo company office monday friday january june "
    "july august december london paris berlin madrid please orange purple silver golden happy lucky magic flower"
).split()
#: Most words that are counted over the documents, and their lengths.
COUNTED, SHORTEST, LONGEST = 50_000, 4, 24
LEET = str.maketrans("@4310$5!7", "aaeiossit")
#: Runs of neighbouring keys, along rows and down columns, and the alphabet.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.", "0p;")
NEXT = {a + b for row in ROWS for line in (row, row[::-1]) for a, b in zip(line, line[1:])}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)\d\d|(?:19|20)\d\d")
#: log10 of guesses: a step's overhead, so that many tiny steps don't beat one; a date; a walk's start and turn.
STEP, DATE_COST, WALK_START, WALK_STEP = 0.3, log10(365 * 60), log10(47 * 2), 0.3
THRESHOLD = 10.0
#: Blocks of repeats up to this length are tried one by one; longer ones are searched for.
BLOCK = 16
#: What ends a sentence or a bracket after a value.
FINAL = ".!?:)]}\u2026"


@cache
def ranks() -> dict[str, int]:
    """word → number of guesses: WORDS, then the whole words of the tokenizer's vocabulary."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = [t[:-4] for t, _ in sorted(vocabulary.items(), key=lambda e: e[1]) if t.endswith("</w>")]
    return ranked([*WORDS, *(w for w in whole if SHORTEST <= len(w) <= LONGEST and w.isascii() and w.isalpha())])


def ranked(words: list[str]) -> dict[str, int]:
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}


def counted_words(docs: DataFrame) -> list[str]:
    """The words that most documents hold outside values of credential contexts, two documents at least; at most COUNTED."""
    text = F.regexp_replace(F.col("text"), "(?i)" + CONTEXT.pattern, " ")
    each = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w.rlike(rf"^\p{{L}}{{{SHORTEST},{LONGEST}}}$"))
    counts = docs.where("text is not null").select(F.explode(each).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts.withColumn("octave", F.floor(16 * F.log2("n")).cast("int")), "word-counts")
    # by sixteenths of an octave of the counts: no more words than those of the last one that is needed come to the driver
    lowest, held = 0, 0
    for row in counts.groupBy("octave").agg(F.count("*").alias("words")).orderBy(F.desc("octave")).collect():  # some thousand rows at most
        lowest, held = row["octave"], held + row["words"]
        if held >= COUNTED:
            break
    top = [r["w"] for r in counts.where(F.col("octave") >= lowest).orderBy(F.desc("n"), "w").limit(COUNTED).collect()]
    dropped(counts)
    return top


def char_cost(c: str) -> float:
    """log10 of the alphabet that a guesser must try for this character."""
    return 1.0 if c.isdigit() else 1.415 if c.isascii() and c.isalpha() else 1.52 if c.isascii() else 2.0


def repeats(value: str, i: int, same: dict[int, int]) -> Iterator[tuple[int, int]]:
    """(size, times) of the blocks at i that follow themselves, at least once.

    Blocks of up to BLOCK characters are tried one by one. Longer ones are sought where their first characters come again; those that are repeats of
    a shorter block already given are passed over, as they are that block's repeats. same: by size, where value stops to equal itself so much later.
    """
    n = len(value)
    covered = i  # up to here a shorter block's repeats reach

    def run(size: int) -> int:
        if same.get(size, 0) <= i:
            j = i
            while j + size < n and value[j] == value[j + size]:
                j += 1
            same[size] = j
        return (same[size] - i) // size + 1

    for size in range(1, min(BLOCK, (n - i) // 2) + 1):
        times = run(size)
        if times > 1:
            covered = max(covered, same[size] + size)
            yield size, times
    size, head = BLOCK, value[i : i + BLOCK + 1]
    while True:
        size = max(size + 1, (covered - i) // 2 + 1)
        if 2 * size > n - i or (at := value.find(head, i + size, i + (n - i) // 2 + len(head))) < 0:
            return
        size = at - i
        times = run(size)
        if times > 1:
            covered = max(covered, same[size] + size)
            yield size, times


def guess_cost(value: str, rank_of: dict[str, int] | None = None, blocks: bool = True, limit: float = inf) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for an empty value. From `limit` on, any number that is not less.

    A repeat or walk may begin and end at every place of a longer one. Their costs grow ever slower with their lengths, a walk's slower than a
    repeat's, so of two that have the same ends before them the earlier, once it is the cheaper, stays so: a later start is followed only until then.
    """
    rank_of = ranks() if rank_of is None else rank_of
    n = len(value)
    best = [0.0] + [inf] * n
    lower, plain = value.lower(), value.lower().translate(LEET)
    if len(lower) != n:  # a letter whose lower case is longer: no words are looked for
        lower = plain = value
    same: dict[int, int] = {}
    costs: dict[str, float] = {}
    #: Runs that no earlier one beats at their end: start, cost, slope, unit, and how far they reach.
    leaders: list[tuple[int, float, float, int, int]] = []
    walk = 0  # end of the walk that begins at or before i
    for i in range(n):
        here = best[i]
        # brute force: one character; the overhead is paid by other kinds only
        best[i + 1] = min(best[i + 1], here + char_cost(value[i]))
        if here >= limit:
            continue

        def step(end: int, cost: float, here: float = here) -> None:
            if here + cost + STEP < best[end]:
                best[end] = here + cost + STEP

        def follow(ends: range, cost: float, slope: float, unit: int, i: int = i) -> None:
            """Steps from i to the ends, of cost + slope * log10(length / unit), while no earlier run that has the same ends is cheaper."""
            if not ends:
                return
            last = ends[-1]
            rivals = [r for r in leaders if r[4] >= last and r[2] <= slope and (r[2] < 1 or ends.step % r[3] == 0 and (last - r[0]) % r[3] == 0)]
            for end in ends:
                mine = cost + slope * log10((end - i) / unit)
                for start, theirs, flat, per, _ in rivals:
                    if theirs + flat * log10((end - start) / per) <= mine:
                        return
                best[end] = min(best[end], mine)
            leaders.append((i, cost, slope, unit, last))

        if value[i].isdigit():
            for end in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, end):
                    step(end, DATE_COST)
        if len(leaders) > 64:
            leaders = [r for r in leaders if r[4] > i]
        if walk <= i:
            walk = i + 1
            while walk < n and lower[walk - 1 : walk + 1] in NEXT:
                walk += 1
        follow(range(i + 3, walk + 1), here + WALK_START + STEP, WALK_STEP, 1)
        for size, times in repeats(value, i, same):
            least = 3 if size == 1 else 2
            if times < least or size > 1 and not blocks:
                continue
            block = value[i : i + size]
            if size > 1 and block not in costs:
                costs[block] = guess_cost(block, rank_of, False, limit)
            one = char_cost(block) if size == 1 else costs[block]
            follow(range(i + least * size, i + times * size + 1, size), here + one + STEP, 1.0, size)
        for end in range(i + 3, min(n, i + LONGEST) + 1):
            rank, leet = rank_of.get(lower[i:end]), 0.0
            if rank is None and (rank := rank_of.get(plain[i:end])) is not None:
                leet = log10(4)
            if rank is not None:
                case = 0.0 if value[i:end].islower() or not value[i:end].isalpha() else log10(2) if value[i:end].istitle() or value[i:end].isupper() else log10(end - i) + 1
                step(end, log10(rank) + leet + case)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three patterns, whole matches, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, threshold: float = THRESHOLD, rank_of: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """Values in credential contexts whose guess cost, without final punctuation, reaches the threshold."""
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1].rstrip(FINAL), rank_of, limit=threshold) >= threshold]


def all_spans(text: str, threshold: float = THRESHOLD, rank_of: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    return sorted(base_spans(text) + guess_spans(text, threshold, rank_of))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_values(text: str, threshold: float = THRESHOLD, rank_of: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """What redaction replaces: disjoint (start, end); of an assignment only its value."""
    cut = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    cut += [(a, b) for a, k, b in all_spans(text, threshold, rank_of) if k]
    out: list[tuple[int, int]] = []
    for a, b in sorted(cut):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redacted(text: str, threshold: float = THRESHOLD, mark: str = "[SECRET]", rank_of: dict[str, int] | None = None) -> str:
    parts, last = [], 0
    for a, b in secret_values(text, threshold, rank_of):
        parts += [text[last:a], mark]
        last = b
    return "".join([*parts, text[last:]]) if parts else text


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts and spans of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_guess", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    words = counted_words(docs)
    owner = ("secrets", hashlib.sha256("\n".join(words).encode("utf-8", "surrogatepass")).hexdigest())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank_of = kept(owner, lambda: ranked([*ranks(), *words]))
        cols: dict[str, list] = {f.name: [] for f in schema}
        for text in batch.column(1).to_pylist():
            base, guess = base_spans(text), guess_spans(text, threshold, rank_of)
            kinds = [k for _, k, _ in base]
            for k in range(3):
                cols["n_" + KINDS[k]].append(kinds.count(k))
            cols["n_guess"].append(len(guess))
            cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols["spans"].append(joined(sorted(base + guess)))
        return record_batch(schema, **cols | {"doc_id": batch.column(0)})

    return arrow_map(with_text(docs), work, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the secrets in text replaced and n_chars counted anew; same columns, null texts stay null."""

    words = counted_words(docs)
    owner = ("secrets", hashlib.sha256("\n".join(words).encode("utf-8", "surrogatepass")).hexdigest())

    @F.pandas_udf("string")
    def clean(texts):
        rank_of = kept(owner, lambda: ranked([*ranks(), *words]))
        return texts.map(lambda t: t if t is None else redacted(t, threshold, rank_of=rank_of))

    bounded(docs.sparkSession)
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
