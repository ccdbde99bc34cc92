"""Vector codes, ranked search and token counts against full comparisons and the library, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tickloom.llm import lexical_search, token_counts, vector_codes

WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, v int"
DOCS = "doc_id long, text string, lang string, n long, terms string, score long, item_id long"


def plain_codes(rows, parts, entries, rounds):
    """Every part against every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for turn in range(rounds + 1):
        found = []
        for _, v, _ in kept:
            d = [[sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]] for p in range(parts)]
            found.append([(min(x), x.index(min(x))) for x in d])
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], vector_codes.digest(np.array(books, object))) for (i, _, label), f, error in zip(kept, found, errors)), key=str)


@pytest.mark.parametrize("scale", [1.0, 2.0**38])
def test_codes_equal_a_full_comparison(spark, scale):
    """Ties, repeated rows and ids, nulls everywhere, and components whose distances leave 64 bits."""
    r = random.Random(5)
    points = [[r.choice([-2, -1, 0, 1, 2]) * scale / 4 for _ in range(8)] for _ in range(150)]
    rows = [(i // 2, p, r.choice([1, 2, None]), "c", 1, 2) for i, p in enumerate(points)]
    rows += [rows[3], rows[3], (None, points[0], None, "c", 1, 2), (900, None, 1, "c", 1, 2), (901, [None] * 8, 1, "c", 1, 2), (902, [math.nan] * 8, 1, "c", 1, 2), (903, [math.inf] * 8, 1, "c", 1, 2), (904, [], 1, "c", 1, 2)]
    df = spark.createDataFrame(rows, VECTORS)
    got = vector_codes.report(df, parts=4, entries=10, rounds=2)
    if scale > 1:  # errors beyond a long: before the cast of the report
        coded, books = vector_codes.codes(vector_codes.whole(df), 4, 10, 2)
        want = plain_codes(rows, 4, 10, 2)
        assert sorted(((x["vec_id"], x["code"].hex(), int(x["error"])) for x in coded.collect()), key=str) == sorted(((a, b, c) for a, b, c, _, _ in want), key=str)
        assert vector_codes.digest(books) == want[0][4]
    else:
        assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, 4, 10, 2)


def test_search_radius_leaves_out_far_entries_only():
    r = np.random.default_rng(3)
    book = vector_codes.Codebook(r.integers(-20, 20, (64, 4)))
    points = np.concatenate([r.integers(-25, 25, (3000, 4)), book.entries])
    full = ((points[:, None] - book.entries[None]) ** 2).sum(2)
    for start in (np.zeros(len(points), np.int64), full.argmin(1), r.integers(0, 64, len(points))):
        index, d = book.nearest(points, start)
        assert (index == full.argmin(1)).all() and (d == full.min(1)).all()
    near = book.inside(full.argmin(1), 4 * full.min(1))
    assert near.mean() < 32  # from the nearest entry on, half of the others are never looked at


def test_codes_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(i, [float(i)] * 16, None, "c", 1, 2) for i in range(3)], VECTORS)
    assert [r["code"] for r in vector_codes.report(few).orderBy("vec_id").collect()] == ["00" * 16, "01" * 16, "02" * 16]
    assert vector_codes.report(few.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.report(spark.createDataFrame([(1, [1.0] * 15, None, "c", 1, 2)], VECTORS))


def plain_search(docs, items, k):
    terms = lambda t: [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total = sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in counted:
            m = 75 + 25 * n * len(counted) // total
            s = sum(math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, rank + 1, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, seed", [(20, 1), (2, 2)])
def test_search_equals_scoring_everything(spark, monkeypatch, k, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "don", "t", "É1", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice([w, w.upper()]) for w in r.choices(vocabulary, weights, k=n))
    docs = [(i, text(r.randint(1, 80))) for i in range(400)]
    docs += [docs[5]] * 30 + [(7, "other w3 w4"), (None, docs[5][1]), (1000, None), (1001, ""), (1002, " .,\x00"), (1003, "w9 " * 20000)]
    items = [(i, text(r.randint(1, 25))) for i in range(25)] + [(3, "w1 w1 w1 w50"), (3, "w1"), (None, "w2 w59"), (90, None), (91, "absent"), (92, "")]
    monkeypatch.setattr(lexical_search, "PAIRS", 500)
    monkeypatch.setattr(lexical_search, "GATHER", 200)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 4000 if k == 20 else 1 << 20)  # two slices
    d = spark.createDataFrame([(i, t, "en", 1, "x", 2, 3) for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted((tuple(x) for x in lexical_search.search(d, q, k).collect()), key=str)
    assert got == plain_search(docs, items, k)
    assert lexical_search.search(d.limit(0), q, k).collect() == [] and lexical_search.search(d, q.limit(0), k).collect() == []


def test_thresholds_drop_terms():
    """Frequent terms of an item are not essential once rare ones have k documents."""
    items = lexical_search.Items([1], [[0, 1, 2]], [[1, 1, 1]], {b"a": 0, b"b": 1, b"c": 2})
    plan = lexical_search.Plan(items, {0: (20, 900_000, 800_000), 1: (900, 900_000, 900_000), 2: (950, 500_000, 500_000)}, 1000)
    assert plan.term.tolist() == [0, 1, 2] and plan.essential.tolist() == [True, False, False]
    assert plan.floor[0] == plan.factor[0] * 800_000 and plan.rest[0] < plan.floor[0]


NASTY = ["a <|endoftext|>b <|startoftext|><|endoftext|>", "H̱ İstanbul ΣΑΣ ﬁ ① x\x1cy \x85 \xa0z don't they'RE 'Sx'll 12345", "é e ́ ́", "😀‍ ॐ नमस्ते 한국어 한국어", "\x00\x01 a\tb\rc d ՘x౜", "", " ", "\n", "x" * 5000, "ẞ Ǆ İİ K Å İ̇ ab'd'm's!?..", None, "word " * 5000]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(9)
    pieces = [*"abcXYZ019.,;:!?'-_éßΣİ ́日한\n\t  ", "'s", "ing", "the", "<|endoftext|>", "<|", "😀"]
    texts = NASTY + ["".join(r.choices(pieces, k=r.randint(1, 60))) for _ in range(600)]
    rows = [(i if i % 7 else None, t, "en", 1, "x", 2, 3) for i, t in enumerate(texts)]
    got = token_counts.token_counts(spark.createDataFrame(rows, DOCS), WORDS, limit=1000).collect()
    library = Tokenizer.from_file(WORDS)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted((tuple(x)[:3] for x in got), key=str) == sorted(want, key=str)
    assert all(x["over_limit"] == (x["n_tokens"] > 1000) and 0 <= x["n_merged"] <= x["n_tokens"] for x in got)
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), WORDS).collect() == []


def test_whole_tokens_are_proven():
    whole = token_counts.whole_tokens(WORDS)
    assert {"the", "'s", "7", ".", "é"} <= whole and len(whole) > 30_000
    library = token_counts.library(WORDS)[0]
    plain = [s for s in whole if s.strip() and library.normalizer.normalize_str(s) == s]
    assert all(len(e.ids) == 1 for e in library.encode_batch(plain, add_special_tokens=False))
    with pytest.raises(ValueError):
        token_counts.library(public_tokenizers.path("byte_bpe_50k.json"))


def test_near_dedup_of_repeated_ids(spark):
    """All texts of an id count: rows against all rows, ids joined."""
    from tickloom.llm import near_dedup

    r = random.Random(12)
    text = lambda seed, n=60: " ".join("".join(random.Random(f"{seed} {k}").choices("abcdefgh", k=6)) for k in range(n))
    rows = [(1, text("A")), (1, text("B")), (2, text("A") + " more"), (3, text("B") + " more"), (4, text("C")), (None, text("A"))]
    rows += [(100 + r.randint(0, 40), text(f"family {r.randint(0, 30)}") + r.choice(["", " one", " two words"])) for _ in range(120)] + [(200, None), (201, ""), (200, text("D"))]
    known = [(i, t or "") for i, t in rows if i is not None]
    sets = [set(near_dedup.shingles(t)[0].tolist()) for _, t in known]
    found = {i: i for i, _ in known}
    for a in range(len(known)):
        for b in range(a):
            if known[a][0] == known[b][0] or known[a][1] == known[b][1] or sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((found[known[a][0]], found[known[b][0]]))
                found = {i: low if c == high else c for i, c in found.items()}
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows) and {x["doc_id"]: x["class_id"] for x in got} == found | {None: None}
    assert found[3] == found[2] == 1 and found[4] == 4 and found[201] == 200
    kept = near_dedup.keep_first(docs).collect()
    assert sorted(x["doc_id"] for x in kept if x["doc_id"] is not None) == sorted(set(found.values())) and len(kept) == len(set(found.values())) + 1


def test_guess_cost_of_long_values():
    """Values with runs, walks and blocks of any length, against all steps between all places; and the threshold as a limit."""
    from tickloom.llm import secret_scan as s

    rank_of = s.ranked("pass word abc hunter dragon correct horse battery staple".split())
    known: dict[tuple[str, bool], float] = {}

    def steps(v, blocks):
        low, plain = v.lower(), v.lower().translate(s.LEET)
        for i in range(len(v)):
            yield i, i + 1, s.char_cost(v[i])
            for j in range(i + 3, len(v) + 1):
                p = v[i:j]
                if 4 <= j - i <= 10 and p[0].isdigit() and s.DATE.fullmatch(p):
                    yield i, j, s.DATE_COST + s.STEP
                if all(low[k : k + 2] in s.NEXT for k in range(i, j - 1)):
                    yield i, j, s.WALK_START + s.WALK_STEP * math.log10(j - i) + s.STEP
                if low[i:j] in rank_of or plain[i:j] in rank_of:
                    leet = 0.0 if low[i:j] in rank_of else math.log10(4)
                    case = 0.0 if p.islower() or not p.isalpha() else math.log10(2) if p.istitle() or p.isupper() else math.log10(j - i) + 1
                    yield i, j, math.log10(rank_of.get(low[i:j], rank_of.get(plain[i:j]))) + leet + case + s.STEP
                for size in range(1, (j - i) // 2 + 1):
                    block, times = p[:size], (j - i) // size
                    if p == block * times and times >= (3 if size == 1 else 2) and (size == 1 or blocks) and not (size > s.BLOCK and (block + block).find(block, 1) < size):
                        yield i, j, (s.char_cost(block) if size == 1 else cheapest(block, False)) + math.log10(times) + s.STEP

    def cheapest(v, blocks=True):
        if (v, blocks) not in known:
            best = [0.0] + [math.inf] * len(v)
            for i, j, cost in sorted(steps(v, blocks)):
                best[j] = min(best[j], best[i] + cost)
            known[v, blocks] = best[-1]
        return known[v, blocks]

    r = random.Random(77)
    pieces = ["a", "b", "aa", "qwerty", "asdf", "abc", "1", "2024", "pass", "word", "Hunter", "xY", "z9", "correcthorsebattery", "abcdefghij", "-", "ab", "ba", "12"]
    values = ["correcthorsebattery" * 2, "z9" + "qwerty" * 15, "kxvqzjwmhtrbpdngcs" * 2, "aaaab" * 20]
    for _ in range(120):
        v = "".join(r.choice(pieces) * r.choice([1, 1, 2, 3, 8, 20]) for _ in range(r.randint(1, 5)))[:110]
        values.append((v[:36] * 3) if r.random() < 0.4 else v)
    for v in values:
        want, limited = cheapest(v), s.guess_cost(v, rank_of, limit=10)
        assert s.guess_cost(v, rank_of) == pytest.approx(want, abs=1e-9), v
        assert limited >= 10 if want >= 10 else limited == pytest.approx(want, abs=1e-9), v
    for long in ("a" * 20_000, "ab" * 10_000, "correcthorsebatterystaple12" * 800):
        assert s.guess_cost(long, rank_of, limit=10) < 11
