"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import random

import corpus_pipeline
from test_llm_operators import brute_classes, brute_lines, words


def corpus(spark, path):
    r = random.Random(1)
    base = "\n".join(words(k, 30) for k in range(8))
    near = base.split(" ")
    near[5] = "changed"
    rows = [(i, "\n".join(words(100 * i + k, 25) for k in range(5))) for i in range(1, 200)]
    rows += [(200, base), (201, base), (202, " ".join(near)), (203, words(7000, 40) + " password=b7db7aa4a5fcc78305"), (204, None), (205, (words(3, 1) + "!! ") * 60)]
    rows += [(i, (words(i, 1) + "!! ") * r.randint(40, 80)) for i in range(300, 420)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i < 200 or i >= 300], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages(spark, tmp_path):
    docs, sf = corpus(spark, str(tmp_path)), str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "secret scan", "packing"]
    good = corpus_pipeline.quality(spark, docs, sf)
    ids = {r["doc_id"] for r in good.collect()}
    assert set(range(1, 200)) | {200, 201, 202, 203} <= ids and not ids & set(range(300, 420))
    before = [(r["doc_id"], r["text"]) for r in good.collect()]
    gone = brute_lines(before)
    lines = corpus_pipeline.lines(spark, good, sf)
    want = {i: "\n".join(l for k, l in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before if t is not None}
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert {i: t for i, t in got.items() if t is not None} == want and lines.columns == docs.columns
    near = corpus_pipeline.near_duplicates(spark, good, sf)
    assert {r["doc_id"] for r in near.collect()} == set(brute_classes(before).values())
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, good, sf).collect()}
    assert "b7db7aa4" not in clean[203] and all(clean[i] == t for i, t in before if i != 203)


def test_run(spark, tmp_path):
    corpus(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    per_doc = {}
    for r in rows:
        per_doc.setdefault(r["doc_id"], []).append(r)
    assert 200 in per_doc and 203 in per_doc and 300 not in per_doc and all(sum(p["length"] for p in own) == own[0]["doc_tokens"] for own in per_doc.values())
