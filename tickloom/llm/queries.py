"""One query per operator over its whole table, as the driver calls them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg_audio import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report

    return report(table(spark, sf_dir, "documents"))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import search, whole

    rows = whole(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where("vec_id % 20 = 0"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import report

    return report(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_mpeg_audio, op2_packing, op3_secret_scan, op4_byte_bpe, op5_warc, op6_line_dedup, op7_quality_fm, op8_near_dedup),
        *(op9_toxicity, op10_topk_search, op11_vector_codes, op12_lexical_search, op13_token_counts),
    )
}


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The product codes as SQL: one step for each assignment and each round's means."""
    nearest = lambda k: f"""a{k} AS (
            SELECT x.id, x.vec_id, x.label, x.p, x.w, arg_min(b.e, {{'d': list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS e,
                   min(list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS d
            FROM x JOIN b{k} b USING (p) GROUP BY ALL
        )"""  # noqa: E731
    means = lambda k: f"""u{k} AS (
            SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS w FROM (SELECT p, e, i, sum(w[i])::DOUBLE AS s, count(*) AS n FROM a{k}, range(1, len(w) + 1) r(i) GROUP BY ALL) GROUP BY ALL
        ), b{k + 1} AS (SELECT p, e, coalesce(u.w, b.w) AS w FROM b{k} b LEFT JOIN u{k} u USING (p, e))"""  # noqa: E731
    steps = ", ".join(f"{nearest(k)}, {means(k)}" for k in range(rounds)) + f", {nearest(rounds)}"
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS id FROM v
        ), x AS MATERIALIZED (
            SELECT id, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS w FROM o, range({parts}) r(p)
        ), b0 AS (SELECT p, id AS e, w FROM x WHERE id < {entries}), {steps}, t AS (
            SELECT id, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id
        ), s AS (
            SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM t, s
    """


ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, url, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op10_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op11_vector_codes": codes_sql(),
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), i AS (
            SELECT row_number() OVER () AS it, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
        ), q AS (
            SELECT it, item_id, term, count(*) AS c FROM (SELECT it, item_id, unnest(terms) AS term FROM i) GROUP BY ALL
        ), g AS (
            SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
        ), p AS (
            SELECT id, doc_id, n, term, count(*) AS tf FROM (SELECT id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
        ), f AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, n_docs
        ), s AS (
            SELECT it, item_id, id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM q JOIN f USING (term) JOIN p USING (term), g GROUP BY it, item_id, id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY it ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
    """,
    "op6_line_dedup": """
        WITH d AS (
            SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
        ), l AS (
            SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d
        ), t AS (
            SELECT *, list_sort(list_distinct(list_filter(string_split(lower(line), ' '), lambda x: x <> ''))) AS words FROM l
        ), s AS (
            SELECT words, len(words) AS n, min({'d': doc_id, 'l': line_no}) AS place, row_number() OVER (ORDER BY words) AS id FROM t WHERE doc_id IS NOT NULL AND len(words) > 0 GROUP BY words
        ), u AS (
            SELECT id, n, place, unnest(words) AS word FROM s
        ), f AS (
            SELECT word, count(*) AS df FROM u GROUP BY word
        ), p AS (
            SELECT id, n, place, word FROM u JOIN f USING (word)
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, word) <= n - (4 * n + 4) // 5 + 1
        ), c AS (
            SELECT DISTINCT a.id AS earlier, b.id AS later FROM p a JOIN p b USING (word)
            WHERE a.place < b.place AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
        ), m AS (
            SELECT DISTINCT later FROM c JOIN s a ON a.id = earlier JOIN s b ON b.id = later
            WHERE 9 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n)
        ), g AS (
            SELECT t.doc_id, t.text, t.line, t.line_no,
                   s.id IS NOT NULL AND (m.later IS NOT NULL OR s.place <> {'d': t.doc_id, 'l': t.line_no}) AS gone
            FROM t LEFT JOIN s ON t.words = s.words AND t.doc_id IS NOT NULL LEFT JOIN m ON m.later = s.id
        ), r AS (
            SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
            FROM g GROUP BY doc_id, text
        )
        SELECT d.doc_id, r.n_lines, r.n_removed, r.kept_sha256
        FROM documents d JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND coalesce(d.text, '') = r.text
    """,
}
