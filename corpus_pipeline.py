"""From raw documents to packed training sequences, stage by stage.

Every stage takes the documents that the stage before kept and returns documents (the last: pieces of sequences). Between stages the
rows are written to the shared folder and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import line_dedup, near_dedup, packing, quality_fm, secret_scan
from tickloom.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject. It learns from labelled rows of docs (a bounded sample)."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier lines; a document that loses all lines stays, with an empty text."""
    return line_dedup.remove(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with found secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 4096."""
    # the stages share their executors' memory: fewer words are kept than where packing runs alone
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=100_000)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("secret scan", secrets), ("packing", pack)]

#: No SQL: models, signatures and tokenizers are not expressible; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
