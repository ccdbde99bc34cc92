"""What the operators share: the shared folder, written intermediates, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an operator handles at a time inside a task.
CHUNK_ROWS, CHUNK_BYTES = 2000, 2 << 20
#: Most bytes that a join broadcasts.
BROADCAST_BYTES = 32 << 20
TIDY_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_KEY, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


#: What a Python worker keeps between batches, by owner.
_KEPT: dict[tuple, object] = {}


def kept(owner: tuple, make: Callable[[], object]):
    """The worker's state of one owner, made at first use. A worker that turns to another owner drops the state before and gives its memory back."""
    if owner not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)
        _KEPT[owner] = make()
    return _KEPT[owner]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session (tests) gets one of this machine; a cluster's must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While it holds, Spark deletes a job's shuffle files when the job ends; the session's own setting comes back after."""
    before = spark.conf.get(TIDY_KEY, "false")
    spark.conf.set(TIDY_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY_KEY, before)


def written(df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here and nothing is computed twice.

    The files stay until dropped() or until the shared folder is cleaned: results are lazy and may read them later.
    hashes: most of the data are hashes, which neither a codec nor a dictionary makes smaller.
    """
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", "snappy" if hashes else "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a written() frame that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each holds few rows and bytes, whatever the rows' lengths (one row at least)."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(CHUNK_ROWS, CHUNK_BYTES // per_row))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def bounded(spark: SparkSession) -> None:
    """Batches between Spark and Python hold few bytes, unless the session says otherwise: Spark's default of 64 MB is held several times over."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, str(CHUNK_BYTES))


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over small slices; work sees one slice at a time."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            yield work(batch)

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text; a null text is an empty one."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)



def held_out(doc_id: str = "doc_id"):
    """True for rows that never teach a classifier: crc32 of the id as text, mod 5, is 0 (null id: held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> DataFrame:
    """doc_id, text, label of at most per_class documents of each label, chosen by the hash of their id.

    Rows whose id falls into the held-out fifth never appear, nor do null labels and texts over `longest` characters.
    The bound holds whatever the input's size: only chosen ids are joined to documents, and repeated ids count once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out() & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    out = None
    for value in (0, 1):
        some = found.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        out = some if out is None else out.unionByName(some)
    return out


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, of about row_bytes each, take at most `most` bytes, else as it is, for Spark to shuffle."""
    with tidy(df.sparkSession):
        return F.broadcast(df) if df.count() * row_bytes <= most else df
