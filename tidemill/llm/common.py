"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at once.  Texts are long, so these are few.
BATCH_ROWS = 256

#: What operators remember in a Python worker, which outlives them.
WORKER_MEMORY: list[dict] = []


def forget() -> None:
    """Called where an operator that remembers nothing starts in a worker."""
    for x in WORKER_MEMORY:
        x.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system, where its C library can; large arrays otherwise stay with the worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def one_thread():
    """Products of matrices inside take one thread, where numpy's OpenBLAS is found: a task has one core, and threads that wait for others burn more."""
    named = {line.split()[-1] for line in Path("/proc/self/maps").read_text().splitlines() if "openblas" in line} if Path("/proc/self/maps").exists() else ()
    before = []
    for path in sorted(named):
        for prefix, suffix in (("scipy_", "64_"), ("scipy_", ""), ("", "64_"), ("", "")):
            with contextlib.suppress(OSError, AttributeError):
                library = ctypes.CDLL(path)
                get, put = (getattr(library, f"{prefix}openblas_{x}_num_threads{suffix}") for x in ("get", "set"))
                before.append((put, get()))
                put(1)
                break
    try:
        yield
    finally:
        for put, threads in before:
            put(threads)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-process session without that setting falls back to a
    temporary folder; a cluster without it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="tidemill-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there; Arrow batches have ``rows`` rows meanwhile."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with arrow_rows(spark, rows):
        return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows.  Spark bounds the bytes of a batch, so no session setting is needed besides."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def each_text(texts: pa.Array, rows: int = BATCH_ROWS) -> Iterator:
    """The values of one Arrow column, of which few are Python objects at a time."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch for what is executed inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sums_before(df: DataFrame, number: str, amount: str, by: tuple[str, ...] = (), block: int = 1000) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over the rows of a lower ``number``, within ``by``.

    In two levels, so that one task sees a row for each ``block`` numbers at most.
    """
    blocked = df.withColumn("__block", F.floor(F.col(number) / block))
    whole = blocked.groupBy(*by, "__block").agg(F.sum(amount).alias("__sum"))
    first = whole.select(*by, "__block", (F.sum("__sum").over(W.partitionBy(*by).orderBy("__block")) - F.col("__sum")).alias("__first"))
    inner = F.sum(amount).over(W.partitionBy(*by, "__block").orderBy(number)) - F.col(amount)
    return blocked.withColumn("__inner", inner).join(first, [*by, "__block"]).withColumn("before", F.col("__first") + F.col("__inner")).drop("__block", "__first", "__inner")


def remove(spark: SparkSession, path: str) -> None:
    """Delete what an operator wrote below the shared folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and the controls 9 to 13; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; -1, which is no fold, for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what ``df`` reads; works for any store Spark reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
