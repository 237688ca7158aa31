"""Whole streaming jobs: replayed tables, injected failures, restarts."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.expressions import iso_time
from ..sources import jdbc
from .sinks import CommitMark, TransactionalFiles, upsert_sink, write_ahead_sink


def job_folder(spark: SparkSession, name: str) -> str:
    """A new folder all executors see: below spark.checkpoint.dir, or a temporary one in a single process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidemill-jobs-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replay(spark: SparkSession, table: DataFrame, folder: str, order: str, files: int) -> DataFrame:
    """``table`` as a stream: ``files`` files in the order of ``order``, one to a batch; null orders come first.

    One pass writes them side by side; as the file source takes files by the
    time they were written, they are then dated in their order, which wants a
    store that keeps such times.
    """
    table.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    written = sorted((s.getPath() for s in store.listStatus(path)), key=lambda f: f.getName())
    parts = [f for f in written if f.getName().startswith("part-")]
    now = int(time.time() * 1000)
    for k, f in enumerate(parts):
        store.setTimes(f, now - 1000 * (len(parts) - k), -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_end(writer: DataStreamWriter, retries: int = 3) -> int:
    """Run until the input ends, restarting from the checkpoint after failures; returns how many there were."""
    for failures in range(retries + 1):
        try:
            writer.trigger(availableNow=True).start().awaitTermination()
            return failures
        except StreamingQueryException:
            if failures == retries:
                raise
    return retries


class FailOnce:
    """For tests of recovery: raises before the given batch's first attempt is written."""

    def __init__(self, batch_id: int | None):
        self.batch_id = batch_id

    def __call__(self, batch_id: int) -> None:
        if batch_id == self.batch_id:
            self.batch_id = None
            raise RuntimeError(f"injected failure in batch {batch_id}")


def _run(spark: SparkSession, readings: DataFrame, name: str, sink: Callable[[str, FailOnce], Callable[[DataFrame, int], None]], files: int, fail_in: int | None) -> str:
    folder = job_folder(spark, name)
    stream = replay(spark, readings, f"{folder}/input", "event_id", files)
    write = sink(folder, FailOnce(fail_in))

    def batch(df: DataFrame, batch_id: int) -> None:
        parts = df.groupBy(F.window("ts", "1 hour").alias("window")).agg(F.sum("temperature").alias("total"), F.count(F.lit(1)).alias("n"))
        write(parts.select(F.col("window.end").alias("end"), "total", "n"), batch_id)

    run_to_end(stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint"))
    return f"{folder}/output"


def _averages(parts: DataFrame) -> DataFrame:
    return parts.groupBy(iso_time(F.col("end")).alias("window_end")).agg(F.round(F.sum("total") / F.sum("n"), 4).alias("avg_temp"))


def averages_through_files(spark: SparkSession, readings: DataFrame, files: int = 4, fail_in: int | None = 1) -> DataFrame:
    """Global window averages by way of files that each batch writes exactly once.

    A batch overwrites the folder of its own number, so the attempt after a
    failure replaces what the first left.
    """

    def sink(folder: str, fail: FailOnce) -> Callable[[DataFrame, int], None]:
        def write(df: DataFrame, batch_id: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/output/batch={batch_id}")
            fail(batch_id)  # after the output, before the batch is committed: it will be run again

        return write

    return _averages(spark.read.parquet(_run(spark, readings, "file-sink", sink, files, fail_in)))


def averages_through_write_ahead(spark: SparkSession, readings: DataFrame, files: int = 4, fail_in: int | None = 1) -> DataFrame:
    """The same through a write-ahead sink: a marked batch isn't sent again.

    The failure comes after the batch is sent and before it is marked, so it
    is sent twice, to the folder of its own number.
    """

    def sink(folder: str, fail: FailOnce) -> Callable[[DataFrame, int], None]:
        def send(df: DataFrame, batch_id: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/output/batch={batch_id}")
            fail(batch_id)

        return write_ahead_sink(CommitMark(spark, f"{folder}/mark", "averages"), send)

    return _averages(spark.read.parquet(_run(spark, readings, "write-ahead", sink, files, fail_in)))


def averages_through_transactions(spark: SparkSession, readings: DataFrame, files: int = 4, fail_in: int | None = 1) -> DataFrame:
    """The same through ``transactional_files``: a commit that fails half way is repeated and repeats no line."""
    folder = job_folder(spark, "two-phase-sink")
    stream = replay(spark, readings, f"{folder}/input", "event_id", files)
    spark.dataSource.register(TransactionalFiles)
    end = F.window("ts", "1 hour")["end"]
    lines = stream.select(F.concat_ws("|", iso_time(end), F.col("temperature").cast("string")).alias("value"))
    places = {"path": f"{folder}/output", "temp": f"{folder}/temp", "checkpointLocation": f"{folder}/checkpoint"}
    run_to_end(lines.writeStream.format(TransactionalFiles.name()).options(**places, **({} if fail_in is None else {"fail_in": fail_in})))
    parts = F.split("value", "\\|")
    read = spark.read.text(f"{folder}/output").select(parts[0].alias("window_end"), parts[1].cast("double").alias("t"))
    return read.groupBy("window_end").agg(F.round(F.avg("t"), 4).alias("avg_temp"))


def latest_through_upserts(spark: SparkSession, readings: DataFrame, url: str, files: int = 4) -> DataFrame:
    """Each sensor's latest temperature, as a table holds it after every batch was merged into it."""
    folder = job_folder(spark, "upserts")
    stream = replay(spark, readings, f"{folder}/input", "event_id", files)
    jdbc.execute(spark, url, "CREATE TABLE temperatures (sensor VARCHAR(255) PRIMARY KEY, temp DOUBLE)")
    write = upsert_sink(url, "temperatures", "sensor", "temp", "event_id")
    told = stream.select(F.col("id").alias("sensor"), F.col("temperature").alias("temp"), "event_id")
    run_to_end(told.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint"))
    return jdbc.read_through(spark, url, "temperatures", f"{folder}/output").toDF("id", "temp")
