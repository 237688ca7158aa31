"""Token ids as length-delimited binary records with an offset index.

A data shard is a run of records in ascending order of document id.  A record is

    length   8 bytes   bytes of the payload
    check    4 bytes   masked checksum of the length
    payload            flags (1), document id (8, signed), id width (1), ids
    check    4 bytes   masked checksum of the payload
    end      1 byte    a line feed, written by Spark's writer between records

all little-endian.  Checksums are CRC-32 rotated right by 15 bits plus a
constant, so that a checksum stored beside data that itself holds checksums
stays useful.  Ids take 2 bytes each if the vocabulary allows, else 4.  Bit 0
of the flags says that the document id is null.

The index is a Parquet table beside the shards: shard file, document id, byte
offset and length of the record, number of ids, and where they start among all
ids of the shard.  A reader may fetch any record by its index row alone, so
reading in shuffled order costs no scan.

Both are written and read by Spark itself, through whatever store the path
names; a task that is run again replaces its own files when it commits.

Defined cases: a null text is an empty one; a text of any length is one record;
null ids come first; rows that repeat an id are ordered by their text's hash,
and by it they are dealt over shards too; an empty table gives no records; of
the columns only the id and the text are read, so others may have any names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_rows, estimated_bytes, forget, slices, sums_before, trim
from .tokenizer import encoder

#: Bytes of input for each shard.  Fixed by what a reader holds of a shard at once.
SHARD_BYTES = 4 << 20
MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<BqB", doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def read_frame(data, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, offset of the next record); raises if a checksum is wrong."""
    head = bytes(data[at : at + 8])
    (n,), (check,) = struct.unpack("<Q", head), struct.unpack_from("<I", data, at + 8)
    if check != masked(head):
        raise ValueError(f"record at {at}: its length is damaged")
    payload = bytes(data[at + 12 : at + 12 + n])
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"record at {at}: its payload is damaged")
    null, doc_id, width = struct.unpack_from("<BqB", payload)
    return None if null else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=10), at + 12 + n + 5


def _shards(docs: DataFrame) -> int:
    """By the size that Spark estimates; by rows where it knows none."""
    size = estimated_bytes(docs)
    return max(1, -(-size // SHARD_BYTES) if size < 1 << 60 else docs.count() // 2000)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Write ``path/data`` and ``path/index``.  One shuffle, of the texts."""
    spark = docs.sparkSession
    shards = shards or _shards(docs)
    order = F.col("doc_id"), F.xxhash64("text")
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if enc.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        tail = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            found = enc.encode([x or "" for x in b["text"].to_pylist()])
            framed = [frame(k, np.frombuffer(x + tail, dtype="<u4"), width) for k, x in zip(b["doc_id"].to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(framed, type=pa.binary())], ["record"])
        trim()

    # A string column holds any bytes; the text writer copies them as they are.
    with arrow_rows(spark, BATCH_ROWS):
        ordered.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")
    index = records(spark, path).select("shard", "doc_id", "byte_offset", "byte_length", "n_tokens", "start_in_shard")
    index.write.parquet(f"{path}/index")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Read every record of ``path/data`` back and verify it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for shard, content in zip(b["shard"].to_pylist(), b["content"], strict=True):
                data, at, start, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    doc_id, ids, after = read_frame(data, at)
                    rows.append((shard, doc_id, at, after - at, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, start = after, start + len(ids)
                    if len(rows) == 10_000:
                        yield _record_rows(rows)
                        rows = []
                yield _record_rows(rows)
        trim()

    return files.mapInArrow(run, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in RECORD))


RECORD = (("shard", pa.string()), ("doc_id", pa.int64()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()))


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(RECORD)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, RECORD, strict=True)], [n for n, _ in RECORD])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, from the files.

    Shard files are numbered in the order of their ids, so a document starts
    where its shard does, after the ids of all shards before, plus its place
    there.
    """
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("nth", F.regexp_extract("shard", r"^part-(\d+)", 1).cast("int"))
    first = sums_before(totals, "nth", "n").select("shard", "before")
    return records(spark, path).join(first, "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
