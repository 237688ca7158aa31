"""Best-fit packing of token sequences by minimum bin slack.

A document's ids, then an end id, are cut into pieces of at most ``capacity``
tokens; only the first piece of a cut document may be shorter.  Pieces of one
length are interchangeable, so all that packing needs is how many pieces there
are of each length: at most ``capacity`` numbers, however large the input.
From those, minimum bin slack builds one bin at a time: the longest piece
left, filled up by the subset of the other lengths whose sum comes nearest to
what is free, found by dynamic programming over a bitset of reachable sums.
The same filling is taken as often as the counts allow.  Pieces then get their
rank among those of their length, which names their bin and offset.

Ranks are taken within (length, salt) cells and shifted by the cells before.
Each length has a salt for every thousand of its pieces, so a length that a
third of all pieces have is dealt over many tasks, and a rare one is one cell.

Defined cases: a null text is an empty one and gives one piece holding just
the end id; a text of any length is cut into as many pieces as it needs; rows
whose ids are null or repeated are packed like any other, and repeated rows
each get a place of their own; an empty table gives no rows; of the columns
only the id and the text are read, so others may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, slices, sums_before
from .tokenizer import encoder

CAPACITY = 2048
#: Pieces that one cell of ranking is meant to hold.
CELL = 1000


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes what doesn't fill a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``, and the piece's ids if asked for."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            rows = []
            for k, data in zip(b["doc_id"].to_pylist(), enc.encode([x or "" for x in b["text"].to_pylist()]), strict=True):
                data += end
                for i, (at, n) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + n)]
                    rows.append((k, i, at, n, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype("int64")] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def fill(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """The (length, times) whose sum is the largest that fits into ``room``.

    ``bits`` has bit s set if some choice sums to s.  Long pieces are offered
    first and the search ends as soon as the bin can be filled whole, so short
    ones are left for gaps that need them.
    """
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, lot = min(counts[length], room // length), 1
        while left:  # lots of 1, 2, 4, ... pieces
            lot = min(lot, left)
            steps.append((length, lot, bits))
            bits |= (bits << (length * lot)) & mask
            left, lot = left - lot, lot * 2
        if bits >> room:
            break
    total, taken = bits.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            total -= length * lot
            taken[length] = taken.get(length, 0) + lot
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first bin, pieces a bin, offset), and the number of bins."""
    left = {k: v for k, v in counts.items() if v}
    used, rows, bins = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        taken = dict(fill(capacity - longest, {k: v for k, v in rest.items() if v}))
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, bins, n, offset))
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
            offset += n * length
        bins += times
    return rows, bins


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32, ...)."""
    cut_pieces = checkpoint(cut_pieces)
    by_length = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan(by_length, capacity)
    salts = cut_pieces.sparkSession.createDataFrame([(k, -(-n // CELL)) for k, n in by_length.items()], "length long, __salts long")
    # Places follow from what pieces are, not from the order in which rows came; numbers tell only repeated rows apart, which are alike.
    told = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    salted = cut_pieces.withColumn("__at", F.monotonically_increasing_id()).join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64(*told), F.col("__salts"))).drop("__salts")
    cells = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = sums_before(cells, "__salt", "__n", ("length",)).select("length", "__salt", "before")
    within = F.row_number().over(W.partitionBy("length", "__salt").orderBy(*told, "__at")) - 1
    ranked = salted.withColumn("__rank", within).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("before"))
    table = np.array(sorted((r[0], r[1], r[3], r[4], r[5]) for r in rows), dtype=np.int64).reshape(-1, 5)
    return ranked.select(*cut_pieces.columns, "__rank").mapInArrow(_placer(table), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id long, offset long")


def _placer(table: np.ndarray):
    """The plan has some rows for each length, so it is as bounded as the lengths are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for b in batches:
            length, rank = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            kept = [c for c in b.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset where each lies."""
    return place(pieces(docs, tokenizer, end_id, capacity, doc_id, text, with_ids), capacity)
