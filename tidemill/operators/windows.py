"""Tumbling event-time windows, half open and aligned to the epoch.

All but those with a Python function are one partial and one final
aggregation; they run on tables and on streams with a watermark.
"""

from __future__ import annotations

import functools
import itertools
import operator
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expressions import iso_time, millis

#: Rows of an Arrow batch that Python gives back.
BATCH_ROWS = 10_000
#: Accumulators that a task holds at once, but for a batch's.
HELD = 50_000


def tumbling(readings: DataFrame, size: str, aggregates: list[Column], keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Aggregates by keys and window, with ``window`` kept."""
    return readings.groupBy(*keys, F.window("ts", size).alias("window")).agg(*aggregates)


def _ended(windowed: DataFrame, *columns: str) -> DataFrame:
    return windowed.select("id", millis(F.col("window.end")).alias("end_ms"), *columns)


def average(readings: DataFrame, size: str) -> DataFrame:
    return _ended(tumbling(readings, size, [F.avg("temperature").alias("avg_temp")]), "avg_temp")


def minimum(readings: DataFrame, size: str) -> DataFrame:
    return _ended(tumbling(readings, size, [F.min("temperature").alias("min_temp")]), "min_temp")


def maximum(readings: DataFrame, size: str) -> DataFrame:
    return _ended(tumbling(readings, size, [F.max("temperature").alias("max_temp")]), "max_temp")


def min_max(readings: DataFrame, size: str) -> DataFrame:
    """What buffering a window and folding it step by step both come to."""
    return _ended(tumbling(readings, size, [F.min("temperature").alias("min_temp"), F.max("temperature").alias("max_temp")]), "min_temp", "max_temp")


def count(readings: DataFrame, size: str) -> DataFrame:
    return _ended(tumbling(readings, size, [F.count(F.lit(1)).alias("cnt")]), "cnt")


def reduced(readings: DataFrame, size: str, reduce: Callable[[pd.Series], float], name: str) -> DataFrame:
    """A reduction given as a Python function over a window's temperatures.

    For functions Spark doesn't have: all values of one window reach Python
    together, so built-in aggregates are to be preferred.
    """

    @F.pandas_udf("double")
    def folded(values: pd.Series) -> float:
        return reduce(values)

    return _ended(tumbling(readings, size, [folded("temperature").alias(name)]), name)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rest of its rows) of batches sorted by their first ``keys`` columns; a group may span batches."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in itertools.groupby(rows, key=operator.itemgetter(slice(0, keys))):
        yield key, [row[keys:] for row in group]


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _together(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.repartition(*columns).sortWithinPartitions(*columns)


def processed(readings: DataFrame, size: str, function: Callable[[tuple, int, int, dict[str, list]], Iterable[tuple]], schema: str, keys: tuple[str, ...] = ("id",), values: tuple[str, ...] = ("temperature",)) -> DataFrame:
    """A function over (key, window's start and end in ms, its values by column) that gives any rows of ``schema``.

    All values of one window reach Python together, so it is for functions that
    need them; what can be folded step by step belongs into ``folded``.  Windows
    pass by in sorted batches, many to a batch, so small ones cost little.
    """
    shape = to_arrow_schema(T.StructType.fromDDL(schema))
    window = F.window("ts", size)
    n = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = (function(key[:-2], key[-2], key[-1], dict(zip(values, map(list, zip(*rows, strict=True)), strict=True))) for key, rows in _grouped(batches, n))
        return _batches(itertools.chain.from_iterable(told), shape)

    placed = readings.select(*keys, window.alias("__w"), *[F.col(v).alias(f"__v{k}") for k, v in enumerate(values)])
    placed = placed.select(*keys, millis(F.col("__w.start")).alias("__start"), millis(F.col("__w.end")).alias("__end"), *[f"__v{k}" for k in range(len(values))])
    return _together(placed, [*keys, "__start", "__end"]).mapInArrow(run, schema)


class Fold(Protocol):
    """A user's aggregate: an accumulator that begins, takes values, meets others of its kind and gives a result."""

    def create(self) -> Any: ...

    def add(self, accumulator: Any, value: Any) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def result(self, accumulator: Any) -> Any: ...


def folded(readings: DataFrame, size: str, fold: Fold, kind: str, name: str, value: str = "temperature", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """A user's aggregate of each window; as in SQL, null values aren't added.

    Each task folds what it reads of a window into one accumulator, HELD of
    them at a time; those of a window are then merged.  So no task needs all
    rows of a hot window.
    """
    window = [*keys, "end_ms"]
    types = {f.name: f.dataType.simpleString() for f in readings.schema}
    shape = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", end_ms long"
    parts_schema, done_schema = f"{shape}, __acc binary", f"{shape}, `{name}` {kind}"
    parts_shape, done_shape = (to_arrow_schema(T.StructType.fromDDL(x)) for x in (parts_schema, done_schema))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}

        def out() -> Iterator[pa.RecordBatch]:
            return _batches(((*key, pickle.dumps(acc)) for key, acc in held.items()), parts_shape)

        for b in batches:
            *of, end, values = (c.to_pylist() for c in b.columns)
            for key, v in zip(zip(*of, end, strict=True), values, strict=True):
                acc = held[key] if key in held else fold.create()
                held[key] = acc if v is None else fold.add(acc, v)
            if len(held) >= HELD:
                yield from out()
                held = {}
        yield from out()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = ((*key, fold.result(functools.reduce(fold.merge, (pickle.loads(acc) for (acc,) in parts)))) for key, parts in _grouped(batches, len(window)))
        return _batches(merged, done_shape)

    placed = readings.select(*keys, F.window("ts", size).alias("__w"), F.col(value).alias("__v"))
    placed = placed.select(*keys, millis(F.col("__w.end")).alias("end_ms"), "__v")
    return _together(placed.mapInArrow(some, parts_schema), window).mapInArrow(whole, done_schema)


def assigned(readings: DataFrame, windows: Column, aggregates: list[Column], keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """A custom assigner: ``windows`` is an array of (start, end) each row belongs to."""
    return readings.withColumn("window", F.explode(windows)).groupBy(*keys, "window").agg(*aggregates)


def aligned(size_ms: int, ts: Column) -> Column:
    """The assigner of windows of ``size_ms``, by flooring the time."""
    start = F.floor(F.unix_millis(ts) / size_ms) * size_ms
    return F.array(F.struct(F.timestamp_millis(start).alias("start"), F.timestamp_millis(start + size_ms).alias("end")))


def global_average(readings: DataFrame, size: str) -> DataFrame:
    """One average for each window over all keys; the window's end as ISO time."""
    windowed = tumbling(readings, size, [F.avg("temperature").alias("avg_temp")], keys=())
    return windowed.select(iso_time(F.col("window.end")).alias("window_end"), "avg_temp")


def latest_window(windowed: DataFrame, value: str) -> DataFrame:
    """Each key's last window: what a point lookup of live results answers."""
    return windowed.groupBy("id").agg(F.max("end_ms").alias("end_ms"), F.max_by(value, "end_ms").alias(value))
