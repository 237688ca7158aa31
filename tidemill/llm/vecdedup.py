"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every vector, less the mean of its label, by random
hyperplanes, one bit each, and orders vectors lexicographically by the bits one
after the other.  Near vectors agree in many leading bits in some pass and come
to stand near each other; each is compared, in double precision, with its
neighbours of a bounded window.  What a window finds is reduced to a spanning
forest of it, so a window sends on fewer links than it has vectors.  Links of
all passes make components.  Planes through a label's mean halve its vectors
even where they share a direction; how far they spread about the mean, and how
many they are, tells how many passes are needed.

Numbers of links are then counted within components, exactly and without
listing pairs.  Vectors within half the threshold's angle of their component's
mean are its core: by the triangle inequality any two of them are linked, so a
group of near copies of any size is counted by one sum.  The others are
compared with every vector of their component in square blocks, which yield
counts; no task holds more than two blocks.  Blocks grow with their component
up to 2048 vectors, so a vector is sent to about 16 blocks, and to more only
where a component has over 32,768 vectors and is not dense.

Equal vectors of one label meet before the passes and count as often as they
stand there.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing; vectors of different
lengths aren't compared; very long vectors are compared whole; repeated ids
stay repeated and count as vectors; null ids link like others, and a
component's id is its smallest that isn't null; an empty table gives no rows;
of the columns only the three named ones are read, so others may have any
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.93
#: Passes made at least, and the share of pairs at the threshold itself that passes are meant to bring together.
PASSES, RECALL = 12, 0.95
#: Passes made at most; reached by labels whose vectors lie so close together that most of them are linked.
MOST_PASSES = 128
#: A vector is compared with at least this many neighbours before it in a pass.
WINDOW = 256
BITS = 48
#: Vectors of a square block, at least and at most, and blocks that a component has meanwhile.
BLOCK, LARGEST_BLOCK, BLOCKS = 128, 2048, 16


def checkpoint(df: DataFrame) -> DataFrame:
    """Vectors are short beside texts, so batches hold more of them."""
    return common.checkpoint(df, rows=4096)


def passes_for(n: int, window: int = WINDOW, threshold: float = THRESHOLD, spread: float = 1.0) -> int:
    """Passes for ``n`` vectors of one label that lie ``spread`` from their mean on the average.

    A window holds what shares the first log2(n / window) bits; two vectors
    share a bit with the odds that a plane doesn't fall between them, which
    depends on their angle as seen from the mean.
    """
    bits = max(0.0, np.log2(max(1, n) / window))
    half_chord = np.sqrt((1 - threshold) / 2) / max(spread, 1e-9)
    together = (1 - 2 * np.arcsin(min(half_chord, np.sqrt(0.5))) / np.pi) ** bits
    return PASSES if together >= 1 else min(MOST_PASSES, max(PASSES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - together)))))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _normal(batch: list) -> np.ndarray:
    return _unit(np.array([np.asarray(v, dtype=np.float64) for v in batch]))


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, their vectors of length 1) of a batch."""
    v = b["v"]
    dims = v.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _unit(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum and number of a batch's vectors for each label."""
    for b in batches:
        group = b["group"].to_numpy(zero_copy_only=False)
        for _, at, x in _by_length(b):
            names, which = np.unique(group[at], return_inverse=True)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, which, x)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(which)), pa.array(list(total), pa.list_(pa.float64()))], ["group", "n", "total"])


def _means(units: DataFrame) -> DataFrame:
    """(group, n, mean, spread): the mean of each label's vectors, and how far they lie from it."""
    some = checkpoint(units.select("group", "v").mapInArrow(_sums, "group long, n long, total array<double>"))
    n = some.groupBy("group").agg(F.sum("n").alias("n"))
    sums = some.select("group", F.posexplode("total").alias("k", "x")).groupBy("group", "k").agg(F.sum("x").alias("x"))
    listed = sums.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("m")).join(n, "group")
    mean = F.transform("m.x", lambda x: x / F.col("n"))
    found = listed.select("group", "n", mean.alias("mean"))
    return checkpoint(found.withColumn("spread", F.sqrt(F.greatest(F.lit(0.0), 1 - _dot(F.col("mean"), F.col("mean"))))))


def _codes(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for b in batches:
            unit, group, tie = (b[c].to_numpy(zero_copy_only=False) for c in ("unit", "group", "h1"))
            for dim, at, x in _by_length(b):
                x = x - b["mean"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for k in range(passes):
                    planes = np.random.default_rng((seed, k, dim)).standard_normal((dim, BITS))
                    code = ((x @ planes > 0) @ weights).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(group[at]), pa.array(code), pa.array(tie[at]), pa.array(unit[at])], ["nth", "group", "code", "h1", "unit"])

    return run


def _forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Links that span what ``linked`` joins; rows and cols name the vectors."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(rows[i])), root(int(cols[j]))
        if a != b:
            parent[a] = b
            out.append((int(rows[i]), int(cols[j])))
    return out


def _window(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in pdf.groupby(["nth", "group"], sort=True):
            part = part.sort_values(["own", "unit"], kind="stable")
            own = part["own"].to_numpy()
            if len(part) < 2 or not own.any():
                continue
            x, unit = _normal(part["v"].tolist()), part["unit"].to_numpy()
            mine = np.flatnonzero(own)
            linked = x[mine] @ x.T >= threshold
            linked &= np.arange(len(x))[None, :] < mine[:, None]  # each pair once, nothing with itself
            out += _forest(linked, unit[mine], unit)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _degrees(threshold: float):
    """Links across two blocks (``side`` false and true), or within one where all sides are false."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, side = _normal(pdf["v"].tolist()), pdf["n"].to_numpy(np.int64), pdf["side"].to_numpy(bool)
        links, within = np.zeros(len(x), dtype=np.int64), pdf["within"].iloc[0]
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            linked = x[part] @ x.T >= threshold
            linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
            if not within:
                linked &= side[part, None] != side[None, :]
            links[part] = linked @ n
        return pd.DataFrame({"unit": pdf["unit"], "links": links})

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(unit, links) for members (component, unit, v, n) of components."""
    members = members.withColumn("v", F.col("v").cast("array<double>")).withColumn("most", F.array_max(F.transform("v", F.abs))).withColumn("v", F.transform("v", lambda x: x / F.col("most"))).drop("most")
    members = checkpoint(members.withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v")))))
    sums = members.select("component", "norm", F.posexplode("v").alias("k", "x")).groupBy("component", "k").agg(F.avg(F.col("x") / F.col("norm")).alias("x"))
    means = checkpoint(sums.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("m")).select("component", F.col("m.x").alias("mean")))
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9
    core = _dot(F.col("v"), F.col("mean")) >= half * F.col("norm") * F.sqrt(_dot(F.col("mean"), F.col("mean")))
    placed = checkpoint(members.join(means, "component").select("component", "unit", "v", "n", core.alias("core")))
    sizes = checkpoint(
        placed.groupBy("component").agg(F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("core_n"), F.count_if(F.col("core")).alias("n_core"), F.count_if(~F.col("core")).alias("n_rest"))
    )
    known = placed.join(sizes, "component")
    within_core = known.filter("core").select("unit", (F.col("core_n") - F.col("n")).alias("links"))
    wide = F.least(F.lit(LARGEST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil((F.col("n_core") + F.col("n_rest")) / BLOCKS)))
    blocks = {c: F.ceil(F.col(c) / wide).cast("int") for c in ("n_core", "n_rest")}
    spread = lambda n: F.pmod(F.xxhash64("unit", F.lit(3)), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    some = known.filter("n_rest > 0")
    task = lambda i, j, kind, side, within: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), side.alias("side"), within.alias("within"))
    no, yes, own = F.lit(False), F.lit(True), spread(blocks["n_rest"])
    rest = some.filter("not core")
    rest_rest = rest.withColumn("t", F.explode(F.transform(each(blocks["n_rest"]), lambda k: task(F.least(k, own), F.greatest(k, own), "rest", own > k, k == own))))
    rest_core = rest.filter("n_core > 0").withColumn("t", F.explode(F.transform(each(blocks["n_core"]), lambda k: task(own, k, "core", no, no))))
    core_rest = some.filter("core").withColumn("t", F.explode(F.transform(each(blocks["n_rest"]), lambda k: task(k, spread(blocks["n_core"]), "core", yes, no))))
    squares = rest_rest.unionByName(rest_core).unionByName(core_rest).select("component", "t.*", "unit", "v", "n")
    # Dealt by block, or Spark would leave a component where the join above put it.
    squares = squares.repartition("component", "i", "j", "kind")
    across = squares.groupBy("component", "i", "j", "kind").applyInPandas(_degrees(threshold), "unit long, links long")
    return within_core.unionByName(across).groupBy("unit").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, seed: int = 5) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    spark = vectors.sparkSession
    v = F.col(embedding)
    usable = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # 128 bits name a vector together with its label
    marks = [F.when(usable, F.xxhash64(F.col(label).cast("string"), v, F.lit(salt))).alias(f"h{salt}") for salt in (1, 2)]
    rows = checkpoint(vectors.select(F.col(vec_id).alias("vec_id"), *marks))
    known = vectors.select(F.col(vec_id).alias("vec_id"), F.xxhash64(F.col(label).cast("string"), F.size(v)).alias("group"), v.alias("v"), *marks).filter("h1 is not null")
    units = checkpoint(known.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("group").alias("group"), F.first("v").alias("v")).withColumn("unit", F.monotonically_increasing_id()))
    means = _means(units)
    if passes is None:
        # A spread in hundredths, and the largest label of it: a bounded table.
        labels = means.groupBy(F.floor(F.col("spread") * 100).alias("spread")).agg(F.max("n").alias("n")).collect()
        passes = max([PASSES, *(passes_for(r["n"], window, threshold, (r["spread"] + 0.5) / 100) for r in labels)])

    centred = units.select("unit", "h1", "group", "v").join(means.select("group", "mean"), "group")
    codes = centred.mapInArrow(_codes(passes, seed), "nth int, group long, code long, h1 long, unit long")
    order = ["nth", "group", "code", "h1", "unit"]
    listed = checkpoint(checkpoint(codes).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, nth_in_part = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in listed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    offsets = [(p, at) for (p, _), at in zip(sizes, accumulate((n for _, n in sizes), initial=0))] or [(0, 0)]  # noqa: B905
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    block = F.floor((F.col("offset") + nth_in_part) / window).cast("long")
    twice = F.explode(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    placed = listed.withColumn("part", part).join(offsets, "part").select("nth", "group", "unit", twice.alias("x")).select("nth", "group", "unit", "x.block", "x.own")
    found = placed.join(units.select("unit", "v"), "unit").groupBy("block").applyInPandas(_window(threshold), "a long, b long")
    classes = checkpoint(components(found))

    members = classes.withColumnRenamed("node", "unit").join(units.select("unit", "v", "n"), "unit")
    degrees = _count_links(members, threshold)
    named = units.select("unit", "h1", "h2", "rep", "n").join(classes.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    lowest = checkpoint(named.groupBy("component").agg(F.min("rep").alias("component_id")))  # or a large component couldn't be split below
    told = named.join(lowest, "component").join(degrees, "unit", "left").select("h1", "h2", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(told, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
