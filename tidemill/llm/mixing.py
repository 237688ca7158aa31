"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted ``target / size`` times, a number from 0
to 2.  Its whole part is taken for certain; the fractional part is an
inclusion probability.  The cube method (Deville and Tille, 2004) turns those
into yes or no while holding two totals of each source: words and documents.
A *flight* walks the vector of probabilities through the null space of the
constraints until all but as many as there are constraints are 0 or 1; what is
left *lands* by the choice that keeps the totals nearest.

Flights run on blocks of a source's documents side by side.  Each leaves at
most two documents undecided, which meet in blocks of the next round, until a
source has one block left, and that one lands.  A source of any size is dealt
over blocks, a block has a bounded number of rows, and the number of rounds is
the logarithm of the largest source to the base of half a block.

Choices follow hashes of the documents, so reruns agree.

Defined cases: a null text counts 0 words; documents without words are sampled
like others; a null source is one source, last in order; rows repeated in all
columns are one unit, whose number of copies is shared out evenly; a table
without words takes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents that one flight takes.
BLOCK = 1000
#: Documents that the last block of a source keeps open for the landing, besides two of its flight.
LANDING = 10
#: Copies of one row that one task makes at most.
REPEATS = 10_000
EPS = 1e-9


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """``total`` dealt by weight; nobody gets over ``most`` times their size, the excess is dealt again."""
    got: dict[int, float] = {}
    while True:
        free = [k for k in range(len(sizes)) if k not in got]
        rest, weight = total - sum(got.values()), sum(weights[k] for k in free)
        share = {k: rest * weights[k] / weight for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return [{**share, **got}[k] for k in range(len(sizes))]
        got |= {k: most * sizes[k] for k in over}


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Move ``p`` until at most two entries lie strictly between 0 and 1.

    Holds sum(p) and sum(p * size).  Three undecided documents have a line of
    moves that change neither; the walk goes along it to the nearer wall, one
    way or the other as a hash-like sequence says, with the odds that keep
    every probability's mean.
    """
    p = p.copy()
    rng = np.random.default_rng(12345 + len(p))
    draws = rng.random(len(p) + 1)
    open_: list[int] = []
    for nth, i in enumerate(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist()):
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        # (d0, d1, d2) solves d0+d1+d2 = 0 and d0*s0+d1*s1+d2*s2 = 0
        d = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(d):
            d = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / x if x > 0 else -p[k] / x) for k, x in zip(open_, d, strict=True) if x)
        down = min((p[k] / x if x > 0 else (p[k] - 1) / x) for k, x in zip(open_, d, strict=True) if x)
        step = up if draws[nth] * (up + down) < down else -down
        for k, x in zip(open_, d, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * x))
        open_ = [k for k in open_ if EPS < p[k] < 1 - EPS]
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few entries still open: of all choices, that whose words come nearest."""
    p, at = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1).astype(float)
        off_words = np.abs(choices @ size[at] - p[at] @ size[at])
        off_docs = np.abs(choices.sum(1) - p[at].sum())
        p[at] = choices[np.lexsort((off_docs, np.round(off_words, 6)))[0]]
    return p


def _flights(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "unit"], kind="stable")
    p, size = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)
    if pdf["last"].iloc[0]:  # some stay open for the landing
        p[LANDING:] = flight(p[LANDING:], size[LANDING:])
        p = land(p, size)
    else:
        p = flight(p, size)
    return pdf.assign(p=p)[["source_no", "unit", "h", "size", "p"]]


def balance(units: DataFrame) -> DataFrame:
    """Decide ``p`` for units (source_no, unit, h, size, p): returns (unit, p) with p 0 or 1.

    ``unit`` is unique and ``h`` orders at random.
    """
    schema = "source_no int, unit string, h long, size double, p double"
    decided, todo, level = [], checkpoint(units.select("source_no", "unit", "h", F.col("size").cast("double").alias("size"), "p")), 0
    while True:
        counts = {r["source_no"]: -(-r["n"] // BLOCK) for r in todo.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            break
        spread = todo.sparkSession.createDataFrame(sorted(counts.items()), "source_no int, spread long")  # as bounded as the sources
        blocked = todo.join(F.broadcast(spread), "source_no").withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("spread"))).withColumn("last", F.col("spread") == 1)
        done = checkpoint(blocked.groupBy("source_no", "block").applyInPandas(_flights, schema))
        still = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(done.filter(~still).select("unit", "p"))
        todo, level = done.filter(still), level + 1
        if max(counts.values()) == 1:
            break
    out = decided[0] if decided else units.select("unit", "p")
    for d in decided[1:]:
        out = out.union(d)
    return out


def unit_key(doc_id: Column, text: Column, source: Column) -> Column:
    """Names a row by its id, source and text; texts by 64 bits beside the id."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in (doc_id, text, source)])
    return F.concat_ws("|", nulls, known(doc_id), F.hex(F.xxhash64(text)), known(source))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each distinct (doc_id, source, text): unit, size, n, copies, source_size, target.

    ``n`` is how many rows of ``docs`` are that unit and ``copies`` how often
    the mix takes it in all, at most ``most`` times ``n``.  Sources are ranked
    and their targets worked out from one row for each source on the driver:
    sources are the named parts of a mix, and over 100,000 are refused.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), unit_key(F.col(doc_id), F.col(text), F.col(source)).alias("unit"), word_count(F.col(text)).alias("size"))
    units = checkpoint(keyed.groupBy("unit").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    rows = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("over 100,000 sources: mix by a coarser column")
    sizes = [int(r["size"]) for r in rows]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], share * sum(sizes), most) if rows else []
    spark = docs.sparkSession
    told = spark.createDataFrame(
        [(r["source"], k, s, float(t), t / s if s else 0.0) for k, (r, s, t) in enumerate(zip(rows, sizes, goal, strict=True))],
        "source string, source_no int, source_size long, target double, rate double",
    )
    told = told.withColumnRenamed("source", "__s")
    known = units.join(F.broadcast(told), units["source"].eqNullSafe(told["__s"])).drop("__s")
    known = known.withColumn("wanted", F.col("rate") * F.col("n")).withColumn("sure", F.floor(F.col("wanted") + EPS).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("sure")))
    known = known.withColumn("h", F.xxhash64("unit"))
    undecided = known.filter(F.col("p") > EPS).select("source_no", "unit", "h", F.col("size"), "p")
    chosen = balance(undecided).withColumnRenamed("p", "extra")
    out = known.join(chosen, "unit", "left").withColumn("copies", F.col("sure") + F.coalesce(F.col("extra"), F.lit(0.0)).cast("long"))
    return out.select("unit", "doc_id", "source", "size", "n", "copies", "source_size", "target")


def _repeated(df: DataFrame, count: str, units: DataFrame) -> DataFrame:
    """Each row ``count`` times, numbered ``__i`` from 0; rows repeated very often are dealt over tasks first."""
    n = F.col(count)
    if units.filter(F.col("copies") + F.col("n") > REPEATS).limit(1).count():
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(REPEATS)))
        df = df.withColumn("__from", chunk).repartition("unit", "__from")
    else:
        df = df.withColumn("__from", F.lit(0).cast("long"))
    each = F.explode(F.sequence("__from", F.least(F.col("__from") + REPEATS, n) - 1))
    return df.withColumn("__i", each).drop("__from")


def mixed_rows(units: DataFrame) -> DataFrame:
    """A row for each row that was mixed: (doc_id, size, source_size, target, taken)."""
    share = F.expr("copies div n") + F.when(F.col("__i") < F.expr("copies % n"), 1).otherwise(0)
    return _repeated(units, "n", units).select("doc_id", "size", "source_size", "target", (F.col("size") * share).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; columns are those of ``docs``."""
    units = mix(docs, doc_id=doc_id, text=text, source=source, **how)
    taken = units.filter("copies > 0").select("unit", F.col("copies").alias("__copies"))
    columns = {c: f"__{k}" for k, c in enumerate(docs.columns)}  # so that no name clashes
    one_each = docs.select(*[F.col(c).alias(n) for c, n in columns.items()], unit_key(F.col(doc_id), F.col(text), F.col(source)).alias("unit")).dropDuplicates(["unit"])
    return _repeated(one_each.join(taken, "unit"), "__copies", units).select(*[F.col(n).alias(c) for c, n in columns.items()])
