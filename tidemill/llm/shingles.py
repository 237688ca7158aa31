"""Near-duplicate classes by the similarity of word shingles, without misses.

A text is the set of its shingles of five words, hashed to 64 bits.  Two texts
are linked if their sets share four fifths of their union or more (Jaccard).
Candidates come from two sides and are all verified on the whole sets:

1. SimHash fingerprints of the shingles within two bits, by the covering tables
   of ``simhash``.  Most copies that differ in little meet there.
2. Texts at a similarity of 0.8 differ in ten of 64 bits on the average, often
   in twenty, and covering a radius of twenty takes a million tables.  So what
   lies beyond the radius is found by prefix filtering (Chaudhuri et al.,
   2006): sets in one global order of shingles share one among their first
   ``n - ceil(0.8 n) + 1`` if they are linked, and meet in a bucket for it.
   Any order will do, so shingles that are common in a sample go last: lines
   and passages that many texts hold make few buckets, and nothing depends on
   the sample but speed.

Buckets are first joined to their smallest member alone.  That joins most of a
group of near copies of any size by one pair a member.  Where a bucket still
holds a large component and many members apart from it, these are paired with
one member of it, and it with one of the next largest, again a pair a member,
as long as that links anything.  Afterwards only pairs that are still in
different components are looked at, and of those only such as their places in
the two orders still allow.  Sizes, and parities of as many cells as
a set has shingles, rule out most pairs before sets are moved: parities differ
in no more cells than sets do in shingles.  Nothing is capped or left out.

Defined cases: words are split and lower-cased on ASCII as in ``simhash``; a
text of fewer than five words is one shingle; null and empty texts, and texts
of blanks only, are one empty set and link with each other; texts of equal sets
are one node, named by 64 bits; very long texts are read whole; an empty table
gives no rows; null ids, repeated rows and clashing columns as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpoint, forget, slices
from .components import components

SHINGLE = 5
#: Texts are near from OF shingles in common out of every OUT of their union.
OF, OUT = 4, 5
#: Texts sampled for common shingles: so many at least, and one of so many; a shingle is common in COMMON of them; so many are taken at most.
#: A rate that fell with the table would let buckets grow faster than it.
SAMPLE, RATE, COMMON, TAKEN = 4_000, 16, 3, 1_000_000
#: Words of 64 parities of a set of up to 1024 shingles; larger sets have as many parities as shingles, to the next power of two.
PARITIES = 16
#: Names of sets that are broadcast at most.
BROADCAST = 1_000_000
#: Buckets are paired by a few members while pairs of largest components and what is apart from them are so many times their members.
DENSE, PIVOTS = 4, 8
#: Buckets with so large a component compare parities before they give pairs out.
LARGE = 64


def as_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes, as signed numbers."""
    return np.unique(hashes.view("<i8"))


def shingles(data: bytes | None) -> np.ndarray:
    return as_set(simhash.shingle_hashes(data, SHINGLE))


def name(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63) if len(found) else 0


def parities(found: np.ndarray) -> np.ndarray:
    cells = 64 * PARITIES
    while cells < len(found):
        cells *= 2
    odd = np.bincount(found & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _list(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, dtype=np.int64)])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in slices(batches):
        sets = [shingles(x) for x in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([name(s) for s in sets], pa.int64()), _list(sets)], ["node", "s"])


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order, common ones last."""
    n = len(found)
    some = n - -(-OF * n // OUT) + 1 if n else 0
    if not len(common):
        return found[:some]
    last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.concatenate([found[~last], found[last]])[:some]


def _read(common):
    """Replaces ``text`` by what is kept of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            hashes = [simhash.shingle_hashes(x, SHINGLE) for x in b["text"].to_pylist()]
            sets = [as_set(h) for h in hashes]
            told = [pa.array([f(x) for x in of], pa.int64()) for f, of in ((name, sets), (simhash.majority, hashes), (len, sets))]
            kept = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], *told, _list([prefix(s, common.value) for s in sets]), _list([parities(s) for s in sets])], [*kept, "fp", "mark", "n", "first", "odd"])

    return run


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles that many of a sample of texts hold; bounded, and of use for speed only."""
    marked = texts.select("text", F.xxhash64("text").alias("h"))
    one_of = max(1, min(RATE, texts.count() // SAMPLE))
    sample = marked.filter(F.pmod("h", F.lit(one_of)) == 0).dropDuplicates(["h"]).select("text")
    counts = sample.mapInArrow(_sets, "node long, s array<long>").select(F.explode("s").alias("t")).groupBy("t").count().filter(F.col("count") >= COMMON)
    taken = counts.orderBy(F.desc("count"), "t").limit(TAKEN).select("t").toArrow()  # rows as Python objects would take the driver 50 times the memory
    return np.sort(taken["t"].to_numpy())


def _like_sized(a: str, b: str) -> Column:
    return F.least(a, b) * OUT >= F.greatest(a, b) * OF


def _differ(a: Column, b: Column) -> Column:
    """Number of parities that differ; those of the larger set are folded to the cells of the smaller."""
    half = lambda x, at: F.slice(x, at, (F.size(x) / 2).cast("int"))
    folded = lambda x: F.zip_with(half(x, F.lit(1)), half(x, (F.size(x) / 2).cast("int") + 1), lambda p, q: p.bitwiseXOR(q))
    x, y = F.when(F.size(a) > F.size(b), folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), folded(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)


def _near(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are near."""
    of = [nodes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd{x}")) for x in "ab"]
    # Sets of like sizes have parities of like numbers: equal, or one twice the other.
    like = _like_sized("na", "nb") & (_differ(F.col("odda"), F.col("oddb")) * (OF + OUT) <= (F.col("na") + F.col("nb")) * (OUT - OF))
    pairs = checkpoint(pairs.join(of[0], "a").join(of[1], "b").filter(like).select("a", "b"))
    wanted = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    held = checkpoint(texts.mapInArrow(_sets, "node long, s array<long>").join(few, "node", "left_semi").dropDuplicates(["node"]))
    first = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = first.join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return checkpoint(both.filter(shared * (OF + OUT) >= (F.size("sa") + F.size("sb")) * OF).select("a", "b"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _by_marks(nodes: DataFrame) -> DataFrame:
    """Candidates whose fingerprints are within the radius, or lead there over one node of each fingerprint."""
    marks = checkpoint(nodes.groupBy("mark").agg(F.min("fp").alias("rep")))
    same = nodes.join(marks, "mark").filter("fp <> rep").select(*_ordered("fp", "rep"))
    found = simhash.links(marks.select(F.col("mark").alias("fp")))
    of = [marks.select(F.col("mark").alias(x), F.col("rep").alias(f"r{x}")) for x in "ab"]
    return same.union(found.join(of[0], "a").join(of[1], "b").select(*_ordered("ra", "rb")))


def _place_members(held: DataFrame, linked: DataFrame) -> DataFrame:
    """Members (t, i, node, n) of buckets with several components: theirs, the bucket's most frequent one and how large that is there.

    ``held`` has a row for each node with its places ``at`` (t, i) in buckets,
    so components meet nodes and not each of their places.  Members of one
    component need no pairs among themselves.
    """
    joined = checkpoint(components(linked))
    whose = held.join(joined, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), F.explode("at").alias("x"))
    told = checkpoint(whose.select("x.t", "x.i", "node", "n", "component"))
    sizes = told.groupBy("t", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("t").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("several"))
    return checkpoint(told.join(sizes.filter("several > 1").select("t", F.col("m.component").alias("main"), F.col("m.k").alias("largest")), "t"))


def _by_some_members(placed: DataFrame, turn: int) -> DataFrame:
    """Members apart from a bucket's most frequent component with a few members of it, and its members with a few apart.

    These are the first in orders that are the same in all buckets and others at each turn.
    """
    firsts = [F.min_by("node", F.xxhash64(F.lit(turn * PIVOTS + k), "node")) for k in range(PIVOTS)]
    of_main = F.col("component") == F.col("main")
    chosen = placed.groupBy("t", of_main.alias("of_main")).agg(F.array_distinct(F.array(*firsts)).alias("others"))
    others = chosen.select("t", (~F.col("of_main")).alias("of_main"), F.explode("others").alias("other"))
    return placed.withColumn("of_main", of_main).join(others, ["t", "of_main"]).select(*_ordered("node", "other")).distinct()


def links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes whose sets are near.

    ``nodes`` has one row (fp, mark, n, first, odd) for each set among
    ``texts``: its name, fingerprint, size, prefix and parities.
    """
    members = nodes.select(F.posexplode("first").alias("i", "t"), F.col("fp").alias("node"), "n")
    buckets = checkpoint(members.groupBy("t").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("pivot"), F.max("node").alias("last")).filter("many > 1"))
    members = checkpoint(members.join(buckets.filter("many > 2").select("t", "pivot"), "t"))
    twos = buckets.filter("many = 2").select(F.col("pivot").alias("a"), F.col("last").alias("b"))
    pairs = members.filter("node <> pivot").select(*_ordered("pivot", "node")).union(twos).union(_by_marks(nodes)).distinct()
    linked = _near(pairs, nodes, texts)
    held = checkpoint(members.filter("node <> pivot").groupBy("node", "n").agg(F.collect_list(F.struct("t", "i")).alias("at")))
    placed, turn, before = _place_members(held, linked), 0, None
    while True:
        rows, dense = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("component") != F.col("main"), F.col("largest"))), F.lit(0))).first()
        if dense <= DENSE * rows or (before and 2 * dense > before):
            break
        linked = checkpoint(linked.union(_near(_by_some_members(placed, turn), nodes, texts)))
        placed, turn, before = _place_members(held, linked), turn + 1, dense
    small = _apart(placed.filter(F.col("largest") < LARGE))
    large = placed.filter(F.col("largest") >= LARGE).join(nodes.select(F.col("fp").alias("node"), "odd"), "node")
    large = _apart(large, _differ(F.col("x.odd"), F.col("y.odd")) * (OF + OUT) <= (F.col("x.n") + F.col("y.n")) * (OUT - OF))
    return linked.union(_near(small.union(large).distinct(), nodes, texts))


def _apart(placed: DataFrame, also: Column | None = None) -> DataFrame:
    """Pairs of a bucket's members in different components that can be near."""
    # A near pair has its first shared shingle in some bucket, and there enough is left on both sides.
    left = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    can = (F.col("x.component") != F.col("y.component")) & _like_sized("x.n", "y.n") & (left * (OF + OUT) >= (F.col("x.n") + F.col("y.n")) * OF)
    can = can if also is None else can & also
    pairs = placed.filter("component <> main").alias("x").join(placed.alias("y"), (F.col("x.t") == F.col("y.t")) & can)
    return pairs.select(*_ordered("x.node", "y.node"))


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) without texts, with the name of each set as ``fp`` and its ``component``."""
    given = docs.withColumn("text", F.col("text").cast("binary"))
    texts = given.select("text")
    run = _read(docs.sparkSession.sparkContext.broadcast(_common(texts)))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "text"]
    rows = checkpoint(given.mapInArrow(run, ", ".join([*kept, "fp long, mark long, n long, first array<long>, odd array<long>"])))
    nodes = checkpoint(rows.select("fp", "mark", "n", "first", "odd").dropDuplicates(["fp"]))
    found = checkpoint(components(links(texts, nodes)))
    return checkpoint(simhash.place(rows.drop("mark", "n", "first", "odd"), found))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``, as ``simhash.classes`` has them; ``fp`` names the set."""
    return simhash.name(placed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``simhash.keep_one`` of classes by similarity."""
    return simhash.keep_one(docs, doc_id, text, placed)
