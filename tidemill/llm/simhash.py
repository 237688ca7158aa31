"""SimHash near-duplicate detection by covering locality-sensitive hashing.

A 64-bit SimHash is taken of the word shingles of a whole text.  Every bit
position is given one of the ``2**(r+1) - 1`` non-zero vectors of
GF(2)^(r+1); each non-zero vector ``v`` defines a table that keeps the bits
whose vector has an odd product with ``v``.  Any ``r`` or fewer differing bits
span at most ``r`` dimensions, so some ``v`` is orthogonal to all of them and
its table sees two equal keys: every pair within the radius collides in at
least one table (Pagh, "CoveringLSH", 2016).  Nothing is missed, and what
collides is verified on all 64 bits.

``keep_one`` keeps a row of each class.  It takes classes by any rule; the one
of the pipeline, in ``shingles``, asks for a similarity of five-word shingles.

Defined cases: null and empty texts, and texts of blanks only, have fingerprint
zero and link like any other; a text of fewer words than a shingle is one
shingle; a text of any length is read whole, 64-bit counts of bits; rows with a
null id get their group's component but never name it, and a class whose ids
are all null has a null ``component_id``; repeated rows stay repeated in
``classes``; an empty table gives no rows; columns besides the id and the text
are never read by ``classes``, whatever their names, and come out of
``keep_one`` unchanged.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, each_text, forget
from .components import components

RADIUS = 2
SHINGLE = 3
#: Buckets with more fingerprints than this are linked through neighbour keys, not pair by pair.
PAIRWISE_BUCKET = 48


def shingle_hashes(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of one UTF-8 text, repeats included."""
    words = data.lower().split() if data else []  # both on ASCII only
    if not words:
        return np.empty(0, dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], dtype="<u8")
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.array([digest(joined[i : j - 1], 42) for i, j in zip([0, *ends], ends[shingle - 1 :], strict=False)], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The bits set in over half of ``h``, as a signed 64-bit number."""
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<i8")[0])


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text as a signed 64-bit number."""
    return majority(shingle_hashes(data, shingle))


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    forget()
    return pa.array([fingerprint(x) for x in each_text(texts)], pa.int64())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fp``; a column of that name is replaced."""
    return docs.withColumn("fp", _fingerprints(F.col(text).cast("binary")))


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """One signed mask for each table; see the module's text."""
    vectors = 2 ** (radius + 1) - 1
    order = np.random.default_rng(seed).permutation(bits)
    given = {int(bit): 1 + k % vectors for k, bit in enumerate(order)}
    masks = []
    for v in range(1, vectors + 1):
        m = sum(1 << bit for bit, g in given.items() if bin(g & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _signed(bit: int) -> int:
    return (1 << bit) - ((1 << 64) if bit == 63 else 0)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints within ``radius``.

    ``distinct`` has one row for each fingerprint ``fp``.  Buckets of two are
    settled by the aggregate that finds them.  Buckets of up to
    PAIRWISE_BUCKET are verified pair by pair.  Larger ones emit, for each
    member, the key of every fingerprint up to ``radius // 2`` bits away; two
    members share such a key exactly if they are within the radius, and a key
    has 65 members at most, so a group of any size costs 65 short rows each.
    """
    if radius != 2:
        raise ValueError("neighbour keys are defined for a radius of 2")
    masks = covering_masks(radius)
    tables = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])).alias("x"),
    ).select("x.t", "x.k", "fp")
    buckets = checkpoint(
        tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    twos = buckets.filter("n = 2").select("a", "b").filter(near)
    members = tables.join(buckets.filter("n > 2").select("t", "k", "n"), ["t", "k"])
    groups = (
        members.filter(F.col("n") <= PAIRWISE_BUCKET)
        .select("t", "k", "fp")
        .repartition("t", "k")
        .groupBy("t", "k")
        .agg(F.sort_array(F.collect_list("fp")).alias("m"))
    )
    some = (
        groups.select("m", F.posexplode("m").alias("i", "a"))
        .select("a", F.explode(F.filter(F.expr("slice(m, i + 2, size(m))"), lambda y: F.bit_count(F.col("a").bitwiseXOR(y)) <= radius)).alias("b"))
    )
    around = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(i))) for i in range(64)], F.col("fp"))
    many = (
        members.filter(F.col("n") > PAIRWISE_BUCKET)
        .select("fp")
        .distinct()
        .select("fp", F.explode(around).alias("z"))
        .groupBy("z")
        .agg(F.sort_array(F.collect_list("fp")).alias("m"))
        .filter("size(m) > 1")
        .select(F.col("m")[0].alias("a"), F.explode(F.expr("slice(m, 2, size(m))")).alias("b"))
    )
    return twos.union(some).union(many)


def place(marked: DataFrame, joined: DataFrame) -> DataFrame:
    """``marked`` with the ``component`` of each row's ``fp``, by ``joined`` (node, component).

    A node that ``joined`` doesn't know is a component of its own.
    """
    distinct = checkpoint(marked.select("fp").distinct())
    of = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))
    return marked.join(of, "fp")


def name(placed: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``: a component's smallest id is its name."""
    lowest = checkpoint(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")))  # or a large component couldn't be split below
    return placed.join(lowest, "component").select("doc_id", "fp", "component_id")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of up to
    ``radius`` differing bits; copies meet in one fingerprint first.
    """
    return name(_placed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), radius))


def _placed(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` (text, ...) without texts, with ``fp`` and ``component``."""
    marked = checkpoint(fingerprints(docs).drop("text"))
    distinct = checkpoint(marked.select("fp").distinct())
    return checkpoint(place(marked, checkpoint(components(links(distinct, radius)))))


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def _row_names(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns, which name a row up to exact repeats."""
    values = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(c) for c, f in zip(docs.columns, docs.schema, strict=True)]
    nulls = F.concat(F.lit(""), *[F.col(c).isNull().cast("int").cast("string") for c in docs.columns])  # xxhash64 passes nulls over
    return [F.xxhash64(F.lit(salt), nulls, *values) for salt in (1, 2)]


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", placed=_placed) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class, with the columns of ``docs``.

    It is the row of the smallest id, null ids last; of rows that share it,
    the one whose hash over all columns is smallest, so neither the order of
    rows nor the partitioning matters, and no text is lost where an id stands
    on several.  ``placed`` gives the component of each row.  Whole rows move
    once at most, to meet the names of those kept, and not at all where these
    are few enough for Spark to broadcast.
    """
    columns = {c: f"__{k}" for k, c in enumerate(docs.columns)}  # so that no name clashes
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])
    h1, h2 = _row_names(own)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    rows = own.select(F.col(columns[doc_id]).alias("doc_id"), F.col(columns[text]).alias("text"), h1.alias("h1"), h2.alias("h2"))
    found = placed(rows)
    kept = checkpoint(found.groupBy("component").agg(F.min(key).alias("k")).select("k.h1", "k.h2"))
    repeats = checkpoint(found.join(kept, ["h1", "h2"], "left_semi").groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"))
    marked = own.withColumns({"h1": h1, "h2": h2})
    if repeats.limit(1).count():  # only rows that agree in all columns need to meet
        once = marked.join(repeats, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
        named = marked.join(kept.join(repeats, ["h1", "h2"], "left_anti"), ["h1", "h2"], "left_semi").unionByName(once)
    else:
        named = marked.join(kept, ["h1", "h2"], "left_semi")
    return named.select(*[F.col(n).alias(c) for c, n in columns.items()])
