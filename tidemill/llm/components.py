"""Connected components of a graph given by its links.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Each step is an aggregate with
map-side combining and an equi-join, so a node with very many links is
pre-aggregated on one side and split by AQE on the other; no group is ever
collected into one task and nothing but a row count and a checksum reaches the
driver.  Links that are counted and few are joined in one task instead, with
the same result: steps over them would cost more in files and tasks than they
do in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Links that one task joins at most.
FEW = 50_000


def join(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each reaches) for rows (u, v)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in links.tolist():
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
    return nodes, np.array([root(x) for x in nodes.tolist()], dtype=np.int64)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = [np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("u", "v")], axis=1) for b in batches]
    nodes, smallest = join(np.concatenate([np.empty((0, 2), dtype=np.int64), *read]))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(smallest)], ["node", "component"])


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(node, component)`` for every node that has a link.

    ``component`` is the smallest node reachable, the node itself included.
    Self-links and links with a null end are ignored, repeated links count
    once, and an empty input gives an empty result.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    e = (
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(hi.alias("u"), lo.alias("v"))
        .distinct()
    )
    e = checkpoint(e)
    seen = _signature(e)
    if seen[0] <= FEW:
        return e.coalesce(1).mapInArrow(_join, "node long, component long")
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join below has a plain exchange on either side and AQE can split a hub's links.
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.union(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
