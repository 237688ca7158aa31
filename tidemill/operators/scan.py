"""Running aggregates over arrival order that no single task has to see whole.

A window over all rows in order sends every row to one task, and one over a hot
key sends a third of them there.  Running sums, counts and maxima are
associative, so the order is cut into blocks by its number: blocks are
aggregated (with map-side combining), the blocks before each are folded over
one row a block, and only within a block is a row-by-row window run.  The cost
is one shuffle of the rows by (keys, block).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive order numbers that make a block.
BLOCK = 1 << 16

_FOLD = {"max": F.max, "sum": F.sum, "count": F.count}


def _join(kind: str, before: Column, here: Column) -> Column:
    if kind == "max":  # greatest skips nulls
        return F.greatest(before, here)
    zero = F.lit(0)
    return F.when(before.isNull() & here.isNull(), None).otherwise(F.coalesce(before, zero) + F.coalesce(here, zero))


def running(df: DataFrame, order: str, aggregates: Mapping[str, tuple[str, Column]], keys: tuple[str, ...] = (), inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """``df`` with running aggregates by ``order``, a whole number unique within ``keys``.

    ``aggregates``: name -> (max, sum or count; expression).  A maximum over a
    struct that starts with ``order`` is the latest value that isn't null.
    With ``inclusive`` false a row sees only the rows before it.
    """
    on = [*keys, "__block"]
    cut = df.withColumns({f"__x_{n}": x for n, (_, x) in aggregates.items()}).withColumn("__block", F.expr(f"`{order}` div {block}").cast("long"))
    totals = cut.groupBy(*on).agg(*[_FOLD[k](f"__x_{n}").alias(f"__t_{n}") for n, (k, _) in aggregates.items()])
    earlier = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    fold = {n: F.sum if k == "count" else _FOLD[k] for n, (k, _) in aggregates.items()}
    before = totals.select(*on, *[fold[n](f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in aggregates])
    here = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    before = before.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(on)})
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)]  # null keys are a key, too
    joined = cut.join(before, reduce(and_, same))
    out = joined.withColumns({n: _join(k, F.col(f"__b_{n}"), _FOLD[k](f"__x_{n}").over(here)) for n, (k, _) in aggregates.items()})
    return out.select(*df.columns, *aggregates)


def latest_before(df: DataFrame, order: str, name: str, value: Column, keys: tuple[str, ...] = (), where: Column | None = None, inclusive: bool = False) -> DataFrame:
    """``df`` with the struct (order, v) of the latest row before that ``where`` holds for."""
    seen = F.struct(F.col(order), value.alias("v"))
    return running(df, order, {name: ("max", seen if where is None else F.when(where, seen))}, keys, inclusive)
