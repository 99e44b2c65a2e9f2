"""Order statistics without a sort: rounds of counts on ever finer grids, each of bounded size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the first grid; each later round splits the cells that still matter into so many.
FIRST, SPLIT = 1 << 14, 1 << 7
#: Ranks asked for at once, which bounds the cells of a round.
RANKS = 512


def order_statistics(df: DataFrame, column: str | Column, ranks: Sequence[int]) -> dict[int, tuple[float, int]]:
    """For each rank (from 0) the value that has it in ascending order, as double, and how many values are smaller.

    Nulls, NaN and infinite values are none; a rank beyond the values has no entry. Only cells of the grid reach the
    driver, FIRST or RANKS * SPLIT at most, and tasks add up what they have first. Values alone are kept on disk
    between the rounds.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))).persist(StorageLevel.DISK_ONLY)
    try:
        low, high, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
        found: dict[int, tuple[float, int]] = {}
        asked = sorted({r for r in ranks if 0 <= r < n})
        for at in range(0, len(asked), RANKS):
            found |= _found(values, low, high, asked[at : at + RANKS])
        return found
    finally:
        values.unpersist()


def _found(values: DataFrame, low: float, high: float, ranks: list[int]) -> dict[int, tuple[float, int]]:
    if low == high:
        return {r: (low, 0) for r in ranks}
    done: dict[int, tuple[float, int]] = {}
    cells = float(FIRST)
    cell = lambda c: F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * c)  # noqa: E731  # halves can't overflow
    open_: dict[int, tuple[int, list[int]]] = {0: (0, ranks)}  # cell of the round before: values below it, ranks in it
    before: Column | None = None
    while open_:
        rows = values if before is None else values.filter(before.isin(list(open_)))
        parent = F.lit(0).cast("long") if before is None else before
        got = rows.groupBy(parent.alias("p"), cell(cells).alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by_cell: dict[int, list] = {}
        for r in got:
            by_cell.setdefault(r.p, []).append(r)
        next_: dict[int, tuple[int, list[int]]] = {}
        for p, (below, wanted) in open_.items():
            wanted = list(wanted)
            for r in sorted(by_cell.get(p, ()), key=lambda r: r.lo):
                inside = [k for k in wanted if k < below + r.n]
                if inside:
                    wanted = wanted[len(inside) :]
                    if r.lo == r.hi:
                        done |= {k: (r.lo, below) for k in inside}
                    else:
                        next_[r.c] = (below, inside)
                below += r.n
        before, open_, cells = cell(cells), next_, cells * SPLIT
        if open_ and cells > 2.0**60:  # values closer than the grid can tell
            for c, (below, wanted) in open_.items():
                for r in values.filter(before == c).groupBy("x").count().orderBy("x").toLocalIterator():
                    done |= {k: (r.x, below) for k in wanted if below <= k < below + r["count"]}
                    below += r["count"]
            break
    return done


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with columns of sums over the rows before each one within ``by``, in ``order``, which leaves no ties.

    Rows are sorted by range, each range adds up its own and the totals of the ranges before come on top, so no task
    holds a group. The ranges are kept on disk, as they aren't the same when they are drawn again.
    """
    ranged = df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    own = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_p").agg(*(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    offsets = totals.select(*(F.col(c).alias(f"_b_{i}") for i, c in enumerate((*by, "_p"))), *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = ranged.withColumns({f"_i_{k}": F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_b_{i}")) for i, c in enumerate((*by, "_p"))]
    return inside.join(offsets, same).select(*df.columns, *((F.col(f"_i_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))


def quantiles(df: DataFrame, column: str | Column, qs: Sequence[float]) -> list[float | None]:
    """Quantiles interpolated between neighbours; null without values."""
    x = F.col(column) if isinstance(column, str) else column
    x = x.cast("double")
    n = df.select(F.count_if(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).first()[0]
    if not n:
        return [None] * len(qs)
    places = [q * (n - 1) for q in qs]
    got = order_statistics(df, x, [r for p in places for r in (math.floor(p), math.ceil(p))])
    out = []
    for p in places:
        a, b = math.floor(p), math.ceil(p)
        out.append(got[a][0] if a == b else (b - p) * got[a][0] + (p - a) * got[b][0])
    return out


def first_rows(df: DataFrame, key: Column, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of smallest ``key`` (a number), ties by smallest ``tie``; equal rows in both are taken as they come.

    One filter on ``df`` in the end: rows are moved neither by size nor by order. Of rows that share the last key only
    ``tie`` is sorted, by range. The rows' order isn't that of the key.
    """
    if k <= 0:
        return df.limit(0)
    key = key.cast("double")
    last = order_statistics(df, key, [k - 1]).get(k - 1)
    if last is None:  # all rows
        return df
    value, below = last
    tied = df.filter(key == value).select(F.col(tie).alias("t"))
    need = k - below
    if tied.count() <= need:
        return df.filter(key <= value)
    if need <= FIRST:
        cut = tied.orderBy("t").limit(need).agg(F.max("t")).first()[0]
    else:
        cut = tied.orderBy("t").rdd.zipWithIndex().filter(lambda x: x[1] == need - 1).map(lambda x: x[0][0]).first()
    same = F.col(tie).eqNullSafe(F.lit(cut))
    smaller = F.coalesce(F.col(tie) < F.lit(cut), F.col(tie).isNull()) & ~same if cut is not None else F.lit(False)
    counts = tied.agg(F.count_if(F.col("t").eqNullSafe(F.lit(cut))), F.count_if(F.coalesce(F.col("t") < F.lit(cut), F.col("t").isNull()) & ~F.col("t").eqNullSafe(F.lit(cut))) if cut is not None else F.lit(0)).first()
    if counts[0] == need - counts[1]:
        return df.filter((key < value) | ((key == value) & (smaller | same)))
    return df.filter((key < value) | ((key == value) & smaller)).unionByName(df.filter((key == value) & same).limit(need - counts[1]))
