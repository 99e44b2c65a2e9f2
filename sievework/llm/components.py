"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Edges that one task takes at the end; more go through further rounds.
LAST = 4_000_000
EDGES = "v long, root long"


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the smallest vertex of each one's component."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(v))
    while len(x):
        lx, ly = label[x], label[y]
        new = label.copy()
        np.minimum.at(new, lx, ly)
        np.minimum.at(new, ly, lx)
        while (nxt := new[new]).tobytes() != new.tobytes():
            new = nxt
        label = new
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return v, v[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task to at most one per vertex, which links it to its smallest connected one."""
    a, b, n = [], [], 0

    def shrink() -> tuple[np.ndarray, np.ndarray]:
        v, root = labels(np.concatenate(a), np.concatenate(b))
        m = v != root
        return v[m], root[m]

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n > 2 * LAST:
            x, y = shrink()
            a, b, n = [x], [y], len(x)
            if n > LAST:  # hardly connected: pass on what there is
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["v", "root"])
                a, b, n = [], [], 0
    if n:
        x, y = shrink()
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["v", "root"])


def components(edges: DataFrame, path: str, last: int = LAST) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (two long columns) but the roots: root is the smallest vertex of v's component.

    Every task first shrinks its edges to a forest. While more than ``last`` edges are left, rounds of
    large-star and small-star steps, written to ``path``, shorten all paths; then one task ends it.
    """
    a, b = edges.columns
    df = keep(edges.select(F.col(a).alias("v"), F.col(b).alias("root")).filter("v <> root").mapInArrow(_forest, EDGES), f"{path}-0")
    step = 0
    while df.count() > last:
        step += 1
        both = df.union(df.select("root", "v")).toDF("u", "w")
        # large star: of u's neighbours, the larger ones link to the smallest of all
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("root"))
        # small star: u and its smaller neighbours link to the smallest
        down = large.select(F.greatest("v", "root").alias("u"), F.least("v", "root").alias("w")).filter("u <> w")
        low = down.groupBy("u").agg(F.min("w").alias("m"))
        star = down.join(low, "u").select(F.col("w").alias("v"), F.col("m").alias("root")).union(low.select(F.col("u").alias("v"), F.col("m").alias("root")))
        new = keep(star.filter("v <> root").distinct(), f"{path}-{step}")
        if new.exceptAll(df).isEmpty() and df.exceptAll(new).isEmpty():
            return new  # every vertex links to its root
        df = new
    return keep(df.coalesce(1).mapInArrow(_forest, EDGES), f"{path}-end")
