"""Exact top-k search by inner product with two cover trees.

Queries and data are indexed alike: a node has a centre, a covering radius and children that cover
parts of it. For a query node Q and a data node R no inner product exceeds
cq.cr + rad(Q)|cr| + rad(R)|cq| + rad(Q)rad(R), so the pair is pruned when that is below the worst
kth score that the queries under Q have so far. Pairs that stay are visited by descending bound,
and leaves are scored as matrices.

Data lie in blocks of bounded size, queries in groups; each task searches one group against one
block, and only k results of each pair of query and block are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, shared_folder

#: Vectors of a block and queries of a group.
BLOCK, GROUP = 16_384, 8_192
#: Points of a leaf; a node that would fall into more than a third as many children as points is a leaf too.
LEAF = 48


class Node:
    __slots__ = ("centre", "radius", "norm", "children", "points")

    def __init__(self, centre: np.ndarray, radius: float, children: list[Node], points: np.ndarray):
        self.centre, self.radius, self.children, self.points = centre, radius, children, points
        self.norm = float(np.sqrt(centre @ centre))


def build(x: np.ndarray) -> Node:
    """A cover tree over the rows of ``x``: children are centred on points, apart by more than half their parent's radius and covering it by halves."""

    def grow(points: np.ndarray, centre: np.ndarray) -> Node:
        radius = float(np.sqrt(max(0.0, ((x[points] - centre) ** 2).sum(axis=1).max())))
        node = Node(centre, radius, [], points)
        if len(points) <= LEAF or radius == 0:
            return node
        rest, parts = points, []
        while len(rest):
            c = x[rest[0]]
            inside = ((x[rest] - c) ** 2).sum(axis=1) <= (radius / 2) ** 2
            parts.append((rest[inside], c))
            rest = rest[~inside]
            if len(parts) > len(points) // 3:
                return _flat(node, x)
        if len(parts) > 1:
            node.children = [grow(p, c) for p, c in parts]
        return node

    return grow(np.arange(len(x)), x.mean(axis=0))


def _flat(node: Node, x: np.ndarray) -> Node:
    """A node whose points are all far apart: its children are leaves around some of them."""
    pts = node.points
    n = -(-len(pts) // (4 * LEAF))
    if n < 2:
        return node
    seeds = x[pts[np.linspace(0, len(pts) - 1, n).astype(int)]]
    d = (x[pts] ** 2).sum(axis=1)[:, None] - 2 * x[pts] @ seeds.T + (seeds**2).sum(axis=1)[None]
    own = d.argmin(axis=1)
    for k in range(n):
        mine = pts[own == k]
        if len(mine):
            c = x[mine].mean(axis=0)
            node.children.append(Node(c, float(np.sqrt(((x[mine] - c) ** 2).sum(axis=1).max())), [], mine))
    return node


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries, k) of each query's highest inner products with rows of another id, ties to smaller ids; missing ones have score -inf.

    Rows are whole numbers as float64; products must stay below 2^53.
    """
    n = len(q)
    best, best_id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    if not n or not len(x):
        return best, best_id
    queries, data = build(q), build(x)

    def bounds(a: Node, nodes: list[Node]) -> np.ndarray:
        c = np.stack([r.centre for r in nodes])
        rad, norm = np.array([r.radius for r in nodes]), np.array([r.norm for r in nodes])
        b = c @ a.centre + a.radius * norm + rad * a.norm + a.radius * rad
        return b + 1e-9 * np.abs(b) + 1e-6  # rounding must not prune

    def score(a: Node, r: Node) -> None:
        s = q[a.points] @ x[r.points].T
        ids = np.broadcast_to(x_ids[r.points], s.shape)
        s = np.where(ids == q_ids[a.points][:, None], -np.inf, s)
        if s.shape[1] > 4 * k:  # a first selection; those that tie with the kth stay
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            if (s >= np.maximum(kth, best[a.points, -1])[:, None]).sum(axis=1).max() <= 4 * k:
                top = np.argpartition(-np.where(s >= kth[:, None], s, -np.inf), 4 * k - 1, axis=1)[:, : 4 * k]
                s, ids = np.take_along_axis(s, top, axis=1), np.take_along_axis(ids, top, axis=1)
        s = np.hstack([best[a.points], s])
        ids = np.hstack([best_id[a.points], np.where(np.isinf(s[:, k:]), np.iinfo(np.int64).max, ids)])
        o = np.lexsort((ids, -s), axis=1)[:, :k]
        best[a.points], best_id[a.points] = np.take_along_axis(s, o, axis=1), np.take_along_axis(ids, o, axis=1)

    stack: list[tuple[Node, list[Node]]] = [(queries, [data])]
    while stack:
        a, nodes = stack.pop()
        b = bounds(a, nodes)
        worst = best[a.points, -1].min()
        if a.children:
            nodes = [r for r, v in zip(nodes, b, strict=True) if v >= worst]
            nodes = [c for r in nodes for c in (r.children or [r])]
            if nodes:
                stack += [(c, nodes) for c in a.children]
            continue
        heap = sorted(zip(b.tolist(), range(len(nodes)), nodes, strict=True), key=lambda t: t[0])
        while heap:
            v, _, r = heap.pop()
            if v < best[a.points, -1].min():
                break  # all others are lower
            if r.children:
                heap += zip(bounds(a, r.children).tolist(), range(len(r.children)), r.children, strict=True)
                heap.sort(key=lambda t: t[0])
            else:
                score(a, r)
    return best, best_id


def _plain(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The same for whole numbers of any size, one query at a time; scores beyond 64 bits are cut to the nearest that fits."""
    for v, i in zip(q, q_ids.tolist(), strict=True):
        s = [(-sum(a * b for a, b in zip(v.tolist(), w.tolist(), strict=True)), j) for w, j in zip(x, x_ids.tolist(), strict=True) if j != i]
        for score, j in sorted(s)[:k]:
            yield i, j, max(-(2**63), min(2**63 - 1, -score))


def _pack(size: int, scale: int):
    """Rows (id, vector) to rows of scaled vectors, (dim, part, ids, vectors) of at most ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([np.array([i for i, _ in rows], dtype=np.int64).tobytes()], pa.binary()), pa.array([b"".join(v for _, v in rows)], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                held.setdefault(len(v), []).append((i, v.tobytes()))
                if len(held[len(v)]) >= size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, is_query: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """One row per query and result: query_id, rank (from 1), id_col, score.

    Each component x becomes floor(scale * x), x as double; the score is the integer inner product.
    Queries are the rows for which ``is_query`` holds (ids divisible by 100); candidates are all rows of
    another id and the same length. Each query has its k highest scores, or all if there are fewer; ties
    go to smaller ids. Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part. Rows that repeat an id are candidates of their own, none for a query of that
    id; repeated queries give the same results once. A vector without components has score 0 with all of
    its kind. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    at = shared_folder(spark, "topk")
    asked = is_query if is_query is not None else F.col("id") % 100 == 0
    v = F.col(vec_col).cast("array<double>")
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    schema = "dim long, ids binary, vectors binary"

    data = keep(valid.mapInArrow(_pack(block, scale), schema).withColumn("block", F.monotonically_increasing_id()), f"{at}/data")
    queries = keep(valid.filter(asked).dropDuplicates(["id"]).mapInArrow(_pack(group, scale), schema).withColumn("part", F.monotonically_increasing_id()), f"{at}/queries")
    # blocks, not rows: each data block meets each group of queries of its length
    n_parts = queries.groupBy("dim").agg(F.collect_list("part").alias("parts"))
    n_blocks = data.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    left = data.join(n_parts, "dim").withColumn("part", F.explode("parts")).select("block", "part", "ids", "vectors")
    right = queries.join(n_blocks, "dim").withColumn("block", F.explode("blocks")).select("block", "part", "dim", "ids", "vectors")

    def find(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, dtype=np.int64)] * 3
        if data.num_rows and queries.num_rows:
            dim = queries["dim"][0].as_py()
            read = lambda t: (np.frombuffer(t["ids"][0].as_py(), dtype=np.int64), np.frombuffer(t["vectors"][0].as_py(), dtype=np.float64))
            (x_ids, x), (q_ids, q) = read(data), read(queries)
            x, q = x.reshape(len(x_ids), dim), q.reshape(len(q_ids), dim)
            most = (np.abs(x).max() if x.size else 0) * (np.abs(q).max() if q.size else 0) * max(1, dim)
            if most < 2**52:
                s, ids = search(q, q_ids, x, x_ids, k)
                hit = ~np.isinf(s)
                out = [np.repeat(q_ids, k)[hit.ravel()], ids[hit], s[hit].astype(np.int64)]
            else:
                big = np.vectorize(int, otypes=[object])
                rows = list(_plain(big(q), q_ids, big(x), x_ids, k))
                out = [np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)] if rows else out
        return pa.table({"query_id": pa.array(out[0]), "id": pa.array(out[1]), "score": pa.array(out[2])})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(find, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
