"""Rank statistics. Rows are collapsed to counts per distinct value before anything is ordered."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import quantiles, running


def unpivot(df: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep..., dimension, v) for each of ``columns``."""
    parts = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("v")) for c in columns))
    return df.select(*keep, F.explode_outer(parts).alias("_s")).select(*keep, "_s.dimension", "_s.v")


def auc(long: DataFrame, by: tuple[str, ...] = ("dimension",), value: str = "v", correct: str = "correct") -> DataFrame:
    """Area under the ROC curve per ``by``, ties by half; null if a class is empty."""
    counts = long.groupBy(*by, value).agg(F.count_if(correct).alias("pos"), F.count_if(~F.col(correct)).alias("neg"))
    placed = running(counts, by, [F.col(value)], {"below": F.col("neg")})
    return placed.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(*by, F.try_divide("a", F.col("p") * F.col("n")).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def average_rank(df: DataFrame, value: str, by: tuple[str, ...], out: str) -> DataFrame:
    """``df`` with the average rank of ``value`` within ``by``, from counts per distinct value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running(counts, by, [F.col(value)], {"_before": F.col("_n")}).select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient; null if a side is constant."""
    n = F.count("*")
    cov = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation of two columns per ``by``, with the value at which it is significant."""
    keys = by or ("_all",)
    base = df if by else df.withColumn("_all", F.lit(0))
    ranked = average_rank(average_rank(base, x, keys, "_rx"), y, keys, "_ry")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col("_rx"), F.col("_ry")).alias("rho"))
    out = out.withColumn("threshold", F.when(F.col("n") > 1, F.lit(1.96) / F.sqrt(F.col("n") - 1)))
    return out if by else out.drop("_all")


def with_all(df: DataFrame, by: str) -> DataFrame:
    """``df`` twice: under its own ``by`` and under ALL, as ranks differ between the two."""
    return df.withColumn(by, F.explode_outer(F.array(F.col(by), F.lit("ALL"))))


def fit_knots(df: DataFrame, column: str = "raw_score") -> DataFrame:
    """101 interpolated quantiles: the table that calibration uses."""
    got = quantiles(df, column, [p / 100 for p in range(101)])
    share = df.agg(F.avg((F.col(column) >= 70).cast("int"))).first()[0]
    rows = [(p, x, share) for p, x in enumerate(got) if x is not None]
    return df.sparkSession.createDataFrame(rows, "p int, knot double, at_least_70 double")


#: Rows whose weights are drawn at once, so that they stay in a core's cache.
AT_ONCE = 64
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_PART = "dimension string, p int, n int, absent boolean, v double, area binary, pos binary, neg binary"


def poisson(hashed: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights: a row for each of ``hashed``, xxhash64 of an id, a column for each replicate r from 1. They come from the 30 lowest bits of xxhash64(id, r)."""
    x = (hashed.view("u8") + (_P5 + np.uint64(4)))[:, None] ^ (np.arange(1, replicates + 1, dtype="u8") * _P1)
    x = (x << np.uint64(23) | x >> np.uint64(41)) * _P2 + _P3
    x ^= x >> np.uint64(33)
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    low = (x & np.uint64((1 << 30) - 1)).astype("u4")
    w = np.zeros(low.shape, "u1")
    for s in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]):
        w += low >= np.uint32(math.floor(float(s) * (1 << 30) - 0.5) + 1)  # (low + 0.5) / 2^30 > s
    return w


class _Curve:
    """Of each replicate: twice the area under values that came in order, the positives and the negatives."""

    def __init__(self, replicates: int) -> None:
        self.area, self.pos, self.neg = np.zeros((3, replicates), "i8")

    def add(self, area: np.ndarray | int, pos: np.ndarray, neg: np.ndarray) -> None:
        """What comes next: a single value, of area ``pos * neg``, or the curve of several."""
        self.area += area + 2 * self.neg * pos
        self.pos += pos
        self.neg += neg

    def values(self, pos: np.ndarray, neg: np.ndarray) -> None:
        """Values in order, a row each."""
        below = np.cumsum(neg, axis=0) - neg
        self.add((pos * (2 * below + neg)).sum(axis=0), pos.sum(axis=0), neg.sum(axis=0))


def _parts(replicates: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a range of sorted rows (p, dimension, absent, v, h, good, bad), for each dimension: its first value, the curve of those between, and its last value, as other ranges may have the same."""
    same = lambda a, b: a[0] == b[0] and (a[1] == b[1] or a[1] != a[1] and b[1] != b[1])  # noqa: E731  # NaN is one value
    kinds = pa.schema([("dimension", pa.string()), ("p", pa.int32()), ("n", pa.int32()), ("absent", pa.bool_()), ("v", pa.float64()), ("area", pa.binary()), ("pos", pa.binary()), ("neg", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimension, p, open_, curve, out = None, 0, None, None, []

        def put(key: tuple | None, area: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
            absent, v = key or (None, None)
            out.append({"dimension": dimension, "p": p, "n": len(out), "absent": absent, "v": v, "area": area.tobytes(), "pos": pos.tobytes(), "neg": neg.tobytes()})

        def close() -> None:
            if curve is not None:
                put(None, curve.area, curve.pos, curve.neg)
            if open_ is not None:
                put(open_[0], open_[1] * open_[2], open_[1], open_[2])

        for batch in batches:
            names, absent = batch["dimension"].to_pylist(), batch["absent"].to_pylist()
            v, h, good, bad = batch["v"].fill_null(0.0).to_pylist(), batch["h"].to_numpy(), *(batch[c].to_numpy(zero_copy_only=False).astype("u1")[:, None] for c in ("good", "bad"))
            p = batch["p"][0].as_py() if names else p
            a = 0
            while a < len(names):
                if names[a] != dimension:
                    close()
                    dimension, open_, curve = names[a], None, None
                b = a + 1
                while b < min(a + AT_ONCE, len(names)) and names[b] == dimension:
                    b += 1
                keys = list(zip(absent[a:b], v[a:b]))
                starts = [0, *(k for k in range(1, b - a) if not same(keys[k - 1], keys[k]))]
                w = poisson(h[a:b], replicates)
                pos, neg = (np.add.reduceat(w * flag[a:b], starts, axis=0, dtype="i8") for flag in (good, bad))
                if open_ is not None:
                    if same(open_[0], keys[0]):
                        pos[0] += open_[1]
                        neg[0] += open_[2]
                    elif curve is None:
                        curve = _Curve(replicates)
                        put(open_[0], open_[1] * open_[2], open_[1], open_[2])
                    else:
                        curve.add(open_[1] * open_[2], open_[1], open_[2])
                full = len(starts) - 1  # values that are complete
                if full and curve is None:
                    curve = _Curve(replicates)
                    put(keys[0], pos[0] * neg[0], pos[0], neg[0])
                    curve.values(pos[1:full], neg[1:full])
                else:
                    curve is not None and curve.values(pos[:full], neg[:full])
                open_ = (keys[starts[-1]], pos[-1], neg[-1])
                a = b
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return run


def _replicates(df: DataFrame, columns: tuple[str, ...], correct: str, replicates: int) -> dict[str, list[float | None]]:
    """For each of ``columns`` the AUC of every replicate."""
    long = unpivot(df.withColumns({"h": F.xxhash64("id"), "good": F.coalesce(F.col(correct), F.lit(False)), "bad": F.coalesce(~F.col(correct), F.lit(False))}), columns, ("h", "good", "bad"))
    # equal values may lie in several ranges, so that none grows with the rows that share a value
    ranged = long.repartitionByRange(4 * df.sparkSession.sparkContext.defaultParallelism, "dimension", "v", "h").sortWithinPartitions("dimension", "v")
    rows = ranged.select(F.spark_partition_id().alias("p"), "dimension", F.col("v").isNull().alias("absent"), "v", "h", "good", "bad").mapInArrow(_parts(replicates), _PART).collect()
    out = {}
    for c in columns:
        curve, open_ = _Curve(replicates), None
        for r in sorted((r for r in rows if r.dimension == c), key=lambda r: (r.p, r.n)):
            area, pos, neg = (np.frombuffer(r[k], "i8") for k in ("area", "pos", "neg"))
            key = None if r.absent is None else (r.absent, str(r.v))
            if open_ and key == open_[0]:
                open_ = (key, open_[1] + pos, open_[2] + neg)
                continue
            if open_:
                curve.add(open_[1] * open_[2], open_[1], open_[2])
                open_ = None
            if key is None:
                curve.add(area, pos, neg)
            else:
                open_ = (key, pos, neg)
        if open_:
            curve.add(open_[1] * open_[2], open_[1], open_[2])
        out[c] = [float(a) / 2 / (float(p) * float(n)) if p and n else None for a, p, n in zip(curve.area, curve.pos, curve.neg, strict=True)]
    return out


def bootstrap_auc(df: DataFrame, value: str, correct: str = "correct", replicates: int = 400, other: str | None = None) -> DataFrame:
    """AUC of ``value`` and its 95 per cent interval; with ``other`` the interval of the difference of both on the same resamples.

    Weights are Poisson(1), drawn from a hash of id and replicate. Rows are sorted by range once; each range draws the
    weights of its rows, a few at a time, and returns sums per replicate, so no row is ever repeated.
    """
    got = _replicates(df, (value, other) if other else (value,), correct, replicates)
    aucs = got[value] if not other else [None if a is None or b is None else a - b for a, b in zip(got[value], got[other], strict=True)]
    per = df.sparkSession.createDataFrame([(a,) for a in aucs], "auc double")
    return per.agg(F.avg("auc").alias("mean"), F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count("auc").alias("replicates"))


def discordant_pairs(df: DataFrame, columns: tuple[str, ...], problem: str = "problem_id", correct: str = "correct") -> DataFrame:
    """For problems with one right and one wrong row: how often the right one scores higher, ties left out."""
    pairs = df.groupBy(problem).agg(F.count("*").alias("n"), F.count_if(correct).alias("good"), *(F.max(F.when(F.col(correct), F.col(c))).alias(f"g_{c}") for c in columns), *(F.max(F.when(~F.col(correct), F.col(c))).alias(f"b_{c}") for c in columns)).filter("n = 2 and good = 1")
    rows = F.array(*(F.struct(F.lit(c).alias("signal"), F.col(f"g_{c}").cast("double").alias("g"), F.col(f"b_{c}").cast("double").alias("b")) for c in columns))
    long = pairs.select(F.explode_outer(rows).alias("s"))
    return long.groupBy("s.signal").agg(F.count_if(F.col("s.g") > F.col("s.b")).alias("wins"), F.count_if(F.col("s.g") < F.col("s.b")).alias("losses"), F.count_if(F.col("s.g") == F.col("s.b")).alias("ties"))


def binomial_p(wins: int, losses: int) -> float:
    """Exact two-sided p value of a fair coin."""
    n, k = wins + losses, max(wins, losses)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n)


def standardized(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` less their means over their population deviations (1 where constant)."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))  # one row
    sd = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / sd(c) for c in columns}).drop(*(f"{p}_{c}" for p in "ms" for c in columns))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rate: float = 0.3, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; the bias isn't regularised."""
    w, b, n = np.zeros(x.shape[1]), 0.0, len(y)
    for _ in range(steps):
        d = 1 / (1 + np.exp(-np.clip(x @ w + b, -35, 35))) - y
        w -= rate * (x.T @ d / n + l2 * w / n)
        b -= rate * d.mean()
    return w, b


def logistic_by_group(df: DataFrame, group: str, columns: tuple[str, ...], correct: str = "correct") -> DataFrame:
    """One row per group: fitted weights. Groups are samples of a study, so one fits a task."""

    def fit(t: pa.Table) -> pa.Table:
        x = np.stack([t[c].to_numpy().astype(float) for c in columns], axis=1)
        sd = x.std(axis=0)
        w, b = logistic((x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), t[correct].to_numpy(zero_copy_only=False).astype(float))
        return pa.table({"grp": pa.array([str(t[group][0].as_py())]), "weights": pa.array([w.tolist()]), "bias": pa.array([b])})

    return df.select(group, correct, *columns).groupBy(group).applyInArrow(fit, "grp string, weights array<double>, bias double")
