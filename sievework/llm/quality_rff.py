"""Quality scores: random Fourier features, ridge regression and isotonic calibration.

A text becomes a vector of document statistics. Random Fourier features of the standardised vector
approximate a Gaussian kernel; ridge scores are fitted from normal equations that every partition
sums for itself, so only matrices of fixed size reach the driver. Scores are calibrated by isotonic
regression on documents that the ridge fit didn't see, from counts in score bins of fixed number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Random Fourier features.
FEATURES = 256
#: Labelled rows that are learned from, about; a quarter of them calibrate.
SAMPLE = 20_000
RIDGE = 1.0
#: Width of the kernel, in units of the square root of half the number of statistics.
WIDTH = 3.0
#: Bins of raw scores for the calibration.
BINS = 2_000

_CLASSES = [
    np.isin(np.arange(256), list(range(97, 123))),  # lower case
    np.isin(np.arange(256), list(range(65, 91))),  # upper case
    np.isin(np.arange(256), list(range(48, 58))),  # digits
    np.arange(256) == 32,
    np.isin(np.arange(256), [9, 10, 11, 12, 13]),
    np.isin(np.arange(256), list(b".,;:?'\"()-")),  # usual punctuation
    np.isin(np.arange(256), list(b"!")),
    np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~")),  # symbols
    np.arange(256) == ord("|"),
    np.arange(256) >= 128,
    np.arange(256) < 9,
]
_CLASS_OF = np.stack(_CLASSES).astype(np.float64)


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, all finite; an empty text has zeros."""
    raw = text.encode()
    n = len(raw)
    share = (_CLASS_OF @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)) / n if n else np.zeros(len(_CLASSES))
    words = raw.split()
    w = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if not w:
        return [*share.tolist(), *([0.0] * 13)]
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False))) if w > 1 else 1
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=w)
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return [
        *share.tolist(),
        np.log1p(w), np.log1p(n), float(lengths.mean()), float(lengths.std()), np.log1p(float(lengths.max())),
        distinct / w, repeats / max(1, w - 1), pairs / max(1, w - 1),
        len({*lines}) / max(1, len(lines)), ends / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        len(zlib.compress(raw, 1)) / n, float(sum(x[:1].isupper() for x in words) / w),
    ]


class Model:
    """Standardisation, random features, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.omega = rng.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d / 2))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.edges, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.omega + self.phase), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores: between the isotonic fit's points by straight lines."""
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over bins in order of score: the non-decreasing fit of positive / total."""
    blocks: list[list[float]] = []
    for p, t in zip(positive, total, strict=True):
        blocks.append([p, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), p / t if t else 0.0) for p, t, n in blocks]) if blocks else np.zeros(0)


def points(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit as points: the mean place and the value of each of its steps, with an end below and above."""
    y = isotonic(positive, total)
    head = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    weight = np.add.reduceat(total, head)
    at, value = np.add.reduceat(x * total, head) / weight, y[head]
    return np.r_[at[0] - 1, at, at[-1] + 1], np.r_[value[0] / 2, value, (1 + value[-1]) / 2]


def is_held_out(id_col: str, fold: int = 0, folds: int = 5) -> Column:
    """Rows that nothing is learned from: a remainder of the id's CRC, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def _sums(df: DataFrame, made, size: int) -> np.ndarray | None:
    """The sum over partitions of arrays of ``size`` floats that ``made`` gives for (x, y, part) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist())
                got = made(x, batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["k", "sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([sum(np.frombuffer(x.as_py()) for x in table["sums"]).tobytes()], pa.binary())})

    # partitions' sums meet in a few tasks first
    few = df.mapInArrow(run, "k long, sums binary").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("k").applyInArrow(add, "sums binary")
    rows = few.collect()  # 16 arrays at most
    return sum(np.frombuffer(r.sums) for r in rows).reshape(-1)[:size] if rows else None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fits on about ``sample`` labelled rows that are not held out, chosen by a hash of their ids; None without any.

    A label that is null is none; of several labels of an id the smallest counts.
    """
    h = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter(~is_held_out("id") & F.col("y").isNotNull())
    n = usable.count()
    if not n:
        return None
    chosen = usable.filter(h < min(1 << 20, -(-sample * (1 << 20) // n))).groupBy("id").agg(F.min("y").alias("y"))
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample is bounded by a parameter, so its ids may be broadcast
    rows = known.join(F.broadcast(chosen), "id").select("text", "y", (F.pmod(F.xxhash64("id", F.lit(6)), F.lit(4)) == 0).alias("part"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "part"])

    x = rows.mapInArrow(measured, "x array<double>, y double, part boolean").persist()
    d = len(statistics(""))
    moments = _sums(x, lambda x, y, part: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), 2 * d + 1)
    if moments is None:
        x.unpersist()
        return None
    n, mean = moments[0], moments[1 : d + 1] / moments[0]
    spread = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))

    m = len(model.weights)

    def normal(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
        f = model.features(x)[~part]
        return np.concatenate([(f.T @ f).ravel(), f.T @ y[~part]])

    sums = _sums(x, normal, m * m + m)
    gram = sums[: m * m].reshape(m, m) + RIDGE * np.eye(m)
    model.weights = np.linalg.solve(gram, sums[m * m :])
    bins = np.linspace(-0.5, 1.5, BINS - 1)

    def counted(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
        at = np.searchsorted(bins, model.raw(x[part]), side="right")
        return np.concatenate([np.bincount(at, y[part], minlength=BINS), np.bincount(at, minlength=BINS).astype(float)])

    sums = _sums(x, counted, 2 * BINS)
    x.unpersist()
    used = np.flatnonzero(sums[BINS:] > 0)
    if len(used):
        model.edges, model.values = points(np.r_[bins[0], (bins[1:] + bins[:-1]) / 2, bins[-1]][used], sums[used], sums[BINS + used])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, sample: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score (0 to 1, higher for likelier label 1), predicted (1 if score >= threshold).

    Scores depend on the whole text alone: rows with equal texts have equal scores, a null text counts
    as empty, and ids, labels and other columns are never inputs. Learned are at most ``sample`` or so
    labelled rows that are not held out; a row without an id is held out. Without any label every score
    is 0.5. Null and repeated ids stay as they are; an empty table gives an empty result.
    """
    model = model or fit(docs, labels, id_col, text_col, label_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            if m is None or not batch.num_rows:
                s = np.full(batch.num_rows, 0.5)
            else:
                s = m.score(np.array([statistics(t.as_py() or "") for t in batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["row_id", "score", "predicted"])

    out = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["row_id"].dataType.simpleString()
    return out.mapInArrow(run, f"row_id {kind}, score double, predicted int").withColumn("held_out", is_held_out("row_id")).select(F.col("row_id").alias(id_col), "held_out", "score", "predicted")
