"""Gradient-boosted trees for a binary label, fitted on any number of rows.

Each level of a tree needs only sums of gradients by node, feature and bin. These are added up where the
rows lie, so only arrays of fixed size reach the driver. Gradients are rounded to a fixed grid: their sums
are whole numbers and exact below 2^33 rows, so the trees don't depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import clear, keep, made, release, shared_folder

#: Bins of a feature between which a tree can split.
BINS = 32
#: Values that are told apart before the bins are known; all whole numbers below 192, then ever wider steps.
GRID = np.array([*range(192), *range(200, 255, 8), 255, *(x for k in range(8, 33) for x in (1 << k, 3 << (k - 1)))][:255], dtype=np.float32)
CODES = len(GRID) + 1
#: Parts of 1 to which gradients and what trees add are rounded.
GRADIENT, STEP = 1 << 20, 1 << 12
#: Rows of a block, and rows among which equal ones are made one.
BLOCK_ROWS, EQUAL_ROWS = 1 << 15, 1 << 18
#: Trees after which the rows' sums are written anew.
ADVANCE = 10
#: Cells of several features' bins that are counted at once.
CELLS = 1 << 12
#: Arrays that are sent to the driver at once; of more, tasks add some up first.
ARRAYS = 256
_NO_CUT = np.uint8(255)
#: feature and bin of each node, and what each leaf adds in units of 1 / STEP
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def codes(x: np.ndarray) -> np.ndarray:
    """Places in GRID: a code is above i where the value is above GRID[i]."""
    return np.searchsorted(GRID, x, side="left").astype(np.uint8)


def counts(code: np.ndarray) -> np.ndarray:
    """How often each feature has each code; ``code`` is (features, rows)."""
    return np.stack([np.bincount(c, minlength=CODES) for c in code])


class Bins:
    """Bins of each feature: one per value where there are few, otherwise of about equal size."""

    def __init__(self, count: np.ndarray):
        self.edges = []
        for c in count:
            have = np.flatnonzero(c)
            if len(have) > BINS:
                have = np.unique(np.r_[np.searchsorted(c.cumsum(), np.maximum(1, np.linspace(0, 1, BINS)[:-1] * c.sum())), have[-1]])
            self.edges.append(have[:-1])
        self._bin = np.stack([np.searchsorted(e, np.arange(CODES), side="left") for e in self.edges]).astype(np.uint8)
        self.groups: list[list[int]] = []
        cells = CELLS + 1
        for j, e in enumerate(self.edges):
            if len(e):
                if cells * (len(e) + 1) > CELLS:
                    self.groups.append([])
                    cells = 1
                self.groups[-1].append(j)
                cells *= len(e) + 1

    def of(self, code: np.ndarray) -> np.ndarray:
        return np.stack([b[c] for b, c in zip(self._bin, code, strict=True)])

    def sizes(self, group: list[int]) -> list[int]:
        return [len(self.edges[j]) + 1 for j in group]


class Block:
    """Distinct rows in bins: ``bins`` (features, rows), ``cells`` (groups, rows), labels, what the trees so far add up to, and how many rows are equal."""

    def __init__(self, bins: np.ndarray, cells: np.ndarray, y: np.ndarray, f: np.ndarray, size: np.ndarray):
        self.bins, self.cells, self.y, self.f, self.size = bins, cells, y, f, size

    @staticmethod
    def of(code: np.ndarray, y: np.ndarray, bins: Bins, base: int) -> Iterator[Block]:
        b = bins.of(code)
        cells = np.zeros((len(bins.groups), b.shape[1]), dtype=np.uint16)
        for k, group in enumerate(bins.groups):
            for j, size in zip(group, bins.sizes(group), strict=True):
                cells[k] = cells[k] * size + b[j]
        whole = np.ascontiguousarray(np.concatenate([cells, [y.astype(np.uint16)]]).T).view(f"V{2 * len(cells) + 2}")[:, 0]
        _, first, size = np.unique(whole, return_index=True, return_counts=True)
        for k in range(0, len(first), BLOCK_ROWS):
            at = first[k : k + BLOCK_ROWS]
            yield Block(b[:, at], cells[:, at], y[at].astype(np.uint8), np.full(len(at), base, dtype=np.int32), size[k : k + BLOCK_ROWS].astype(np.int32))

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in (self.bins, self.cells, self.y, self.f, self.size)))

    @staticmethod
    def unpacked(body: bytes, n: int, features: int, groups: int) -> Block:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=n * (features + 2 * groups + 9)), dtype=np.uint8)
        bins, cells, y, f, size = np.split(raw, np.cumsum([n * features, 2 * n * groups, n, 4 * n]))
        # copies, so that numbers lie at even addresses
        return Block(bins.reshape(features, n), cells.copy().view(np.uint16).reshape(groups, n), y, f.copy().view(np.int32), size.copy().view(np.int32))

    def add(self, trees: list[Tree]) -> None:
        self.f = grown(self.bins, trees, self.f)

    def sums(self, bins: Bins, feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Gradients and second derivatives by (node of ``level``, feature, bin); behind the features stand all rows."""
        nodes = 1 << level
        node = place(self.bins, feature, at, level).astype(np.int64)
        q = 1 / (1 + np.exp(self.f / -STEP))
        out = np.zeros((2, nodes, len(self.bins) + 1, BINS))
        for k, w in enumerate((np.rint((q - self.y) * GRADIENT) * self.size, np.rint(q * (1 - q) * GRADIENT) * self.size)):
            out[k, :, -1, 0] = np.bincount(node, w, minlength=nodes)
            for group, cell in zip(bins.groups, self.cells, strict=True):
                sizes = bins.sizes(group)
                cells = int(np.prod(sizes))
                had = np.bincount(node * cells + cell, w, minlength=nodes * cells).reshape(nodes, *sizes)
                for axis, j in enumerate(group, 1):
                    out[k, :, j, : sizes[axis - 1]] = had.sum(axis=tuple(a for a in range(1, had.ndim) if a != axis))
        return out


def place(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Which node of level ``depth`` each row comes to."""

    def below(k: int, levels: int) -> np.ndarray:
        if not levels:
            return np.uint8(0)
        low = below(2 * k + 1, levels - 1)
        if at[k] == _NO_CUT:
            return low
        return np.where(bins[feature[k]] > at[k], below(2 * k + 2, levels - 1) + np.uint8(1 << (levels - 1)), low)

    return np.broadcast_to(below(0, depth), bins.shape[1])


def grown(bins: np.ndarray, trees: list[Tree], f: np.ndarray) -> np.ndarray:
    """``f`` and what the trees add, in units of 1 / STEP."""
    for feature, at, steps in trees:
        f = f + steps[place(bins, feature, at, len(steps).bit_length() - 1)]
    return f


class Near:
    """Blocks in memory."""

    def __init__(self, blocks: list[Block], bins: Bins):
        self.blocks, self.bins = blocks, bins

    def add(self, tree: Tree) -> None:
        for b in self.blocks:
            b.add([tree])

    def sums(self, feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        return sum(b.sums(self.bins, feature, at, level) for b in self.blocks)


class Spread:
    """Blocks in a table of the shared folder: ``n`` and ``body``."""

    SCHEMA = "n int, body binary"

    def __init__(self, blocks: DataFrame, bins: Bins):
        self.bins, self.spark, self.begun = bins, blocks.sparkSession, made()
        self.trees: list[Tree] = []
        self._write(blocks)

    def _write(self, blocks: DataFrame) -> None:
        at = shared_folder(self.spark, "boosting")
        self.blocks = keep(blocks, at, compression="none")
        self.parts = self.blocks.rdd.getNumPartitions()
        clear(self.spark, self.begun, but=at)

    def _each(self) -> Callable[[pa.RecordBatch], Iterator[Block]]:
        bins, trees = self.bins, list(self.trees)

        def each(batch: pa.RecordBatch) -> Iterator[Block]:
            for n, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block.unpacked(body.as_py(), n, len(bins.edges), len(bins.groups))
                block.add(trees)
                yield block

        return each

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        if len(self.trees) >= ADVANCE:
            each = self._each()

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for b in each(batch):
                        yield pa.RecordBatch.from_arrays([pa.array([len(b.y)], pa.int32()), pa.array([b.packed()], pa.binary())], names=["n", "body"])

            self._write(self.blocks.mapInArrow(run, self.SCHEMA))
            self.trees = []

    def sums(self, feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        bins, each = self.bins, self._each()
        shape = (2, 1 << level, len(bins.edges) + 1, BINS)
        return total(self.blocks, self.parts, lambda batch: sum(b.sums(bins, feature, at, level) for b in each(batch)), shape)


def total(rows: DataFrame, parts: int, of: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``of`` over all batches of a table of ``parts`` partitions; an array of whole numbers and of fixed shape."""

    def run(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], np.ndarray] = of) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                out += of(batch)
        release()
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(out.tobytes())], pa.binary())], names=["sums"])

    def back(body: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(body)).reshape(shape)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches, lambda batch: sum(back(x.as_py()) for x in batch.column(0)))

    out = rows.mapInArrow(run, "sums binary")
    while parts > ARRAYS:
        parts = -(-parts // 64)
        out = out.repartition(parts).mapInArrow(more, "sums binary")
    return sum((back(r.sums) for r in out.collect()), np.zeros(shape))


class Boosted:
    """Trees of fixed depth on binned features, logistic loss with Newton leaves."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2 = rounds, depth, rate, l2
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: the same trees on bins
        self.steps: list[Tree] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        code = codes(x.T)
        bins = Bins(counts(code))
        base = self.start(len(y), int(y.sum()))
        return self.grow(Near(list(Block.of(code, y, bins, base)), bins))

    def start(self, rows: int, positive: int) -> int:
        """Sets what all rows begin with; returns it in units of 1 / STEP."""
        p = min(max(positive / rows, 1e-4), 1 - 1e-4)
        base = round(float(np.log(p / (1 - p))) * STEP)
        self.base = base / STEP
        return base

    def grow(self, rows: Near | Spread) -> Boosted:
        for _ in range(self.rounds):
            feature = np.zeros(2**self.depth - 1, dtype=np.int64)
            at = np.full(2**self.depth - 1, _NO_CUT)
            leaf = np.zeros(2**self.depth)
            for d in range(self.depth):
                g, h = rows.sums(feature, at, d) / GRADIENT
                gt, ht = g[:, -1, :1, None], h[:, -1, :1, None]
                gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                for k in range(2**d):
                    j, i = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                    parts = [(gt[k, 0, 0], ht[k, 0, 0]), (0.0, 0.0)]
                    if gain[k, j, i] > 1e-6:
                        feature[2**d - 1 + k], at[2**d - 1 + k] = j, i
                        parts = [(gl[k, j, i], hl[k, j, i]), (gt[k, 0, 0] - gl[k, j, i], ht[k, 0, 0] - hl[k, j, i])]
                    if d == self.depth - 1:
                        leaf[2 * k : 2 * k + 2] = [-a / (b + self.l2) for a, b in parts]
            steps = np.rint(self.rate * leaf * STEP).astype(np.int32)
            cut = np.array([np.inf if i == _NO_CUT else float(GRID[rows.bins.edges[j][i]]) for j, i in zip(feature, at, strict=True)])
            self.steps.append((feature, at, steps))
            self.trees.append((feature, cut, steps / STEP))
            rows.add(self.steps[-1])
        return self

    def score(self, x: np.ndarray, least: float = 0.0) -> np.ndarray:
        """Probability of label 1 for each row; 0 for rows that stay below ``least``."""
        floor = np.log(least / (1 - least)) - 1e-9 if 0 < least < 1 else -np.inf
        most = [max(float(leaf.max()), 0.0) for _, _, leaf in self.trees]
        ahead = np.r_[np.cumsum(most[::-1])[::-1], 0.0]  # what trees from here on can add
        out = np.full(len(x), -np.inf)
        for lo in range(0, len(x), 1 << 14):
            columns = np.ascontiguousarray(x[lo : lo + (1 << 14)].T)
            f = np.full(columns.shape[1], self.base)
            alive = np.arange(lo, lo + columns.shape[1])
            for k, tree in enumerate(self.trees):
                if k % 10 == 0:
                    may = f + ahead[k] >= floor
                    if not may.all():
                        columns, f, alive = np.ascontiguousarray(columns[:, may]), f[may], alive[may]
                f = f + self._leaf(columns, tree, 0)
            out[alive] = f
        return 1 / (1 + np.exp(-out))

    def _leaf(self, columns: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray | float:
        """The value that the tree's node ``k`` gives to each column."""
        feature, cut, leaf = tree
        if k >= len(feature):
            return float(leaf[k - len(feature)])
        low = self._leaf(columns, tree, 2 * k + 1)
        if cut[k] == np.inf:
            return low
        return np.where(columns[feature[k]] > float(cut[k]), self._leaf(columns, tree, 2 * k + 2), low)
