"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

One narrow pass tokenises and cuts; only piece lengths are packed. Pieces are spread by hash over
groups of bounded size, so the groups' number grows with the input and no task holds more than one.
A group is packed by best fit in decreasing order. Then bins that aren't full exchange pieces, one
for one, two for one or by a move, always towards a larger sum of squared fills, until a bin is
empty; this ends when the bins are as few as the total length needs, or when no bin has an exchange left.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, shared_folder, slices

#: Pieces of a group, about. The last bins of a group may be underfull, so larger groups pack better.
GROUP = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[str, int]:
    """Byte-level files' letter for each byte: itself if printable, else one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """The merge ranks of a byte-level BPE file, if its ids are ranks: single bytes, then the merges in their order."""
    model = json.loads(Path(path).read_text())["model"]
    letters = _byte_letters()
    vocab = model["vocab"]
    first = len(vocab) - len(model["merges"])
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if model["type"] != "BPE" or model.get("dropout") or any(vocab.get("".join(p)) != first + k for k, p in enumerate(pairs)):
        return None
    try:
        return {bytes(letters[x] for x in token): i for token, i in vocab.items()}
    except KeyError:
        return None


class Tokens:
    """Texts to little-endian 32-bit ids by a tokenizer file.

    Where the file's ids are merge ranks, a faster encoder gives the same ids for texts that hold no
    special token's string; other texts and files go through the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        ranks = ranks_of(path)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


@functools.lru_cache(maxsize=2)
def tokens(path: str, pattern: str) -> Tokens:
    return Tokens(path, pattern)


class Bins:
    """Bins of one group: ``items[b]`` holds sorted (length, piece) pairs, ``fill[b]`` their sum."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []
        free: dict[int, list[int]] = defaultdict(list)  # bins by room
        mask = 0  # bit r: a bin with room r exists
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            n = lengths[i]
            fitting = mask >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                b = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
                self.items[b].append((n, i))
                self.fill[b] += n
            else:
                room, b = capacity, len(self.fill)
                self.items.append([(n, i)])
                self.fill.append(n)
            if room > n:
                free[room - n].append(b)
                mask |= 1 << (room - n)

    def improve(self) -> None:
        """Empties bins by moves and exchanges, each of which raises the sum of squared fills, until no bin can be improved or they are as few as the total needs.

        Bins with room are indexed by it, and pieces of them by size: for each size the most room of a bin
        that holds such a piece. So the best exchange of a bin takes one look at all sizes.
        """
        bound = -(-sum(self.fill) // self.capacity)
        self._index()
        used = sum(1 for f in self.fill if f)
        queue = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: self.fill[b])
        steps = 1
        while used > bound and steps:
            steps, aside = 0, []
            for b in queue:
                if 0 < self.fill[b] < self.capacity:
                    self._set(b, out=True)
                    steps += self._drain(b)
                    if self.fill[b]:
                        aside.append(b)  # it is lighter than those that follow, so none of them may fill it
                    else:
                        used -= 1
                        if used <= bound:
                            break
            for b in aside:
                self._set(b)
            queue = sorted((b for b in queue if 0 < self.fill[b] < self.capacity), key=lambda b: self.fill[b])

    def _index(self) -> None:
        n = self.capacity + 1
        self._by_room: dict[int, set[int]] = defaultdict(set)
        self._rooms = 0  # bit r: an open bin has room r
        self._of_size: list[dict[int, set[int]]] = [defaultdict(set) for _ in range(n)]  # by size of a piece, then room
        self._room_of = np.full(n, -1, dtype=np.int64)  # most room of an open bin with a piece of that size
        for b, f in enumerate(self.fill):
            if 0 < f < self.capacity:
                self._set(b)

    def _set(self, b: int, out: bool = False) -> None:
        """Enters bin ``b`` into the index, or takes it out."""
        room = self.capacity - self.fill[b]
        if out:
            self._by_room[room].discard(b)
            if not self._by_room[room]:
                self._rooms &= ~(1 << room)
        else:
            self._by_room[room].add(b)
            self._rooms |= 1 << room
        for size in {n for n, _ in self.items[b]}:
            rooms = self._of_size[size]
            if out:
                rooms[room].discard(b)
                if not rooms[room]:
                    del rooms[room]
                    if room == self._room_of[size]:
                        self._room_of[size] = max(rooms, default=-1)
            else:
                rooms[room].add(b)
                self._room_of[size] = max(self._room_of[size], room)

    def _drain(self, b: int) -> int:
        """Moves what bin ``b`` holds into fuller bins, by the step that fills one most, while there is any; how many steps."""
        steps = 0
        sizes = np.arange(self.capacity + 1)
        while self.items[b]:
            mine = sorted({n for n, _ in self.items[b]}, reverse=True)
            best, give, take, into = 0, (), None, -1
            for n in mine:  # a move: the largest piece that fits, into the smallest room for it
                fitting = self._rooms >> n
                if fitting:
                    best, give, into = n, (n,), n + (fitting & -fitting).bit_length() - 1
                    break
            reach = sizes + self._room_of  # the largest that may take the place of a piece of each size
            held = self._room_of >= 0
            one = np.array(mine[::-1])
            pairs = self._pairs(b)
            for given in (one, pairs):
                if not len(given):
                    continue
                at = np.searchsorted(given, reach, side="right") - 1
                gain = np.where(held & (at >= 0), given[at] - sizes, 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    n = int(given[at[k]])
                    best, take = int(gain[k]), k
                    give = (n,) if given is one else self._two(b, n)
                    into = self._room_of[k]
            if not best:
                break
            c = next(iter(self._by_room[into] if take is None else self._of_size[take][into]))
            if self.fill[c] + best <= self.fill[b]:  # it must end fuller than this bin was
                break
            steps += 1
            self._set(c, out=True)
            for n in give:
                self._pass(b, c, n)
            if take is not None:
                self._pass(c, b, take)
            self.fill[b] -= best
            self.fill[c] += best
            if self.fill[c] < self.capacity:
                self._set(c)
        return steps

    def _pass(self, b: int, c: int, n: int) -> None:
        k = next(k for k, x in enumerate(self.items[b]) if x[0] == n)
        self.items[c].append(self.items[b].pop(k))

    def _pairs(self, b: int) -> np.ndarray:
        """Sums of any two pieces of a bin, ascending."""
        n = np.sort(np.array([x for x, _ in self.items[b]]))
        first = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        sums = np.zeros(2 * self.capacity + 1, dtype=bool)
        for x in n[first].tolist():
            sums[n[first] + x] |= n[first] != x
        sums[2 * n[1:][n[1:] == n[:-1]]] = True
        return np.flatnonzero(sums)

    def _two(self, b: int, total: int) -> tuple[int, int]:
        """Two pieces of a bin with that sum."""
        seen: set[int] = set()
        for x, _ in self.items[b]:
            if total - x in seen:
                return x, total - x
            seen.add(x)
        raise ValueError(total)


def pack(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each piece; bins are numbered from 0 without gaps."""
    bins = Bins(lengths, capacity)
    bins.improve()
    where, n = [0] * len(lengths), 0
    for items in bins.items:
        if items:
            for _, i in items:
                where[i] = n
            n += 1
    return where


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids followed by id 0; a null text is empty, so it has one id. Documents
    longer than ``capacity`` are cut into pieces of that length, where the first may be shorter. Every
    piece is packed; sequences are gapless. Ties between bins are settled by the order of their making. Null and repeated ids are documents like others. An empty
    table gives an empty result. Other columns are not looked at.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path, pattern)
        for batch in slices(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                at, k = 0, 0
                size = n % capacity or capacity
                while at < n:
                    rows.append((i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k, size = at + size, k + 1, capacity
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        where = np.array(pack(lengths.tolist(), capacity), dtype=np.int64)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        first = np.r_[True, np.diff(where[order]) != 0]
        base = np.maximum.accumulate(np.where(first, begins, 0))
        offset = np.empty_like(begins)
        offset[order] = begins - base
        g = table["part"].to_numpy()
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array((g.astype(np.int64) << 32) | where)).append_column("offset", pa.array(offset))

    spark = docs.sparkSession
    pieces = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES), f"{shared_folder(spark, 'pack')}/pieces")
    parts = max(1, -(-pieces.count() // group))
    spread = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    return spread.groupBy("part").applyInArrow(place, PIECES + ", sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
