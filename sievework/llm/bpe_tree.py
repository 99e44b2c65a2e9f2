"""Byte-level BPE by monoid tree reduction.

The encoding of a byte string is reduced from a tree over its halves. Leaves are encoded by
merging the adjacent pair of lowest rank. Two encodings are joined by re-encoding a window of
tokens around their boundary, which doubles until the tokens at its edges are compatible with
their outer neighbours. Two tokens are compatible if their joined bytes encode to just these two;
a sequence all of whose neighbours are compatible is the encoding of its bytes, so tokens outside
the window can't change any more. Decoding is one flat join of the tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: White space as the tokenizer's pattern has it (Unicode's property of that name).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Bytes that are encoded without a further split.
LEAF = 24
#: Chunks that a task remembers.
MEMO = 250_000
SCHEMA = "row_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def pattern_of(text: str) -> regex.Pattern:
    """A tokenizer's splitting pattern, with white space spelt out (libraries differ in control characters)."""
    return regex.compile(text.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"), regex.V0)


class Memo(dict):
    """What ``made`` gives for a string, remembered for the last MEMO to 2 MEMO of them."""

    def __init__(self, made, limit: int = MEMO):
        super().__init__()
        self.made, self.limit, self.older = made, limit, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_NONE = 1 << 40


def _pairs(ranks: dict[bytes, int], shift: int) -> dict[int, int]:
    """The token that two tokens' bytes make, by both ids in one number."""
    return {ranks[t[:i]] << shift | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


class Tree:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.shift = max(ranks.values()).bit_length()
        self.pair_rank = _pairs(ranks, self.shift).get
        self._fits: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Repeatedly merges the leftmost adjacent pair of lowest rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pair_rank, shift = self.pair_rank, self.shift
        parts = [self.byte_id[x] for x in piece]
        # ranks[i]: rank of parts[i] joined with parts[i + 1], which is the joined token's id
        ranks = [pair_rank(x << shift | y, _NONE) for x, y in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = best
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pair_rank(best << shift | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = pair_rank(parts[i - 1] << shift | best, _NONE)
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b may stand side by side."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            got = self._fits[a, b] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded halves."""
        if not left or not right:
            return left + right
        if self.fits(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            width *= 2
            i, j = max(0, len(left) - width), min(len(right), width)
            body = b"".join([self.bytes_of[t] for t in left[i:]] + [self.bytes_of[t] for t in right[:j]])
            window = self.leaf(body)
            if (i == 0 or self.fits(left[i - 1], window[0])) and (j == len(right) or self.fits(window[-1], right[j])):
                return left[:i] + window + right[j:]

    def encode(self, piece: bytes) -> list[int]:
        """Reduces the leaves of ``piece`` level by level."""
        if len(piece) <= LEAF:
            return self.leaf(piece)
        level = [self.leaf(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Other(Exception):
    """A text that can't be cut at its spaces."""


class Splitter:
    """Cuts a text into chunks that are encoded separately, and gives what ``made`` makes of each.

    No match of the pattern crosses a single space between two characters that are not white space:
    such a space begins a match. So a text is cut there first, which needs no pattern; texts with
    other white space next to a space are cut by the pattern as a whole.
    """

    def __init__(self, pattern: regex.Pattern, made, joined, limit: int = MEMO):
        self.pattern, self.made, self.joined = pattern, made, joined
        self.piece = Memo(made, limit)
        self.chunk = Memo(self._chunk, limit)

    def _chunk(self, chunk: str):
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Other
        parts = self.pattern.findall(" " + chunk)
        return self.piece[parts[0]] if len(parts) == 1 else self.joined([self.piece[p] for p in parts])

    def __call__(self, text: str) -> list:
        """What is made of the parts of ``text``, in order."""
        chunks = text.split(" ")
        head = chunks.pop(0)
        try:
            if head and (head[0].isspace() or head[-1].isspace()) or not head and chunks:
                raise _Other
            return [self.piece[p] for p in self.pattern.findall(head)] + list(map(self.chunk.__getitem__, chunks))
        except _Other:
            return list(map(self.piece.__getitem__, self.pattern.findall(text)))


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Texts to ids and back."""

    def __init__(self, path: str, pattern: str):
        self.tree = Tree(load_ranks(path))
        made = lambda s: tuple(self.tree.encode(s.encode()))
        self.split = Splitter(pattern_of(pattern), made, lambda parts: tuple(x for p in parts for x in p))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        return self.tree.decode(ids)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256, decoded_sha256, and ids (array of int) if ``with_ids``.

    A null text counts as empty: no tokens, hashes of the empty string. Null and repeated ids stay as
    they are. Texts of any length are encoded whole; special tokens' strings are ordinary text. One
    narrow pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        words = list(map(str, range(max(c.tree.bytes_of) + 1)))
        for batch in slices(batches):
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["row_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("row_id", id_col)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary) of the bytes of ``ids_col``; null ids give null. Raises on unknown ids."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        tree = Tree(load_ranks(path))
        return pa.array([None if x is None else tree.decode(x) for x in ids.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", decoded(F.col(ids_col)))
