"""Documents in compressed blocks, and counts of keys over all blocks.

A key occurs in the corpus once or more often: that alone decides most questions about repeats.
Instead of a row per key, each block sends one array of 32-bit key remainders per key range, and the
range's owner answers with one byte per key, in the order in which they came. A block holds a few MB
of text, so both arrays are long, and a key that every document has reaches its owner once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, release, row_id, slices, wide

#: Bytes of text in a block. A larger corpus should have larger blocks: fewer, longer arrays.
BLOCK_BYTES = 3 << 20
#: A document's place in its block takes so many bits of its uid.
PLACE_BITS = 20
#: Bytes of keys that the owner of a range sorts.
RANGE_BYTES = 24 << 20
BLOCKS = "block long, ids binary, sizes binary, body binary"


class Block:
    """One staged block: ``ids`` and whole texts as bytes."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(sizes.sum())))
        ends = np.cumsum(sizes).tolist()
        self.texts = [body[b - n : b] for b, n in zip(ends, sizes.tolist(), strict=True)]

    def uid(self, place: int) -> int:
        return self.number << PLACE_BITS | place


def stage(docs: DataFrame, path: str, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes all rows of ``docs`` as blocks; a null text is empty, a null id NULL_ID. A longer document has a block of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId() << 20
        ids: list[int] = []
        texts: list[bytes] = []
        size = made = 0

        def block() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            row = {"block": part | made, "ids": np.array(ids, dtype=np.int64).tobytes(), "sizes": sizes.tobytes(), "body": zip_.compress(b"".join(texts))}
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())]))

        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = t.as_py() or b""
                if texts and (size + len(b) > block_bytes or len(texts) >= 1 << PLACE_BITS - 1):
                    yield block()
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(b)
                size += len(b)
        if texts:
            yield block()

    rows = docs.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return keep(rows.mapInArrow(pack, BLOCKS), path, compression="none")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    """The blocks of a task one by one, with the row's other columns."""
    try:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                yield Block(row), row
    finally:
        release()


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Range of each hash by its upper half; ascending as the hashes are."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)



def code(total: np.ndarray) -> np.ndarray:
    """A count as one byte: itself up to 127, then in steps of a quarter of a power of two."""
    large = 128 + np.floor(4 * np.log2(np.maximum(total, 128) / 128))
    return np.where(total < 128, total, np.minimum(large, 255)).astype(np.uint8)


def census(blocks: DataFrame, keys: Callable[[Block, dict], tuple[np.ndarray, np.ndarray]], entries: int, at_least: int = 1) -> DataFrame:
    """(block, answers): for each block the codes of its keys' counts in the whole corpus.

    ``keys`` gives a block's different keys (uint64, ascending) and how often each counts there.
    ``entries``: about how many keys all blocks have. A count is never too small; it is too large
    where two keys share a range and the lower 32 bits, which callers must allow for.
    """
    spark = blocks.sparkSession
    n = min(wide(spark, entries * 4, RANGE_BYTES), 1 << 20)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in each(batches):
            u, c = keys(block, row)
            if not len(u):
                continue
            r = ranges(u, n)
            cut = np.flatnonzero(np.diff(r)) + 1
            firsts = np.r_[0, cut]
            low = np.split((u & np.uint64(0xFFFFFFFF)).astype(np.uint32), cut)
            many = np.split(np.minimum(c, 65535).astype(np.uint16), cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[firsts].astype(np.int32)), pa.array([block.number] * len(low), pa.int64()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() if x.max() > 1 else b"" for x in many], pa.binary())],
                names=["range", "block", "low", "many"],
            )

    def count(table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table["low"]]
        many = [np.frombuffer(m, dtype=np.uint16) if (m := x.as_py()) else np.ones(len(y), dtype=np.uint16) for x, y in zip(table["many"], lows, strict=True)]
        every = np.concatenate(lows)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        total = np.add.reduceat(np.concatenate(many)[order].astype(np.int64), start)
        codes = np.empty(len(every), dtype=np.uint8)
        codes[order] = np.repeat(code(total), np.diff(np.r_[start, len(every)]))
        zip_ = zstandard.ZstdCompressor(level=1)
        parts = np.split(codes, np.cumsum([len(x) for x in lows])[:-1])
        return pa.table({"block": table["block"], "range": table["range"], "codes": pa.array([zip_.compress(x.tobytes()) for x in parts], pa.binary())})

    posted = blocks.mapInArrow(post, "range int, block long, low binary, many binary")
    counted = posted.groupBy("range").applyInArrow(count, "block long, range int, codes binary")
    return counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "codes"))).alias("answers"))


def answer(row: dict) -> np.ndarray:
    """The codes of a block's keys, in their ascending order."""
    unzip = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(unzip.decompress(a["codes"]) for a in row["answers"] or []), dtype=np.uint8)


def text_bytes(blocks: DataFrame) -> int:
    """Bytes of all texts."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x.as_py(), dtype=np.int64).sum()) for x in batch.column(0)], pa.int64())], names=["n"])

    return blocks.select("sizes").mapInArrow(total, "n long").agg(F.sum("n")).first()[0] or 0


def attach(blocks: DataFrame, table: DataFrame, column: str, limit: int = 32 << 20) -> DataFrame:
    """``blocks`` joined to a written ``table`` by block: by broadcast if ``column`` has at most ``limit`` bytes in all, else by shuffle."""
    size = table.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return blocks.join(F.broadcast(table) if size <= limit else table, "block")
