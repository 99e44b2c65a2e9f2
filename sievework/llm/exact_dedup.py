"""Exact dedup by an extendible-hash index on shared files.

The index maps a 64-bit hash of the text to a chain of different texts. Its directory is addressed by the
hash's leading bits and doubles until no bucket holds more keys than its capacity, so a bucket is a range of
keys. Each has one owner task, which takes the range in key order, chains texts that share a key, compares
their bytes and writes the bucket's file: for each chained text its hash, the id that stays and the size of
its group.

Only keys that two rows share are ever resolved: a first pass writes hashes alone, a second sends just the
texts of shared keys, one per map task and text, to their owners. So a text that a third of all rows hold
reaches its owner once per map task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, back, join_skewed, keep, row_id, semi_skewed, shared_folder, slices, wide

#: Keys that a bucket holds before it is split.
CAPACITY = 250_000
#: Directories may not double beyond 2^20 entries; buckets then hold more keys, which costs their owners time only.
MAX_DEPTH = 20
#: Bytes of different texts that a map task gathers before it passes them on.
GATHER_BYTES = 32 << 20


def directory(counts: dict[int, int], depth: int, capacity: int) -> list[int]:
    """Bucket of each of the 2^g prefixes after splitting overfull buckets.

    ``counts``: keys by their leading ``depth`` bits. A bucket of local depth d owns the prefixes
    that share its d leading bits; the directory doubles when a bucket whose local depth equals
    the global depth g is split. Buckets are numbered in key order.
    """
    total = [0] * (2 << depth)
    for prefix, n in counts.items():
        total[(1 << depth) + prefix] = n
    for node in range((1 << depth) - 1, 0, -1):
        total[node] = total[2 * node] + total[2 * node + 1]
    leaves, todo, g = [], [(1, 0)], 0
    while todo:
        node, d = todo.pop()
        if total[node] > capacity and d < depth:
            g = max(g, d + 1)
            todo += [(2 * node + 1, d + 1), (2 * node, d + 1)]
        else:
            leaves.append(d)
    return [bucket for bucket, d in enumerate(leaves) for _ in range(1 << (g - d))]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, text) to one row per text of the task: key, largest id, rows, text."""

    def flush() -> pa.RecordBatch:
        rows = [(k, m, n, t) for k, chain in held.items() for t, (m, n) in chain.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, type=y) for x, y in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "last", "n", "body"])

    held: dict[int, dict[bytes, tuple[int, int]]] = {}
    size = 0
    for batch in slices(batches):
        for k, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            chain = held.setdefault(k, {})
            if t in chain:
                m, n = chain[t]
                chain[t] = (max(m, i), n + 1)
            else:
                chain[t] = (i, 1)
                size += len(t) + 200
        if size > GATHER_BYTES:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in key order to one row per different text: key, sha, keep_id, group_size. Holds the chain of one key."""
    names = ["key", "text_sha256", "keep_id", "group_size"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    key, chain, out = None, [], []

    def close() -> None:
        out.extend((key, hashlib.sha256(t).hexdigest(), m, n) for t, m, n in chain)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for k, m, n, t in zip(*(batch.column(c).to_pylist() for c in ("key", "last", "n", "body")), strict=True):
            if k != key:
                close()
                key, chain = k, []
            for link in chain:
                if link[0] == t:
                    link[1:] = [max(link[1], m), link[2] + n]
                    break
            else:
                chain.append([t, m, n])
        if len(out) > 10_000:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, capacity: int = CAPACITY, key_bits: int = 64, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are (after ``normalise``, a column over ``text_col``, if given).
    Of equal texts the row with the largest id stays. A null text counts as empty. Rows without an id
    count as smaller than all others; if only such rows hold a text, all of them share keep_id null and
    ``kept`` is true for each. Rows that repeat an id are rows of their own in group_size, and all of
    them are kept or none. An empty table gives an empty result. Other columns are not looked at.
    Up to ``broadcast_rows`` shared keys go to all tasks; of more, only those that many rows have, and the
    rest of the texts meets theirs by a shuffle. ``key_bits`` shortens the hash; tests use it to make keys collide.
    """
    spark = docs.sparkSession
    at = shared_folder(spark, "exact")
    body = F.coalesce(normalise if normalise is not None else F.col(text_col), F.lit("")).cast("string")
    key = F.xxhash64(body)
    key = key if key_bits == 64 else F.shiftrightunsigned(key, 64 - key_bits)
    rows = keep(docs.select(row_id(id_col).alias("id"), key.alias("key"), F.sha2(body.cast("binary"), 256).alias("text_sha256")), f"{at}/rows")
    shared = keep(rows.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), f"{at}/keys")
    n_keys, total = shared.count(), rows.count()

    # every task of the session owns a bucket at least
    capacity = max(1, min(capacity, n_keys // wide(spark, 1, 1)))
    depth = min(MAX_DEPTH, key_bits, (n_keys // capacity).bit_length() + 4) if n_keys > capacity else 0
    lead = lambda d: F.shiftrightunsigned("key", key_bits - d).cast("int") if d else F.lit(0)
    counts = {r.lead: r.n for r in shared.groupBy(lead(depth).alias("lead")).agg(F.count("*").alias("n")).collect()}  # 2^MAX_DEPTH rows at most
    buckets = directory(counts, depth, capacity)
    prefixes = spark.createDataFrame(list(enumerate(buckets)), "entry int, bucket int")  # the directory: 2^MAX_DEPTH rows at most

    texts = docs.select(row_id(id_col).alias("id"), key.alias("key"), body.cast("binary").alias("body"))
    posted = semi_skewed(texts, shared, "key", "rows", total, broadcast_rows).select("key", "id", "body").mapInArrow(_gather, "key long, last long, n long, body binary")
    placed = posted.withColumn("entry", lead(len(buckets).bit_length() - 1)).join(F.broadcast(prefixes), "entry")
    owned = placed.repartitionById(buckets[-1] + 1, F.col("bucket")).sortWithinPartitions("key")
    classes = keep(owned.select("key", "last", "n", "body").mapInArrow(_own, "key long, text_sha256 string, keep_id long, group_size long").filter("group_size > 1"), f"{at}/index")

    joined = join_skewed(rows, classes, ["key", "text_sha256"], "group_size", total)
    keep_id = F.coalesce("keep_id", "id")
    out = joined.select("id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("id") == keep_id).alias("kept"), "text_sha256")
    return out.select(back("id").alias(id_col), back("keep_id").alias("keep_id"), "group_size", "kept", "text_sha256")
