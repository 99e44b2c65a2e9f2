"""Substring dedup by recompression.

Words are parsed into symbols in rounds: each round names maximal runs of one symbol, then pairs of
a left and a right symbol, where a symbol's side is drawn from its name. Names are fingerprints of
what they stand for, so every task gives equal runs and pairs equal names without asking. Equal
stretches of words are parsed alike but for a margin whose width is known for each symbol. So a
window that holds a symbol with its margin, where the corpus has that symbol just once, occurs once.
A census of the symbols leaves the windows all of whose symbols are shared; these are verified by
96-bit hashes of their words, and every one but the earliest is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, answer, attach, census, each, ranges, stage, text_bytes
from .shared import back, keep, shared_folder, wide
from .wordscan import _BASE, _INV, Words, _power, mix

ROUNDS = 3
_FAR = 1 << 40
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BASE2 = np.uint64(0xE7037ED1A0B428DB)
_INV2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols, and the words from and to which each one depends on.

    ``words``: hashes; ``doc``: owner of each, ascending. A symbol that depends on where its document
    begins or ends reaches beyond all words.
    """
    name, d = words, doc
    lo = np.arange(len(words))
    hi = lo + 1
    for r in range(rounds):
        m = len(name)
        if not m:
            break
        new = np.ones(m, dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        end = np.r_[first[1:], m]
        length = end - first
        run, rd = name[first], d[first]
        run = np.where(length > 1, mix(run * _A + length.astype(np.uint64)), run)
        before, after = np.maximum(first - 1, 0), np.minimum(end, m - 1)
        rlo = np.where((first > 0) & (d[before] == rd), lo[before], -_FAR)
        rhi = np.where((end < m) & (d[after] == rd), hi[after], _FAR)

        right = (mix(run ^ np.uint64(0x5851F42D4C957F2D * (r + 1) & (2**64 - 1))) & np.uint64(1)).astype(bool)
        same = rd[1:] == rd[:-1]
        pair = np.r_[~right[:-1] & right[1:] & same, False]
        tail = np.r_[False, pair[:-1]]
        nxt = np.minimum(np.arange(len(run)) + 1, len(run) - 1)
        prv = np.maximum(np.arange(len(run)) - 1, 0)
        has_next, has_prev = np.r_[same, False], np.r_[False, same]
        # a left symbol left over depends on its successor, a right one on its predecessor
        lo = np.where(right, np.where(has_prev, rlo[prv], -_FAR), rlo)
        hi = np.where(pair | ~right, np.where(has_next, rhi[nxt], _FAR), rhi)
        name = np.where(pair, mix(run * _A + run[nxt] * _B + np.uint64(r + 1)), run)[~tail]
        d, lo, hi = rd[~tail], lo[~tail], hi[~tail]
    return name, lo, hi


def _hashes(block: Block) -> tuple[Words | None, np.ndarray, np.ndarray]:
    """Word hashes of a block and the offsets of its documents' words."""
    parts, counts = [], []
    for lo in range(0, len(block.texts), 64):
        w = Words(block.texts[lo : lo + 64])
        parts.append(w.hashes())
        counts.append(w.count)
    return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(counts))]


def _symbols(block: Block, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, first = _hashes(block)
    name, lo, hi = parse(h, np.repeat(np.arange(len(first) - 1), np.diff(first)), rounds)
    use = hi - lo <= window
    return name[use], lo[use], hi[use], first


def _starts(first: np.ndarray, window: int) -> np.ndarray:
    """Whether a window starts at each word."""
    n = np.diff(first)
    left = np.repeat(first[1:], n) - np.arange(first[-1])
    return left >= window


def _candidates(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Per block a bit for each word: a window starts here whose symbols are all shared."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for block, row in each(batches):
        name, lo, hi, first = _symbols(block, window, rounds)
        n = int(first[-1])
        codes = answer(row)
        _, at = np.unique(name, return_inverse=True)
        once = codes[at] == 1 if len(name) else np.zeros(0, dtype=bool)
        # windows from hi - window to lo hold the symbol with its margin
        cover = np.zeros(n + 1, dtype=np.int32)
        np.add.at(cover, np.maximum(hi[once] - window, 0), 1)
        np.add.at(cover, lo[once] + 1, -1)
        maybe = (np.cumsum(cover[:n]) == 0) & _starts(first, window)
        if maybe.any():
            yield pa.RecordBatch.from_arrays([pa.array([block.number], pa.int64()), pa.array([zip_.compress(np.packbits(maybe).tobytes())], pa.binary())], names=["block", "maybe"])


class Windows:
    """The candidate windows of a block by hash: ``start`` of the earliest and of the later ones of each."""

    def __init__(self, block: Block, row: dict, window: int):
        h, self.first = _hashes(block)
        n = len(h)
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["maybe"]), dtype=np.uint8), count=n)
        start = np.flatnonzero(bits)
        big = _window_hash(h, start, window, _BASE, _INV)
        low = (_window_hash(h ^ _A, start, window, _BASE2, _INV2) >> np.uint64(32)).astype(np.uint32)
        doc = np.searchsorted(self.first, start, side="right") - 1
        rank = np.empty(len(block.ids), dtype=np.int64)
        rank[np.argsort(block.ids, kind="stable")] = np.arange(len(block.ids))
        order = np.lexsort((start, rank[doc], low, big))
        big, low, start, doc = big[order], low[order], start[order], doc[order]
        head = np.r_[True, (big[1:] != big[:-1]) | (low[1:] != low[:-1])][: len(big)]
        self.again = start[~head]
        self.big, self.low, self.start, self.id = big[head], low[head], start[head], block.ids[doc[head]]


def _window_hash(h: np.ndarray, start: np.ndarray, window: int, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    p = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _power(base, len(h)), out=p[1:])
    return mix((p[start + window] - p[start]) * _power(inverse, len(h))[start])


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_removed, kept_sha256, and kept (string) if ``with_text``.

    Words are runs of characters other than space and 0x09-0x0D. A word is removed if a window of
    ``window`` consecutive words of its document covers it whose words also start earlier: in a document
    of smaller id, or earlier in the same one; windows are judged on the input. kept joins the others by
    one space. Null, empty and white texts have no words, and texts shorter than a window lose none.
    Rows without an id come before all others; rows that repeat an id are ordered among each other as
    they are read. An empty table gives an empty result. Other columns are not looked at. No window is
    left out, however frequent: a block tells the owner of a hash range only its earliest one of each.
    """
    spark = docs.sparkSession
    at = shared_folder(spark, "substring")
    blocks = stage(docs, f"{at}/blocks", id_col, text_col)
    size = text_bytes(blocks)

    def keys(block: Block, _: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_symbols(block, window, rounds)[0], return_counts=True)

    asked = blocks.join(census(blocks, keys, size // 12), "block", "left")
    maybe = keep(asked.mapInArrow(lambda it: _candidates(it, window, rounds), "block long, maybe binary"), f"{at}/maybe")
    open_ = attach(blocks, maybe, "maybe")
    n = wide(spark, size // 2, 24 << 20)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for block, row in each(batches):
            w = Windows(block, row, window)
            if not len(w.big):
                continue
            r = ranges(w.big, n)
            cut = np.flatnonzero(np.diff(r)) + 1
            split = lambda x: np.split(x, cut)
            ids = [zip_.compress(x.tobytes()) for x in split(w.id)]
            parts = [[x.tobytes() for x in split(y)] for y in (w.big, w.low)]
            yield pa.RecordBatch.from_arrays([pa.array(r[np.r_[0, cut]].astype(np.int32)), pa.array([block.number] * len(ids), pa.int64()), *(pa.array(x, pa.binary()) for x in (*parts, ids))], names=["range", "block", "big", "low", "ids"])

    def judge(table: pa.Table) -> pa.Table:
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        bigs = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table["big"]]
        big = np.concatenate(bigs)
        low = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in table["low"]])
        ids = np.concatenate([np.frombuffer(unzip.decompress(x.as_py()), dtype=np.int64) for x in table["ids"]])
        lens = [len(x) for x in bigs]
        block = np.repeat(table["block"].to_numpy(), lens)
        order = np.lexsort((block, ids, low, big))
        b, w = big[order], low[order]
        later = np.zeros(len(big), dtype=np.uint8)
        later[order[1:]] = (b[1:] == b[:-1]) & (w[1:] == w[:-1])
        parts = np.split(later, np.cumsum(lens)[:-1])
        return pa.table({"block": table["block"], "range": table["range"], "codes": pa.array([zip_.compress(x.tobytes()) for x in parts], pa.binary())})

    posted = open_.mapInArrow(post, "range int, block long, big binary, low binary, ids binary")
    judged = posted.groupBy("range").applyInArrow(judge, "block long, range int, codes binary")
    answers = judged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "codes"))).alias("answers"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in each(batches):
            gone = first = None
            if row["maybe"] is not None:
                w = Windows(block, row, window)
                first = w.first
                repeat = np.concatenate([w.again, w.start[answer(row) == 1]])
                cover = np.zeros(int(first[-1]) + 1, dtype=np.int32)
                np.add.at(cover, repeat, 1)
                np.add.at(cover, repeat + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
            total, removed, sha, texts = [], [], [], []
            for k, text in enumerate(block.texts):
                words = text.split()
                total.append(len(words))
                out = gone[first[k] : first[k + 1]] if gone is not None else None
                n_out = int(out.sum()) if out is not None else 0
                removed.append(n_out)
                text = b" ".join(compress(words, (~out).tolist()) if n_out else words)
                sha.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            columns = [pa.array(block.ids), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    verdicts = keep(maybe.join(answers, "block", "left"), f"{at}/verdicts")
    final = blocks.join(verdicts, "block", "left").mapInArrow(cut_out, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return final.select(back("id").alias(id_col), *final.columns[1:])
