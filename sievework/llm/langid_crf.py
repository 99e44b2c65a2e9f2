"""Language ID by a linear-chain conditional random field over words.

A word's emission scores come from its affixes and n-grams (with word boundaries) and from a lexicon
of whole words, all hashed into one table; transitions are learned with them. Training sequences
splice stretches of labelled documents of different languages, so that transitions learn to switch.
Forward-backward gives each word's label distribution, and a document's language is the one that
most of its words are expected to be in.

Forward-backward runs on segments of fixed length at once: each segment's transfer matrices for all
entry states are built in lock step, then chained along documents, which is exact for any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices
from .wordscan import _BASE, _power, mix

#: Documents of each language that are learned from, about, and stretches of their words.
SAMPLE, STRETCHES = 500, 3_000
#: Words of a segment, and segments that are learned from at most.
SEGMENT, SEGMENTS = 64, 6_000
#: Bytes of a word that may be learned from; longer ones are read, but not learned.
WORD_BYTES = 256
BUCKETS = 1 << 16
EPOCHS = 12
#: Bytes of text that are worked on at once.
PART = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_HAS_LETTER = regex.compile(r"\p{L}")


class Grams:
    """Words of lower-case texts (runs of letters) and their features' places in the table."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        starts = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=n) + 1, out=starts[1:])
        inside = np.empty(len(buf) + 1, dtype=bool)
        inside[0] = False
        inside[1:] = _LETTER[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edge[0::2], edge[1::2]
        self.count = np.diff(np.searchsorted(first, starts))
        m = len(first)
        keep = inside[1:].copy()
        keep[end] = True  # one boundary after each word
        c = np.where(_LETTER[buf], buf, 0)[keep].astype(np.uint32)
        length = end - first
        self.at = np.cumsum(length + 1) - (length + 1)
        place = np.arange(len(c)) - np.repeat(self.at, length + 1)
        one = np.r_[np.uint32(0), c[:-1]] if m else c
        two = np.r_[np.uint32(0), one[:-1]] if m else c
        three = np.r_[np.uint32(0), two[:-1]] if m else c
        g2 = one << np.uint32(8) | c
        g3 = two << np.uint32(16) | g2
        g4 = three << np.uint32(24) | g3
        table = np.uint32(BUCKETS - 1)
        slot = lambda g, k: ((g * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(13) ^ g) % table + np.uint32(1)
        self.slots = [slot(g2, 1), np.where(place >= 1, slot(g3, 0x5BD1E995), 0), np.where(place >= 2, slot(g4, 0x27D4EB2F), 0)]
        # the lexicon's places are hashes of whole words, of any length
        per_byte = (c.astype(np.uint64) + np.uint64(1)) * _power(_BASE, int(length.max()) + 1)[place] if m else c
        word = np.add.reduceat(per_byte, self.at) if m else np.zeros(0, dtype=np.uint64)
        self.lexicon = (mix(word) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        self.first = np.r_[0, np.cumsum(self.count)]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Scores (words, labels)."""
        if not len(self.at):
            return np.zeros((0, weights.shape[1]), dtype=np.float32)
        e = weights[self.slots[0]]
        e += weights[self.slots[1]]
        e += weights[self.slots[2]]
        return np.add.reduceat(e, self.at, axis=0) + weights[self.lexicon]

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """Sums of (words, labels) by place in the table."""
        per_gram = np.repeat(np.arange(len(self.at)), np.diff(np.r_[self.at, len(self.slots[0])]))
        out = np.zeros((BUCKETS, g.shape[1]))
        for j in range(g.shape[1]):
            w = g[per_gram, j]
            for s in self.slots:
                out[:, j] += np.bincount(s, w, minlength=BUCKETS)
            out[:, j] += np.bincount(self.lexicon, g[:, j], minlength=BUCKETS)
        out[0] = 0
        return out


def _segments(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of each segment of documents with so many words."""
    n = -(-count // SEGMENT)
    doc = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(count) - count)[doc] + k * SEGMENT
    return first, np.minimum(count[doc] - k * SEGMENT, SEGMENT), doc


def forward_backward(e: np.ndarray, count: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label distribution of each word, for documents of ``count`` words in a row with scores ``e``; with ``pairs`` also the expected number of each transition."""
    m, labels = e.shape
    if not m:
        return e, np.zeros((labels, labels)) if pairs else None
    a = np.exp(trans - trans.max()).astype(np.float32)
    p = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    p = np.maximum(p, 1e-12)
    first, length, doc = _segments(count)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(SEGMENT), side="left")  # segments longer than t
    start = first[order]
    ahead = np.empty((m, labels, labels), dtype=np.float32)
    back = np.empty((m, labels, labels), dtype=np.float32)
    f = None
    for t in range(int(length.max())):
        k = active[t]
        i = start[:k] + t
        f = (a if f is None else f[:k] @ a) * p[i][:, None, :]
        f = f / f.max(axis=(1, 2), keepdims=True)
        ahead[i] = f
    b = np.broadcast_to(np.eye(labels, dtype=np.float32), (len(start), labels, labels)).copy()
    for t in range(int(length.max()) - 1, -1, -1):
        k = active[t]
        i = start[:k] + t
        back[i] = b[:k]
        step = a @ (p[i][:, :, None] * b[:k])
        b[:k] = step / step.max(axis=(1, 2), keepdims=True)
    # chain the segments of each document
    into = np.full((len(first), labels), 1.0 / labels, dtype=np.float32)
    out_of = np.ones((len(first), labels), dtype=np.float32)
    whole = ahead[first + length - 1]
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.diff(np.r_[heads, len(doc)])
    for k in range(1, int(n.max())):
        g = heads[n > k] + k
        v = np.einsum("gi,gij->gj", into[g - 1], whole[g - 1])
        into[g] = v / v.sum(axis=1, keepdims=True)
        g = (heads + n)[n > k] - k
        v = np.einsum("gij,gj->gi", whole[g], out_of[g])
        out_of[g - 1] = v / v.sum(axis=1, keepdims=True)
    of = np.repeat(np.arange(len(first)), length)
    alpha = np.einsum("mi,mij->mj", into[of], ahead)
    beta = np.einsum("mij,mj->mi", back, out_of[of])
    q = alpha * beta
    q /= q.sum(axis=1, keepdims=True)
    if not pairs:
        return q, None
    inner = np.flatnonzero(np.repeat(np.arange(len(count)), count)[1:] == np.repeat(np.arange(len(count)), count)[:-1])
    x = alpha[inner][:, :, None] * a * (p[inner + 1] * beta[inner + 1])[:, None, :]
    x /= x.sum(axis=(1, 2), keepdims=True)
    return q, x.sum(axis=0)


class Crf:
    """Labels, the feature table and the transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans

    def words(self, text: str) -> list[tuple[str, str]]:
        """Each word of a text with its likeliest language."""
        low = text.lower().encode()
        g = Grams([low])
        q, _ = forward_backward(g.emissions(self.weights), g.count, self.trans)
        found = regex.findall(rb"[a-z\x80-\xff]+", low)
        return [(w.decode(errors="replace"), self.labels[k]) for w, k in zip(found, q.argmax(axis=1), strict=True)]

    def documents(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and share of words expected in it, for each text."""
        pred, score = [], []
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < PART):
                low = texts[at].lower().encode()
                part.append(low)
                size += len(low)
                at += 1
            g = Grams(part)
            q, _ = forward_backward(g.emissions(self.weights), g.count, self.trans)
            total = np.zeros((len(part) + 1, len(self.labels)))
            np.cumsum(np.add.reduceat(np.vstack([q, np.zeros((1, q.shape[1]))]), np.minimum(g.first[:-1], len(q)), axis=0) * (g.count > 0)[:, None], axis=0, out=total[1:])
            share = np.diff(total, axis=0) / np.maximum(g.count, 1)[:, None]
            best = share.argmax(axis=1)
            for k, (c, b) in enumerate(zip(g.count.tolist(), best.tolist(), strict=True)):
                if c and _HAS_LETTER.search(texts[at - len(part) + k]):
                    pred.append(self.labels[b])
                    score.append(float(min(1.0, max(0.0, share[k, b]))))
                else:
                    pred.append("und")
                    score.append(0.0)
        return pred, score


def stretches(text: str, seed: int) -> list[bytes]:
    """A whole text's words in stretches of 4 to SEGMENT words."""
    rng = np.random.default_rng(seed)
    words = [w for w in regex.findall(rb"[a-z\x80-\xff]+", text.lower().encode()) if len(w) <= WORD_BYTES]
    ends = np.cumsum(rng.integers(4, SEGMENT + 1, size=len(words) // 4 + 1)).tolist()
    return [b" ".join(words[a:b]) for a, b in zip([0, *ends], ends, strict=False) if a < len(words)]


def train(found: list[bytes], langs: list[str], seed: int = 7) -> Crf | None:
    """Fits by stochastic gradient on sequences spliced from stretches of words; None without any."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    number = {x: k for k, x in enumerate(labels)}
    pieces = [(t, number[x]) for t, x in zip(found, langs, strict=True)]
    if not pieces:
        return None
    share = np.bincount([k for _, k in pieces], minlength=len(labels))
    odds = np.array([1.0 / max(1, share[k]) for _, k in pieces])
    odds /= odds.sum()
    pick = rng.choice(len(pieces), size=min(SEGMENTS, 4 * len(pieces)), p=odds)
    weights = np.zeros((BUCKETS, len(labels)), dtype=np.float32)
    trans = np.zeros((len(labels), len(labels)))
    seen_w, seen_t = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2)
    for epoch in range(EPOCHS):
        rng.shuffle(pick)
        for batch in np.array_split(pick, max(1, len(pick) // 1000)):
            sequences, truth = [], []
            # two or three stretches make a sequence
            for s in np.split(batch, range(3, len(batch), 3)):
                sequences.append(b" ".join(pieces[i][0] for i in s))
                truth += [np.full(pieces[i][0].count(b" ") + 1, pieces[i][1]) for i in s]
            g = Grams(sequences)
            y = np.concatenate(truth)
            q, x = forward_backward(g.emissions(weights), g.count, trans, pairs=True)
            d = -q.astype(np.float64)
            d[np.arange(len(y)), y] += 1
            dw = g.gradient(d) / len(sequences) - 1e-4 * weights
            doc = np.repeat(np.arange(len(g.count)), g.count)
            inner = doc[1:] == doc[:-1]
            real = np.zeros_like(trans)
            np.add.at(real, (y[:-1][inner], y[1:][inner]), 1)
            dt = (real - x) / len(sequences)
            seen_w += (dw**2).astype(np.float32)
            seen_t += dt**2
            weights += (0.3 * dw / np.sqrt(seen_w)).astype(np.float32)
            trans += 0.1 * dt / np.sqrt(seen_t)
    weights[0] = 0
    return Crf(labels, weights, trans)


def is_held_out(id_col: str, fold: int = 2, folds: int = 4) -> Column:
    """Rows that nothing is learned from: a remainder of the id's CRC, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Crf | None:
    """Trains on about ``sample`` rows of each language, chosen by a hash of the id, that are not held out."""
    usable = docs.filter(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}  # one row per language
    if not counts:
        return None
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1 << 20, -(-sample * (1 << 20) // n))))))
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20))
    chosen = usable.filter(h < share[F.col(lang_col)]).select(F.coalesce(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(0)).alias("h"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for h, x, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if got := stretches(t, h & 0xFFFFFFFF):
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(got)), pa.array(range(len(got)), pa.int64()), pa.array([x] * len(got)), pa.array(got, pa.binary())], names=["h", "k", "l", "words"])

    # texts stay where they are; stretches of bounded length reach the driver, STRETCHES of a language
    order = Window.partitionBy("l").orderBy(F.xxhash64("h", "k"), "words")
    picked = chosen.mapInArrow(run, "h long, k long, l string, words binary").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= STRETCHES)
    rows = sorted((r.l, r.n, bytes(r.words)) for r in picked.collect())
    return train([w for _, _, w in rows], [x for x, _, _ in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, model: Crf | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "held_out")) -> DataFrame:
    """``docs`` with lang_pred, score and held_out added, under ``names``; they replace columns of these names.

    lang_pred is a value of ``lang_col`` that was learned, ``und`` (score 0) for a text that is null or
    has no letter, or if nothing could be learned. Learned are the rows of at most ``sample`` ids or so of
    each language that are not held out; ids, languages and other columns are never inputs of a
    prediction. Of languages with equal shares the first in order counts. All rows stay, null and repeated
    ids too, and an empty table gives an empty result. Whole texts are read, however long.
    """
    model = model or fit(docs, id_col, text_col, lang_col, sample)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in [n.lower() for n in names] and c not in (id_col, text_col)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    at = docs.columns.index(text_col)
    schema = docs.withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            pred, score = crf.documents(texts) if crf else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names[:2]])

    return docs.mapInArrow(run, schema).withColumn(names[2], is_held_out(id_col))
