"""Trees and threshold that find personal data are learned from every document."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import boosting, pii_boost
from sievework.llm.shared import made


def prose(rng, n=25):
    return " ".join(rng.choice(["the", "river", "ran", "(234) 555-0199", "at", "noon", "17 4 2", "a at b.c", "order 5551234567", "left."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(k, prose(rng)) for k in range(2000)], "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def every(docs):
    """Examples of each document by itself: features, labels, own, held out."""
    rows = docs.select(F.xxhash64("doc_id").alias("h"), "text").collect()
    got = [(*pii_boost.examples(r.text, r.h), r.h) for r in rows]
    held = np.concatenate([np.full(len(g[1]), (g[3] >> 24) % 4 == 0) for g in got])
    return np.concatenate([g[0] for g in got], axis=1).T, np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]), held


def same(a, b):
    return len(a.trees) == len(b.trees) and a.base == b.base and all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees) for x, y in zip(s, t))


def test_every_document_is_learned_from(docs, every):
    begun = made()
    model = pii_boost.fit(docs)
    whole = pii_boost.train(*every)
    assert same(model.trees, whole.trees) and model.threshold == whole.threshold < 1
    assert made() == begun  # what was written is removed
    assert same(pii_boost.fit(docs.repartition(7)).trees, whole.trees)


def test_trees_are_the_same_where_rows_stay_spread(spark, docs, every, monkeypatch):
    x, y, _, held = every
    near = boosting.Boosted(rounds=3, depth=4).fit(x[~held], y[~held])
    monkeypatch.setattr(boosting, "ADVANCE", 2)
    monkeypatch.setattr(boosting, "ARRAYS", 1)
    monkeypatch.setattr(boosting.Boosted, "__init__", lambda self, depth, of=boosting.Boosted.__init__: of(self, rounds=3, depth=depth))
    model = pii_boost.fit(docs, near_rows=0)
    assert same(model.trees, near)
    assert model.threshold == pii_boost.threshold(near.score(x[held]), y[held], every[2][held])


def test_batches_give_what_single_documents_give():
    rng = random.Random(4)
    texts = ["", "x", "1 " * 40, "call +1 (234) 555-0199", *(prose(rng) for _ in range(60))]
    got = list(pii_boost.examples_of(texts, list(range(len(texts)))))
    rows = sorted((int(i), *x.tolist(), bool(y), bool(o)) for g in got for i, x, y, o in zip(g[3], g[0].T, g[1], g[2]))
    alone = [(k, pii_boost.examples(t, k)) for k, t in enumerate(texts)]
    assert rows == sorted((k, *x.tolist(), bool(y), bool(o)) for k, g in alone for x, y, o in zip(g[0].T, g[1], g[2]))


def test_sums_are_the_rows_sums():
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, n, 3000) for n in (2, 3, 40, 500, 5_000_000_000, 1)]).astype(np.float32)
    y = rng.random(3000) < 0.3
    code = boosting.codes(x)
    bins = boosting.Bins(boosting.counts(code))
    assert max(len(e) for e in bins.edges) < boosting.BINS
    x, y = np.concatenate([x, x[:, :700]], axis=1), np.concatenate([y, y[:700]])  # equal rows are one
    code = boosting.codes(x)
    (block,) = boosting.Block.of(code, y, bins, -5000)
    assert len(block.y) <= 3000 and block.size.sum() == 3700
    block = boosting.Block.unpacked(block.packed(), len(block.y), 6, len(bins.groups))
    feature, at = np.array([2, 3, 0]), np.array([3, 7, 0], dtype=np.uint8)
    b = bins.of(code)
    node = np.where(b[2] > 3, 2 + (b[0] > 0), b[3] > 7)
    q = 1 / (1 + np.exp(5000 / boosting.STEP))
    for k, w in enumerate((np.rint((q - y) * boosting.GRADIENT), np.full(3700, np.rint(q * (1 - q) * boosting.GRADIENT)))):
        got = block.sums(bins, feature, at, 2)[k]
        for n in range(4):
            assert got[n, 6, 0] == w[node == n].sum()
            for j in range(5):
                assert np.array_equal(got[n, j], np.bincount(b[j][node == n], w[node == n], minlength=boosting.BINS))


def test_threshold_by_counts():
    rng = np.random.default_rng(2)
    p = rng.integers(40, 101, 4000) / 100
    y, own = rng.random(4000) < p**0.1, rng.random(4000) < 0.02
    one = np.unique(p)
    by = [np.array([w[p == v].sum() for v in one]) for w in (y, own, np.ones(4000))]
    for precision in (0.9, 0.95, 0.97, 0.99):
        for most in (0.1, 0.5, 1.0):
            assert pii_boost.threshold(p, y, own, None, precision, most) == pii_boost.threshold(one, *by, precision, most)
