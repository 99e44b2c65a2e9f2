"""Encoding, packing, PII, extraction, classifiers and search against references and brute force."""

import base64
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievework.llm import html_mincut, langid_crf, pii_boost, quality_rff, topk_cover
from sievework.llm.bpe_tree import Tree, decode_documents, encode_documents, load_ranks
from sievework.llm.packing import pack, pack_documents

TIK, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "  a  b ", "it's 12,345 words.\nNew  line\t\ttab", "é日本語 <|endoftext|> x", "a" * 3000, "\n\n \n", "x y\x1cz", "The thing. " * 900, "0" * 700, "!?" * 500]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k if k != 3 else None, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, ids string, piece int")


def test_bpe_round_trip(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIK, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = decode_documents(encode_documents(docs(spark), TIK, PATTERN, with_ids=True), TIK).collect()
    assert len(rows) == len(TEXTS)
    assert sorted((list(r.ids), bytes(r.decoded)) for r in rows) == sorted((enc.encode_ordinary(t or ""), (t or "").encode()) for t in TEXTS)
    assert encode_documents(docs(spark, []), TIK, PATTERN).count() == 0


def test_tree_joins_are_exact():
    tree = Tree(load_ranks(TIK))
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("abehinorst e") for _ in range(rng.randrange(1, 90))).encode()
        k = rng.randrange(len(s) + 1)
        assert tree.join(tree.leaf(s[:k]) if k else [], tree.leaf(s[k:]) if s[k:] else []) == tree.leaf(s) == tree.encode(s)


def test_packing(spark):
    tk = Tokenizer.from_file(JSON)
    rows = [r for r in pack_documents(docs(spark), JSON, PATTERN, capacity=64, group=20).collect()]
    ids = {k if k != 3 else None: np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for k, t in enumerate(TEXTS)}
    for i, want in ids.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(mine):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            assert r.length == 64 or k == 0
            at += r.length
        assert at == len(want)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert pack_documents(docs(spark, []), JSON, PATTERN).count() == 0


def test_local_search_empties_bins():
    # best fit leaves three bins, exchanges reach the bound of two
    lengths = [6, 5, 5, 4, 4, 4, 2]
    where = pack(lengths, 15)
    fills = [sum(n for n, b in zip(lengths, where) if b == k) for k in set(where)]
    assert sum(lengths) == 30 and max(fills) <= 15 and len(fills) == 2


def test_pii_base_spans():
    t = "a.b@c.de, x@y ip 1.2.3.4, 999.1.1.1, card 4111 1111-1111 1111, +1 (234) 555-0199. No 4111111111111112, +12 3"
    got = [(pii_boost.KINDS[k], t[s:e]) for s, k, e in pii_boost.base_spans(t)]
    assert got == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (234) 555-0199")]


def test_pii_table(spark):
    d = docs(spark, [*TEXTS, *(f"word call +1 (234) 555-{k:04d} or mail u{k}@ex.org. Plain text {k}" for k in range(200))])
    rows = pii_boost.find_pii(d).collect()
    assert len(rows) == len(TEXTS) + 200 and sum(r.n_phone for r in rows) == 200 and sum(r.n_email for r in rows) == 200
    assert all(r.spans.count(":") >= 2 * (r.n_email + r.n_ip + r.n_card + r.n_phone) for r in rows)
    clean = pii_boost.redact_pii(d)
    assert clean.columns == d.columns and clean.filter("text like '%@ex.org%'").count() == 0 and clean.count() == d.count()
    assert pii_boost.find_pii(docs(spark, [])).count() == 0


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(rng.randint(0, 12))]
        cost = lambda l: -sum(o for o, x in zip(odds, l) if x) + sum(w for i, j, w in edges if l[i] != l[j])  # noqa: B023, E731, E741
        assert abs(cost(html_mincut.min_cut(odds, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; tail</h1><p>One  long\nparagraph, with words. <b>Bold</b> it is.<p>Another paragraph of text, for good measure.</article><div class='comments'><p>I like this article, thanks.</div><footer>&copy; me</footer></body>"
    d = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", "<p", "x")], "page_id long, url string, html string, text string")
    rows = html_mincut.extract_pages(d).collect()
    assert sorted(r.text for r in rows) == ["", "", "", "Head & tail\n\nOne long paragraph, with words. Bold it is.\n\nAnother paragraph of text, for good measure."]
    assert html_mincut.extract_pages(d.limit(0)).count() == 0


def test_forward_backward_and_languages(spark):
    rng = np.random.default_rng(0)
    e, count, trans = rng.normal(size=(170, 3)), np.array([0, 5, 130, 1, 34]), rng.normal(size=(3, 3))
    q, _ = langid_crf.forward_backward(e, count, trans)
    at = 0
    for c in count:
        p, a = np.exp(e[at : at + c]), np.exp(trans)
        f, b = np.zeros((c, 3)), np.ones((c, 3))
        for t in range(c):
            f[t] = ((np.ones(3) / 3 if t == 0 else f[t - 1]) @ a) * p[t]
            f[t] /= f[t].sum()
        for t in range(c - 2, -1, -1):
            b[t] = a @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b
        assert np.allclose(q[at : at + c], want / want.sum(axis=1, keepdims=True), atol=1e-5)
        at += c
    en, de = "the thing of words and that is with it", "der hund und die katze ist nicht auf dem haus"
    texts = [f"{en if k % 2 else de} {k}" for k in range(120)] + [None, "", "123 !"]
    d = spark.createDataFrame([(k, t, ("en" if k % 2 else "de") if k < 120 else None, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid_crf.identify(d).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(120)) and {got[k].lang_pred for k in (120, 121, 122)} == {"und"}
    assert {r.lang_pred for r in langid_crf.identify(d.withColumn("lang", d.lang.substr(9, 2).cast("string")).filter("doc_id > 500")).collect()} == set()


def test_quality(spark):
    good, bad = "Plain words make a sentence here, and they go on. ", "WORDS!! %%% $$$ | | "
    d = spark.createDataFrame([(k, (good if k % 2 else bad) * (1 + k % 5), 1) for k in range(200)] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(5, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality_rff.score_quality(d, labels).collect()}
    assert all(rows[k].predicted == k % 2 for k in range(200)) and all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 202
    assert {r.score for r in quality_rff.score_quality(d, labels.limit(0)).collect()} == {0.5}
    assert np.allclose(quality_rff.isotonic(np.array([1.0, 0, 1, 1]), np.array([1.0, 1, 1, 1])), [0.5, 0.5, 1, 1])


@pytest.mark.parametrize("seed", range(4))
def test_cover_trees_find_all(seed):
    rng = np.random.default_rng(seed)
    n, m, d = 700, 40, 1 + seed * 3
    x, ids = np.floor(rng.normal(size=(n, d)) * 9), rng.permutation(2 * n)[:n]
    q, q_ids = x[rng.integers(0, n, m)], rng.integers(0, 2 * n, m)
    s, i = topk_cover.search(q, q_ids, x, ids, 7)
    for r in range(m):
        want = sorted((-float(q[r] @ x[j]), int(ids[j])) for j in range(n) if ids[j] != q_ids[r])[:7]
        assert [(-a, int(b)) for a, b in zip(s[r], i[r])] == want


def test_top_k_table(spark):
    rows = [(k, [float(k % 7), float(-k), 0.25]) for k in range(250)] + [(300, None), (400, [1.0, None, 2.0]), (500, [float("nan")] * 3), (None, [1.0] * 3), (600, [1.0, 2.0]), (700, [1e300, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_cover.top_k(d, block=64, group=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(by) == {0, 100, 200, 700} and all(sorted(x[0] for x in v) == list(range(1, 11)) for v in by.values())
    assert topk_cover.top_k(d.limit(0)).count() == 0
