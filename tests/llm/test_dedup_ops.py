"""Operators on pairs and repeats against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from sievework.llm import exact_dedup as ed
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.jaccard_join import jaccard_join
from sievework.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, id long, n long, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "É", "日本"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 120]))) for _ in range(25)]
    out = []
    for t in base:
        out += [t] * rng.choice([1, 1, 2, 6])
        for _ in range(rng.choice([0, 2, 5])):
            w = t.split(" ")
            for _ in range(max(1, len(w) // rng.choice([6, 12, 30]))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    out += ["", "", None, "  \n\t ", "x", "X", "a\x0bb\x0cc", "a b c", "ha " * 300, "ha " * 90, " ".join(f"u{k}" for k in range(4000))]
    return list(enumerate(out, start=3))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("unit_bytes", [4 << 20, 600])
def test_jaccard_join(spark, rows, unit_bytes):
    sets = {i: shingles(t) for i, t in rows}
    links = defaultdict(set)
    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * k >= 60 * (len(sets[i]) + len(sets[j]) - k):
                links[i].add(j)
                links[j].add(i)

    def lowest(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard_join(frame(spark, rows), unit_bytes=unit_bytes).collect()}
    assert got == {i: (len(sets[i]), len(links[i]), lowest(i)) for i in sets}


def test_jaccard_join_without_ids_and_rows(spark):
    assert jaccard_join(frame(spark, [])).count() == 0
    got = sorted((r.doc_id or -1, r.n_similar, r.component_id) for r in jaccard_join(frame(spark, [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "q")])).collect())
    assert got == [(-1, 2, None), (7, 2, None), (7, 2, None), (9, 0, 9)]


def test_substring_dedup(spark, rows):
    want, seen = {}, set()
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup(frame(spark, rows[::-1]).repartition(3), with_text=True).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_substring_dedup_without_ids_and_rows(spark):
    assert substring_dedup(frame(spark, [])).count() == 0
    t = " ".join(f"a{k}" for k in range(25))
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, [(None, t), (5, t)])).collect()}
    assert got == {None: 0, 5: 25}


@pytest.mark.parametrize(("key_bits", "capacity"), [(64, 250_000), (3, 2), (16, 4)])
def test_exact_dedup(spark, rows, key_bits, capacity):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    for most in (1_000_000, 2):  # shared keys by broadcast, and more than may go so
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, rows), key_bits=key_bits, capacity=capacity, broadcast_rows=most).collect()}
        assert got == want


def test_exact_dedup_with_a_hot_text_and_many_shared_keys(spark):
    rows = [(k, "hot " * 500 if k % 3 == 0 else f"text {k // 6}") for k in range(6000)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(frame(spark, rows), broadcast_rows=10, capacity=50).collect()}
    last = {t: max(i for i, x in rows if x == t) for t in {rows[0][1]}}
    assert got[0] == (last[rows[0][1]], 2000) and got[1] == (5, 4) and len(got) == 6000
    assert exact_dedup(frame(spark, [(1, "y" * 5_000_000), (2, "y" * 5_000_000), (2, "z")])).filter("group_size = 2 and keep_id = 2").count() == 2


def test_exact_dedup_without_ids_and_rows(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup(frame(spark, [(None, "a"), (4, "a"), (4, "a"), (None, "b")])).collect())
    assert got == [(-1, -1, 1, True), (-1, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True)]


def test_directory_doubles_where_buckets_are_full():
    d = ed.directory({0: 5, 1: 5, 2: 1, 3: 1, 4: 0, 5: 0, 6: 3, 7: 3}, 3, 5)
    assert d == [0, 1, 2, 2, 3, 3, 4, 5] and ed.directory({}, 0, 5) == [0]
