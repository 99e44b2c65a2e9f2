"""Steps that once did the same work over and over, or all of it in one task."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import scan
from sievework.functions import text as t
from sievework.operators import select, spans, stats
from sievework.operators.dimensions import complexity
from sievework.operators.order import running
from sievework.operators.score import score
from sievework.plans import catalog
from sievework.plans.traces import traces

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_evaluate_their_text_once(spark):
    df = spark.createDataFrame([("abcdefghijk",), ("ab",), ("",), (None,)], "x string")
    got = df.select(t.chunks(F.reverse("x"), 3).alias("c"))
    assert plan(got).count("reverse(") == 1
    assert [r.c for r in got.collect()] == [["kji", "hgf", "edcba"], ["b", "a"], [], []]


@pytest.mark.parametrize("x", ["", "　", "\x85a b ", "\x1ca\x1c", "​a", "  x   　\xa0"])
def test_trim_and_tags(spark, x):
    old = F.regexp_replace(F.regexp_replace("x", r"(?U)^\s+", ""), r"(?U)(?<!\s)\s+$", "")
    r = spark.createDataFrame([(x,)], "x string").select(old.alias("a"), t.trim_u(F.col("x")).alias("b"), t.extract_thinking(F.concat(F.lit("<thought>q</thought></think> <think> é"), "x", F.lit(" <think></think></think>"))).alias("c"), t.extract_thinking(F.concat(F.lit("</reasoning><think><reasoning>"), "x")).alias("d")).first()
    assert r.a == r.b and r.c == ("é" + x + " <think>").strip() and r.d.startswith("</reasoning><think><reasoning>")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_move_no_rows(spark):
    plan = executed(catalog.QUERIES["q_ann_5_segments"](spark, SF))
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") <= 1  # few files are spread


def test_segments_of_any_spans(spark):
    rows = [("a", -3, 2, "x"), ("a", 1, 4, "y"), ("a", 1, 9, "x"), ("a", 5, 5, "z"), ("b", 0, 9, "x")]
    got = spans.segments(spark.createDataFrame(rows, "id string, start int, end int, kind string"), spark.createDataFrame([("a", 6), ("c", 2)], "id string, len int"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 1, "x"), ("a", 1, 2, "x,y"), ("a", 2, 4, "x,y"), ("a", 4, 6, "x"), ("c", 0, 2, "")]
    assert "Join LeftOuter" in plan(got) and ">=" not in plan(got)


def test_spans_of_a_text_of_many():
    one = "Hmm, let me see. İ, to verify: é. "
    n = 20_000
    began = time.process_time()
    found = spans.spans_of(one * n)
    parts = spans.sweep(len(one.encode()) * n, [s[:3] for s in found])
    assert time.process_time() - began < 20
    size = len(one.encode())
    assert found[:3] == [(0, 11, "restart", "starts over"), (21, 30, "verification", "checks itself"), (size, size + 11, "restart", "starts over")]
    assert sum(s[2] == "restart" for s in found) == n and parts[0] == (0, 11, "restart") and parts[-1][1] == size * n
    raw = (one * n).encode()
    assert all(raw[a:b].lower() == b"to verify" for a, b, kind, _ in found[:999] if kind == "verification")


def test_odd_and_plain_letters_start_over():
    found = lambda x: [(a, b) for a, b, kind, _ in spans.phrase_spans(x) if kind == "restart"]
    assert found("I need to re\u017ftart, I need to RESTART") == [(0, 18), (20, 37)]
    plain = "Await, let me. No wait, actually\x1c wait,\x1cactually 1wait actually WAIT\t\x0blet me. That's wrong, I. hmmm, let me redo"
    assert [(a + 3, b + 3) for a, b in found(plain)] == found("é " + plain) and len(found(plain)) == 7


def test_scoring_reads_a_text_once(spark):
    text = plan(score(traces(spark, SF)).select("raw_score", "quality_score"))
    assert r"\S+" not in text and "translate(" not in text and r"```[^\n]*" not in text


def test_scan_says_what_more_columns_say(spark):
    rng = random.Random(4)
    words = ["```", "\n", "\r\n", "\n ```py\n", "　```\n", "\x1c", "a", "word ", "é", "。", "! ", ". \x85", "４", "汉", "\\frac", "∑", "class ", "Class ", "İ", "x^{2}", " ", "\u2028"]
    rows = [(k, *("".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(2)), rng.choice(["4", "word", "４", "汉", "", "a a"])) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, _x string, problem string, s string").withColumn("_lower", F.lower("_x")).withColumn("b", F.col("_lower").cast("binary")).cache()
    got = df.withColumn("seen", scan.scan(("tokens", "ending", "languages", "problem"), 5, 4, snippet="s", problem="problem"))
    x, q, low = F.col("_x"), F.col("problem"), F.lower("problem")
    want = {
        "tokens": t.token_count(x), "plain_chars": F.char_length(t.without_code(x)), "echoed": F.contains(t.tail(F.col("b")), F.col("s")), "closed": F.regexp_like(t.trim_u(t.final(F.col("b"))), F.lit(r"[.!。！]\z")),
        "problem_tokens": t.token_count(q), "math": F.char_length(q) - F.char_length(F.translate(q, "≠≥≤∞√∏∑∫", "")) + t.count_phrases(low, scan.lexicon.MATH_WORDS), "code": t.count_phrases(low, scan.lexicon.CODE_WORDS),
    }
    for field, column in want.items():
        a, c = ({r.k: r.v for r in d.collect()} for d in (got.select("k", F.col(f"seen.{field}").alias("v")), df.select("k", column.alias("v"))))
        assert a == c, (field, [(k, a[k], c[k]) for k in a if a[k] != c[k]][:3])
    assert df.select(complexity(q).alias("c")).filter("c > 0").count()


def windows(df):
    return [line for line in plan(df).splitlines() if "Window [" in line]


def test_no_task_ranks_a_group(spark):
    rows = [(str(k % 2) if k % 3 else None, float(k * 7 % 101), k) for k in range(101)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(3)
    got = running(df, ("g",), [F.desc("v")], {"s": F.col("n"), "c": F.lit(1)})
    want = {(g, v): (sum(m for h, u, m in rows if h == g and u > v), sum(h == g and u > v for h, u, _ in rows)) for g, v, _ in rows}
    assert {(r.g, r.v): (r.s, r.c) for r in got.collect()} == want
    d = df.withColumn("correct", F.col("n") % 2 == 0).withColumn("id", F.col("n").cast("string")).withColumnRenamed("v", "quality_score").withColumnRenamed("g", "domain")
    for x in (got, stats.auc(d, ("domain",), "quality_score"), stats.average_rank(d, "quality_score", ("domain",), "r"), stats.spearman(d, "quality_score", "n", ("domain",)), select.sweep(d, "quality_score"), select.systematic(d, 3)):
        assert windows(x) and all("_p#" in line for line in windows(x))
    order = sorted((x for x in rows if x[0] == "1"), key=lambda x: -x[1])
    assert sorted(r.n for r in select.systematic(d, 3).filter("domain = '1'").collect()) == sorted(x[2] for x in order[2::3])


def test_weights_are_those_of_the_hash(spark):
    ids = [f"t{k}" for k in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", F.xxhash64("id").alias("h"), F.explode(F.sequence(F.lit(1), F.lit(70))).alias("r"))
    low = np.array([r.x for r in df.orderBy("id", "r").select(F.pmod(F.xxhash64("id", "r"), F.lit(1 << 30)).alias("x")).collect()]).reshape(300, 70)
    steps = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(8)])
    h = np.array([r.h for r in df.filter("r = 1").orderBy("id").collect()])
    assert (stats.poisson(h, 70) == sum(((low + 0.5) / (1 << 30) > s).astype(int) for s in steps)).all()


def test_bootstrap_repeats_no_row(spark):
    rng = random.Random(1)
    rows = [(f"t{k}", rng.choice([1.0, 2.0, 2.0, 3.0, rng.random(), float("nan"), None]), rng.choice([True, False, None])) for k in range(900)]
    df = spark.createDataFrame(rows, "id string, v double, correct boolean").repartition(5).withColumn("w", F.lit(1.0))
    got = stats._replicates(df, ("v", "w"), "correct", 30)
    h = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    weights = stats.poisson(np.array([h[i] for i, _, _ in rows]), 30).astype(int)
    rank = {None: -2.0}
    v = np.array([rank.get(x, 9.0 if x != x else x) for _, x, _ in rows])
    pos, neg = (np.array([c is kind for _, _, c in rows]) for kind in (True, False))
    for r in range(30):
        p, n = weights[:, r] * pos, weights[:, r] * neg
        want = sum(a * (n[v < x].sum() + n[v == x].sum() / 2) for a, x in zip(p, v)) / (p.sum() * n.sum())
        assert got["v"][r] == pytest.approx(want, abs=1e-12) and got["w"][r] == 0.5
    assert stats._replicates(df.limit(0), ("v",), "correct", 3) == {"v": [None] * 3}
    row = stats.bootstrap_auc(df, "v", replicates=30, other="w").first()
    assert row.replicates == 30 and row.mean == pytest.approx(np.mean(got["v"]) - 0.5)


@pytest.mark.parametrize("name", ["q_agg_26_label_stats", "q_jon_1_labels"])
def test_what_reads_no_score_scores_nothing(spark, name):
    assert "thinking" not in plan(catalog.QUERIES[name](spark, SF)) and "InMemory" not in plan(catalog.QUERIES[name](spark, SF))


def test_phrases_and_sentences_evaluate_their_text_once(spark):
    rows = [("",), (None,), ("a b c d e f",), ("Short. It is. x",), ("汉" * 10 + "。 the rest is three",), ("wait. " * 400 + "thus, hence",)]
    df = spark.createDataFrame(rows, "x string")
    x = F.reverse(F.reverse("x"))
    for c in (t.distinct_phrases(x, ("thus", "hence")), t.count_phrases(x, ("wait", "thus"))):
        assert plan(df.select(c.alias("c"))).count("reverse(reverse(") == 1
    assert plan(df.select(t.sentences(F.col("x")).alias("c"))).count("(?s)") == 1
    pieces = F.transform(F.regexp_extract_all(F.col("x"), F.lit(t.SENTENCE), F.lit(0)), t.trim_u)
    rest = F.filter(F.array(t.trim_u(F.regexp_replace("x", t.SENTENCE, ""))), lambda r: t.token_count(r) >= 3)
    got = df.select(t.sentences(F.col("x")).alias("a"), F.concat(pieces, rest).alias("b"), t.distinct_phrases(x, ("thus", "hence")).alias("d"), t.count_phrases(x, ("wait", "thus")).alias("n")).collect()
    assert all(r.a == r.b for r in got) and (got[-1].d, got[-1].n) == (2, 401) and (got[0].d, got[0].n) == (0, 0)
