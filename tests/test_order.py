"""Order statistics, quantiles and first rows against sorting; the batch scanner against the columns that say the same."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import language, lexicon, scan
from sievework.functions import text as t
from sievework.operators.order import first_rows, order_statistics, quantiles

CASES = [
    [3.0, 1.0, 2.0, 2.0, 2.0, 9.5], [5.0] * 7, [float(k % 3) for k in range(50)], [1e300, -1e300, 0.0, 1e-300, -1e-300], [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1e9], [0.1 * k for k in range(700)],
]


@pytest.mark.parametrize("values", CASES, ids=range(len(CASES)))
def test_order_statistics(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double")
    s = sorted(values)
    assert order_statistics(df, "v", range(-1, len(s) + 2)) == {r: (x, s.index(x)) for r, x in enumerate(s)}
    for q, got in zip((0.0, 0.3, 0.5, 1.0), quantiles(df, "v", (0.0, 0.3, 0.5, 1.0)), strict=True):
        p = q * (len(s) - 1)
        a, b = math.floor(p), math.ceil(p)
        assert got == (s[a] if a == b else (b - p) * s[a] + (p - a) * s[b])
    assert quantiles(df.limit(0), "v", (0.5,)) == [None]


@pytest.mark.parametrize("k", [0, 1, 4, 9, 30, 57, 60, 99])
def test_first_rows(spark, k):
    rng = random.Random(2)
    rows = [(rng.choice([1.0, 2.5, 2.5, 7.0]), f"i{rng.randrange(25)}") for _ in range(60)]
    df = spark.createDataFrame(rows, "v double, id string")
    assert sorted((r.v, r.id) for r in first_rows(df, F.col("v"), "id", k).collect()) == sorted(rows)[:k]


def test_scan_says_what_the_columns_say(spark):
    rng = random.Random(9)
    words = ["Wait, let me", "that's not right, I", "Therefore", "since", "final answer", "é", "日本語。", "ſo", "İ", "der", "die", "the", "of", "\n", "\n\n", " ", "```x\n", ".", "! ", "?", "let me verify", "check", "Hmm, let me", "xwait, let me", "한국", "\x1c", " ", "ok then we go on", "²", "ñ", "answer: 4", "step 1", "because"]
    words += list(lexicon.EXPLICIT[:6]) + list(lexicon.IMPLICIT[:6]) + list(lexicon.UNCERTAIN[:4]) + list(lexicon.CONCLUSIONS[:6])
    texts = ["", " ", "a"] + ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.choice([3, 20, 90, 300]))) for _ in range(160)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, _x string").withColumn("_lower", F.lower("_x")).withColumn("_plain", t.without_code(F.col("_x"))).withColumn("b", F.col("_lower").cast("binary")).cache()
    x, low, b = F.col("_x"), F.col("_lower"), F.col("b")
    s = F.transform(t.sentences(x), t.normalize)
    p = t.paragraphs(x)
    brief = F.char_length(low) < 50
    late, middle = F.when(brief, low).otherwise(t.late(b)), F.when(brief, F.lit("")).otherwise(t.middle(b))
    chunked = F.filter(t.chunks(F.col("_plain"), 5), lambda c: t.token_count(c) >= 4)
    want = {
        "restarts": t.restarts(x, low), "strong": t.count_phrases(low, lexicon.STRONG), "medium": t.count_phrases(low, lexicon.MEDIUM), "weak": t.count_phrases(low, lexicon.WEAK), "double": t.count_phrase(x, F.lit("\n\n")), "breaks": t.count_phrase(x, F.lit("\n")),
        "concl": t.distinct_phrases(t.tail(b), lexicon.CONCLUSIONS), "delimiters": t.distinct_phrases(t.tail(b), lexicon.DELIMITERS), "uncertain": t.distinct_phrases(t.final(b), lexicon.UNCERTAIN),
        "late_e": t.count_phrases(late, lexicon.EXPLICIT), "late_i": t.count_phrases(late, lexicon.IMPLICIT), "mid_e": t.count_phrases(middle, lexicon.EXPLICIT), "mid_i": t.count_phrases(middle, lexicon.IMPLICIT),
        "paragraphs": F.size(p), "distinct_paragraphs": F.size(F.array_distinct(p)), "sentences": F.size(s), "thrice": F.size(F.filter(F.array_distinct(s), lambda y: F.size(F.filter(s, lambda z: z == y)) >= 3)),
        "langs": F.when(F.char_length("_plain") >= 100, F.transform(chunked, language.detect)).otherwise(F.array().cast("array<string>")),
    }
    got = df.withColumn("seen", scan.scan(tuple(scan.PARTS), 5, 4)).select("k", "seen.*")
    for field, column in want.items():
        a, c = ({r.k: r.v for r in d.collect()} for d in (got.select("k", F.col(field).alias("v")), df.select("k", column.alias("v"))))
        off = [(k, a[k], c[k], texts[k][:80]) for k in a if a[k] != c[k]]
        assert not off, (field, len(off), off[:2])
