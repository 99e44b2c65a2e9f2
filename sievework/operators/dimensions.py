"""The nine quality dimensions as columns.

Shared intermediates are staged in projections of their own (see ``stage``), since every dimension
reads several of them. All score arithmetic is single precision, one rounding per operation.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import lexicon
from ..functions import text as t
from ..functions.scan import scan


def f32(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def over(a: Column, b: Column | float) -> Column:
    return f32(f32(a) / f32(b))


def times(a: Column, b: Column | float) -> Column:
    return f32(f32(a) * f32(b))


def plus(a: Column, b: Column | float) -> Column:
    return f32(f32(a) + f32(b))


def minus(a: Column | float, b: Column) -> Column:
    return f32(f32(a) - f32(b))


def _efficiency(c: Config) -> dict[str, Column]:
    return {"score": F.greatest(minus(100.0, times(F.col("_density"), c.restart_penalty_per_1k)), f32(0.0)), "restart_count": F.col("_restarts"), "word_count": F.col("_tokens"), "restart_density": F.col("_density")}


def _language(c: Config) -> dict[str, Column]:
    off = F.col("_off")
    score = F.when(off <= 1, f32(100.0)).otherwise(F.greatest(minus(100.0, times(minus(off, f32(1.0)), 15.0)), f32(0.0)))
    named = F.when(F.col("_plain_chars") < 100, "unknown_short").when(F.size("_langs") == 0, "unknown_no_valid_chunks").otherwise(F.col("_top.lang"))
    return {"score": score, "detected_language": named, "inconsistent_chunks": off, "is_mixed": off > 1}


def _alignment(c: Config) -> dict[str, Column]:
    total = F.least(F.col("_convergence") + F.col("_echo") + F.col("_delimiter") + F.col("_settled"), F.lit(100))
    return {"score": f32(total), "answer_in_trace_end": total >= 50, "convergence": F.col("_convergence"), "answer_echo": F.col("_echo"), "delimiters": F.col("_delimiter"), "anti_divergence": F.col("_settled")}


def _structure(c: Config) -> dict[str, Column]:
    some = F.col("_tokens") >= 10
    score = F.least(F.col("_structure"), F.when((F.col("_effective") == 0) & (F.col("_tokens") > 200), f32(40.0)).otherwise(f32(100.0)))
    return {"score": F.when(some, score).otherwise(f32(50.0)), "strong_markers": F.when(some, F.col("_strong")), "medium_markers": F.when(some, F.col("_medium")), "weak_markers": F.when(some, F.col("_weak")), "effective_paragraphs": F.when(some, F.col("_effective"))}


def _repetition(c: Config) -> dict[str, Column]:
    ratio = F.when(F.col("_sentences") == 0, f32(0.0)).otherwise(over(F.col("_thrice"), F.col("_sentences")))
    r = F.greatest(minus(1.0, F.col("_unique")), ratio)
    return {"score": times(f32(100.0), minus(1.0, F.least(times(r, 3.0), f32(1.0)))), "paragraph_unique_ratio": F.col("_unique"), "repeated_sentences_3plus": F.col("_thrice")}


def complexity(problem: Column) -> Column:
    """How demanding a problem looks, from 0 to 1."""
    low = F.lower(problem)
    math = F.char_length(problem) - F.char_length(F.translate(problem, lexicon.MATH_SIGNS, "")) + t.count_phrases(low, lexicon.MATH_WORDS)
    return _demand(t.token_count(problem), math, t.count_phrases(low, lexicon.CODE_WORDS))


def _demand(tokens: Column, math: Column, code: Column) -> Column:
    parts = plus(plus(F.least(over(tokens, 150.0), f32(0.4)), F.least(times(math, 0.1), f32(0.3))), F.least(times(code, 0.15), f32(0.3)))
    return F.least(parts, f32(1.0))


def _overthinking(c: Config) -> dict[str, Column]:
    ratio = F.col("_ratio")
    score = F.when(ratio <= 1, 100).when(ratio <= 1.5, 90).when(ratio <= 2.5, 70).when(ratio <= 4, 40).otherwise(10)
    return {"score": f32(score), "complexity": F.col("_complexity"), "trace_words": F.col("_tokens"), "expected_max": F.col("_expected"), "ratio": ratio}


def _verification(c: Config) -> dict[str, Column]:
    late_e, late_i, mid_e, mid_i = (F.col(k) for k in ("_late_e", "_late_i", "_mid_e", "_mid_i"))
    score = (
        F.when(F.char_length("_lower") < 50, F.when(late_e > 0, 80).when(late_i > 0, 70).otherwise(50))
        .when(late_e >= 2, 100).when((late_e == 1) & (late_i >= 1), 95).when(late_e == 1, 85).when(late_i >= 2, 80).when(late_i == 1, 70).when(mid_e >= 1, 65).when(mid_i >= 1, 55).otherwise(30)
    )
    return {"score": f32(score), "late_explicit": late_e, "late_implicit": late_i, "mid_explicit": mid_e, "mid_implicit": mid_i, "has_verification": late_e + late_i + mid_e + mid_i > 0}


def _length(c: Config) -> dict[str, Column]:
    n = F.col("_tokens")
    score = F.when(n <= 30, 5).when(n <= 100, 30).when(n < c.sweet_spot_min, 60).when(n <= c.sweet_spot_max, 100).when(n <= c.sweet_spot_max + 2000, 90).when(n <= 10_000, 70).when(n <= 20_000, 40).otherwise(15)
    return {"score": f32(score), "word_count": n}


def _accuracy(c: Config) -> dict[str, Column]:
    e, right = F.col("_thrift"), F.col("_right")
    score = over(times(f32(100.0), times(e, 2.0)), plus(e, 1.0))
    known = F.col("expected_answer").isNotNull()
    return {"score": F.when(~known, f32(100.0)).when(right, score).otherwise(f32(0.0)), "skipped": ~known, "accurate": F.when(known, right), "token_efficiency": F.when(known, e), "thinking_tokens": F.when(known, F.col("_tokens"))}


@dataclass(frozen=True)
class Dimension:
    """One dimension: its key, public name, score column, staged inputs and columns (``score`` and diagnostics)."""

    key: str
    name: str
    column: str
    needs: tuple[str, ...]
    make: Callable[[Config], dict[str, Column]]


DIMENSIONS = (
    Dimension("efficiency", "efficiency", "efficiency_score", ("_restarts", "_density"), _efficiency),
    Dimension("language", "language_consistency", "language_score", ("_plain_chars", "_langs", "_top", "_off"), _language),
    Dimension("alignment", "answer_alignment", "answer_alignment_score", ("_convergence", "_echo", "_delimiter", "_settled"), _alignment),
    Dimension("structure", "structural_clarity", "structural_score", ("_strong", "_medium", "_weak", "_double", "_breaks", "_effective", "_structure"), _structure),
    Dimension("repetition", "repetition", "repetition_score", ("_paragraphs", "_distinct", "_sentences", "_unique", "_thrice"), _repetition),
    Dimension("overthinking", "overthinking", "overthinking_score", ("_complexity", "_expected", "_ratio"), _overthinking),
    Dimension("verification", "self_verification", "verification_score", ("_late_e", "_late_i", "_mid_e", "_mid_i"), _verification),
    Dimension("length", "length_calibration", "length_score", (), _length),
    Dimension("accuracy_efficiency", "accuracy_efficiency", "accuracy_efficiency_score", ("_thrift", "_right"), _accuracy),
)


@functools.lru_cache(maxsize=4)
def _stages(c: Config, app: str) -> list[dict[str, Column]]:
    """For one application: intermediates in the order in which they build on each other; nothing large is written twice in an expression."""
    n = F.col("_tokens")
    count = F.col("_concl")
    langs = F.col("_langs")
    seen = F.col("_seen")
    snippet = F.col("_snippet")
    numeric = F.regexp_like(snippet, F.lit(r"^[\p{N}.\-+/=%±×−÷]{1,2}$")) & F.regexp_like(snippet, F.lit(r"\p{N}"))
    alone = (F.char_length(snippet) == 1) & (F.octet_length(snippet) > 1)
    counts = F.transform(F.array_distinct(langs), lambda k: F.struct((-F.size(F.filter(langs, lambda y: y == k))).alias("n"), k.alias("lang")))
    return [
        {"_complexity": _demand(seen["problem_tokens"], seen["math"], seen["code"]), "_right": t.answers_match(F.col("answer"), F.col("expected_answer")),
         "_thrift": F.least(F.greatest(minus(1.0, over(F.greatest(n - c.token_min, F.lit(0)), float(c.token_max - c.token_min))), f32(0.2)), f32(1.0)),
         "_restarts": seen["restarts"], "_strong": seen["strong"], "_medium": seen["medium"], "_weak": seen["weak"], "_double": seen["double"], "_breaks": seen["breaks"], "_concl": seen["concl"], "_langs": seen["langs"], "_plain_chars": seen["plain_chars"],
         "_late_e": seen["late_e"], "_late_i": seen["late_i"], "_mid_e": seen["mid_e"], "_mid_i": seen["mid_i"], "_delimiter": F.when(seen["delimiters"] > 0, 20).otherwise(0), "_settled": F.when(seen["uncertain"] > 0, 0).otherwise(20),
         "_paragraphs": seen["paragraphs"], "_distinct": seen["distinct_paragraphs"], "_sentences": seen["sentences"], "_thrice": seen["thrice"]},
        {"_density": over(F.col("_restarts"), F.greatest(over(n, 1000.0), f32(1.0))), "_effective": plus(F.col("_double"), times(F.greatest(F.col("_breaks") - F.col("_double") * 2, F.lit(0)), 0.5)), "_expected": plus(f32(500.0), times(F.col("_complexity"), 4000.0)),
         "_unique": F.when(F.col("_paragraphs") == 0, f32(1.0)).otherwise(over(F.col("_distinct"), F.col("_paragraphs")))},
        {"_echo": F.when(((F.char_length(snippet) >= 3) | numeric | alone) & seen["echoed"], 25).otherwise(0), "_top": F.array_min(counts), "_ratio": over(n, F.col("_expected")),
         "_structure": F.least(plus(times(over(F.col("_strong") * 3 + F.col("_medium") * 2 + F.col("_weak"), F.greatest(over(n, 100.0), f32(1.0))), 5.0), F.least(times(F.col("_effective"), 8.0), f32(40.0))), f32(100.0))},
        {"_convergence": F.least(F.when(count == 0, 0).when(count == 1, 15).when(count == 2, 22).otherwise(25) + F.when(seen["closed"], 10).otherwise(0), F.lit(35)), "_off": F.when((F.col("_plain_chars") < 100) | (F.size(langs) == 0), 0).otherwise(F.size(langs) + F.col("_top.n"))},
    ]


#: What a visit of the text counts for each dimension.
_SCANNED = {"efficiency": "restarts", "language": "languages", "alignment": "ending", "structure": "markers", "repetition": "repeats", "overthinking": "problem", "verification": "checks"}


def stage(df: DataFrame, config: Config, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with the intermediates that the dimensions ``keys`` need, in successive projections; one Arrow function visits the texts."""
    needs = {k for d in DIMENSIONS if d.key in keys for k in d.needs} | ({"_concl"} if "alignment" in keys else set())
    df = df.withColumns({"_x": t.extract_thinking(F.col("thinking"))})
    df = df.withColumns({"_lower": F.lower("_x"), "_snippet": F.left(F.lower("answer"), F.lit(60))})
    if parts := tuple(p for k, p in _SCANNED.items() if k in keys):
        df = df.withColumn("_seen", scan(("tokens", *parts), config.num_chunks, config.min_words_per_chunk, snippet="_snippet", problem="problem"))
    df = df.withColumns({"_tokens": F.col("_seen.tokens") if parts else t.token_count(F.col("_x"))})
    for columns in _stages(config, df.sparkSession.sparkContext.applicationId):
        if wanted := {k: v for k, v in columns.items() if k in needs}:
            df = df.withColumns(wanted)
    return df
