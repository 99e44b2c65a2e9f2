"""Queries of text primitives, dimensions and scoring, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as t
from ..operators.dimensions import DIMENSIONS, complexity
from ..operators.score import calibrate, dimensions, score, score_detailed, spread
from . import oracle as o
from .traces import traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def r4(c: Column) -> Column:
    return F.round(c.cast("double"), 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, if there is any, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _columns(name: str, source: str, spark_cols: Callable[[], dict[str, Column]], sql_cols: dict[str, str], keys: tuple[str, ...] = ("id",), staged: Callable[[], Column] | None = None) -> None:
    """A query of columns over the traces; ``source`` names the CTE they come from. ``staged`` makes the column ``s``, for what several columns read."""
    sql = o.over_scored(f"SELECT {', '.join([*keys, *(f'{v} AS {k}' for k, v in sql_cols.items())])} FROM {source}")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = spread(traces(spark, sf)).withColumn("x", t.extract_thinking(F.col("thinking"))).withColumn("low", F.lower("x")).withColumn("h", F.col("low").cast("binary"))
        if staged:
            df = df.withColumn("s", staged())
        return df.select(*keys, *(v.alias(k) for k, v in spark_cols().items()))

    query(name, sql)(run)


def _texts() -> None:
    c = _columns
    c("q_txt_1_extract", "s1", lambda: {"x": F.col("x")}, {"x": "x"})
    c("q_txt_2_tokens", "s2", lambda: {"n": t.token_count(F.col("x"))}, {"n": "tok"})
    c("q_txt_3_cjk", "s1", lambda: {"cjk": F.regexp_like(F.col("x"), F.lit(t.CJK))}, {"cjk": "regexp_matches(x, '[㐀-䶿一-鿿぀-ヿ가-힯]')"})
    c("q_txt_4_boundary", "s2", lambda: {"cut": t.byte_slice(F.col("h"), F.lit(7), F.lit(40))}, {"cut": o.cut("h", "least(7, len)", "least(40, len)")})
    c("q_txt_5_normalize", "s1", lambda: {"n": t.normalize(F.col("x"))}, {"n": o.normal("x")})
    c("q_txt_6_sentences", "s3", lambda: {"n": F.size("s"), "first": t.normalize(F.get("s", F.lit(0)))}, {"n": "len(sents)::INT", "first": "sents[1]"}, staged=lambda: t.sentences(F.col("x")))
    c("q_txt_7_paragraphs", "s3", lambda: {"n": F.size(t.paragraphs(F.col("x"))), "all": F.array_join(t.paragraphs(F.col("x")), "|")}, {"n": "len(paras)::INT", '"all"': "coalesce(array_to_string(paras, '|'), '')"})
    c("q_txt_8_no_code", "s3", lambda: {"p": t.without_code(F.col("x"))}, {"p": "plain_"})
    c("q_txt_9_chunks", "s3", lambda: {"n": F.size("s"), "lens": F.array_join(F.transform("s", F.char_length), ",")}, {"n": "CAST(least(10, length(plain_)) AS INT)", "lens": "coalesce(array_to_string(list_transform(range(least(10, length(plain_))), lambda i: CASE WHEN i + 1 = least(10, length(plain_)) THEN length(plain_) - i * (length(plain_) // least(10, length(plain_))) ELSE length(plain_) // least(10, length(plain_)) END), ','), '')"}, staged=lambda: t.chunks(t.without_code(F.col("x")), 10))
    c("q_txt_10_tail", "s3", lambda: {"s": t.tail(F.col("h"))}, {"s": "tail"})
    c("q_txt_11_final", "s3", lambda: {"s": t.final(F.col("h"))}, {"s": "fin"})
    c("q_txt_12_windows", "s3", lambda: {"late": t.late(F.col("h")), "mid": t.middle(F.col("h"))}, {"late": "late", "mid": "mid"})
    c("q_txt_13_counts", "s4", lambda: {"strong": t.count_phrases(F.col("low"), lexicon.STRONG), "weak": t.count_phrases(F.col("low"), lexicon.WEAK)}, {"strong": "strong", "weak": "weak"})
    c("q_txt_14_presence", "s4", lambda: {"n": t.distinct_phrases(t.tail(F.col("h")), lexicon.CONCLUSIONS)}, {"n": "concl"})
    c("q_txt_15_completion", "s1", lambda: {"t": t.split_completion(F.col("thinking"))[0], "a": t.split_completion(F.col("thinking"))[1]}, {"t": "CASE WHEN contains(thinking, '<think>') THEN x ELSE '' END", "a": o.trim("regexp_replace(thinking, '(?s)^.*</think>', '')")})
    c("q_txt_16_answer", "s1", lambda: {"a": t.normalize_answer(F.col("answer")), "e": t.normalize_answer(F.col("expected_answer"))}, {"a": o.answer("answer"), "e": o.answer("expected_answer")})
    c("q_txt_17_match", "s5", lambda: {"same": t.answers_match(F.col("answer"), F.col("expected_answer"))}, {"same": "accurate"})
    reply = lambda: F.concat(F.lit("I rate it "), F.col("problem_id") % 7, F.lit(". Score: "), F.col("problem_id") % 130, F.when(F.col("problem_id") % 3 == 0, F.lit(".5 of 100")).otherwise(F.lit("/100")))
    reply_sql = "('I rate it ' || (problem_id % 7)::VARCHAR || '. Score: ' || (problem_id % 130)::VARCHAR || CASE WHEN problem_id % 3 = 0 THEN '.5 of 100' ELSE '/100' END)"
    num = lambda s: f"list_filter(list_transform(regexp_extract_all({s}, '[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+'), lambda v: TRY_CAST(regexp_replace(v, '\\.$', '') AS DOUBLE)), lambda v: v BETWEEN 0 AND 100)[1]"
    c("q_txt_18_judge_score", "s1", lambda: {"s": t.judge_score(reply())}, {"s": f"coalesce({num(f'substr(lower({reply_sql}), strpos(lower({reply_sql}), {o.q('score')}) + 5)')}, {num(f'lower({reply_sql})')})"})
    c("q_txt_20_head_tail", "s1", lambda: {"s": t.head_tail(F.col("x"), 1200, 600, 400)}, {"s": "CASE WHEN length(x) > 1200 THEN left(x, 600) || chr(10) || '[...]' || chr(10) || right(x, 400) ELSE x END"})
    c("q_txt_22_dataset", "s1", lambda: {"d": t.dataset_of(F.concat(F.col("source"), F.lit("_x_"), F.col("id")))}, {"d": "regexp_replace(source || '_x_' || id, '_[^_]*$', '')"})
    c("q_txt_25_escape", "s1", lambda: {"e": t.escape_html(F.concat(F.lit("<b>&"), F.col("problem"))), "s": t.slug(F.col("problem"))}, {"e": "replace(replace(replace('<b>&' || problem, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "s": "regexp_replace(problem, '[^A-Za-z0-9.-]', '_', 'g')"})
    c("q_txt_26_preview", "s1", lambda: {"p": F.left("thinking", F.lit(500))}, {"p": "left(thinking, 500)"})
    c("q_txt_27_cost", "s2", lambda: {"usd": F.round(t.token_count(F.col("x")) / F.lit(1e6) * F.lit(3.0), 8)}, {"usd": "round(tok / 1e6::DOUBLE * 3.0::DOUBLE, 8)"})
    c("q_txt_24_index", "s2", lambda: {"points": F.char_length(t.byte_slice(F.col("h"), F.lit(0), F.least(F.octet_length(F.col("h")), F.lit(100))))}, {"points": f"length({o.cut('h', '0', 'least(len, 100)')})::INT"})


_texts()

_DIAG = {
    "efficiency": {"restart_count": "n_restart", "word_count": "tok", "restart_density": "density"},
    "language": {"detected_language": "detected_language", "inconsistent_chunks": "off::INT", "is_mixed": "is_language_mixed"},
    "alignment": {"answer_in_trace_end": "answer_in_trace_end", "convergence": "conv", "answer_echo": "echo"},
    "structure": {"strong_markers": "CASE WHEN tok >= 10 THEN strong END", "medium_markers": "CASE WHEN tok >= 10 THEN medium END", "weak_markers": "CASE WHEN tok >= 10 THEN weak END", "effective_paragraphs": "CASE WHEN tok >= 10 THEN eff END"},
    "repetition": {"paragraph_unique_ratio": "uniq", "repeated_sentences_3plus": "thrice::INT"},
    "overthinking": {"complexity": "cplx", "trace_words": "tok", "expected_max": "expected", "ratio": "ratio"},
    "verification": {"late_explicit": "le", "late_implicit": "li", "mid_explicit": "me", "mid_implicit": "mi", "has_verification": "has_self_verification"},
    "length": {"word_count": "tok"},
    "accuracy_efficiency": {"accurate": "CASE WHEN expected_answer IS NOT NULL THEN accurate END", "token_efficiency": "CASE WHEN expected_answer IS NOT NULL THEN te END"},
}
_FLOATS = {"restart_density", "effective_paragraphs", "paragraph_unique_ratio", "complexity", "expected_max", "ratio", "token_efficiency"}


def _dims() -> None:
    for i, d in enumerate(DIMENSIONS):
        diag = _DIAG[d.key]

        def run(spark: SparkSession, sf: str, d=d, diag=diag) -> DataFrame:
            s = F.col(f"_d_{d.key}")
            return dimensions(traces(spark, sf), keys=(d.key,)).select("id", r4(s["score"]).alias("score"), *((r4(s[k]) if k in _FLOATS else s[k]).alias(k) for k in diag))

        query(f"q_dim_{i}_{d.key}", o.over_scored(f"SELECT id, {o.r4(d.column)} AS score, {', '.join(f'{o.r4(v) if k in _FLOATS else v} AS {k}' for k, v in diag.items())} FROM scored"))(run)


_dims()

SCORES = [d.column for d in DIMENSIONS if d.key != "accuracy_efficiency"]


@query("q_dim_9_composite", o.over_scored(f"SELECT id, {o.r4('raw_score')} AS raw_score FROM scored"))
def composite_(spark: SparkSession, sf: str) -> DataFrame:
    return score(traces(spark, sf)).select("id", r4(F.col("raw_score")).alias("raw_score"))


@query("q_dim_10_calibrate", f"SELECT k, {o.r4(o.calibrate('raw'))} AS p FROM (SELECT range AS k, (60 + range * 0.01)::FLOAT AS raw FROM range(0, 4100))")
def calibrate_(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(4100).select(F.col("id").alias("k"), r4(calibrate((F.lit(60) + F.col("id") * F.lit(0.01)).cast("float"))).alias("p"))


@query("q_dim_11_scored", o.over_scored(f"SELECT id, problem, md5(thinking) AS thinking, answer, {', '.join(f'{o.r4(c)} AS {c}' for c in ('quality_score', 'raw_score', *SCORES))}, tok AS thinking_word_count, n_restart AS restart_count, detected_language, has_self_verification, is_language_mixed, answer_in_trace_end FROM scored"))
def scored_(spark: SparkSession, sf: str) -> DataFrame:
    s = score(traces(spark, sf))
    return s.withColumns({c: r4(F.col(c)) for c in ("quality_score", "raw_score", *SCORES)} | {"thinking": F.md5("thinking")})


_LONG = " UNION ALL ".join(f"SELECT id, '{d.name}' AS name, {o.r4(d.column)} AS score, {w} AS weight FROM scored" for d, w in zip(DIMENSIONS, ("0.2", "0.12", "0.18", "0.1", "0.15", "0.1", "0.08", "0.07", "0.0"), strict=True))


@query("q_dim_12_detailed", o.over_scored(f"SELECT id, name, score, weight::DOUBLE AS weight FROM ({_LONG})"))
def detailed_(spark: SparkSession, sf: str) -> DataFrame:
    return score_detailed(traces(spark, sf)).select("id", F.explode_outer("scores").alias("s")).select("id", "s.name", r4(F.col("s.score")).alias("score"), r4(F.col("s.weight")).alias("weight"))


@query("q_txt_28_bands", o.over_scored("SELECT id, CASE WHEN quality_score < 50 THEN 'red' WHEN quality_score < 75 THEN 'amber' ELSE 'green' END AS band FROM scored"))
def bands_(spark: SparkSession, sf: str) -> DataFrame:
    return score(traces(spark, sf)).select("id", t.band(F.col("quality_score")).alias("band"))


@query("q_txt_complexity", o.over_scored(f"SELECT id, {o.r4('cplx')} AS c FROM s4"))
def complexity_(spark: SparkSession, sf: str) -> DataFrame:
    return traces(spark, sf).select("id", r4(complexity(F.col("problem"))).alias("c"))


@query("q_src_20_host", "SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '^[^:/?#]*://', ''), '^[^/?#]*'), '^.*@', '') AS host FROM pages")
def host_(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.host_of(F.col("url")).alias("host"))
