"""Scoring: composite, percentile and flags for every trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.knots import KNOTS
from .dimensions import DIMENSIONS, f32, minus, over, plus, stage, times

INPUT = ("id", "problem", "thinking", "answer", "domain", "source", "expected_answer")
#: The 20 columns of a scored trace, in order.
OUTPUT = (
    "id", "problem", "thinking", "answer", "quality_score", "raw_score", "efficiency_score", "language_score", "answer_alignment_score", "structural_score",
    "repetition_score", "overthinking_score", "verification_score", "length_score", "thinking_word_count", "restart_count", "detected_language",
    "has_self_verification", "is_language_mixed", "answer_in_trace_end",
)


def composite(scores: dict[str, Column], config: Config) -> Column:
    """The weighted sum in single precision, in the dimensions' order, from 0 to 100."""
    parts = [times(scores[d.key], float(getattr(config.weights, d.key))) for d in DIMENSIONS]
    return F.least(F.greatest(reduce(plus, parts, f32(0.0)), f32(0.0)), f32(100.0))


def _table(knots: tuple[float, ...]) -> Column:
    return F.expr("array(" + ", ".join(f"cast({k} as float)" for k in knots) + ")")


def calibrate(raw: Column, knots: tuple[float, ...] = KNOTS) -> Column:
    """The percentile of a composite in the frozen reference distribution."""
    table = _table(knots)
    # one entry for the bracket around raw: its number and both ends
    bracket = F.transform(F.array(F.size(F.filter(table, lambda k: k < raw))), lambda hi: F.struct((hi - 1).alias("lo"), F.get(table, hi - 1).alias("below"), F.get(table, hi).alias("above")))

    def place(x: Column) -> Column:
        span = minus(x["above"], x["below"])
        inner = plus(f32(x["lo"]), over(minus(raw, x["below"]), span))
        return F.when(span <= F.lit(2.0**-23), f32(x["lo"])).otherwise(F.least(F.greatest(inner, f32(0.0)), f32(100.0)))

    finite = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    return F.when(~finite | (raw <= f32(knots[0])), f32(0.0)).when(raw >= f32(knots[-1]), f32(100.0)).otherwise(F.get(F.transform(bracket, place), F.lit(0)))


def with_inputs(df: DataFrame) -> DataFrame:
    """``df`` with every input column there: missing texts are empty, missing optional ones null."""
    for c in INPUT:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None if c in ("domain", "source", "expected_answer") else "").cast("string"))
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("problem", "thinking", "answer")})


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it lies in fewer files than there are: a text costs far more to score than to move. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if not df.isStreaming and 0 < len(df.inputFiles()) < cores else df


def dimensions(df: DataFrame, config: Config | None = None, keys: tuple[str, ...] = tuple(d.key for d in DIMENSIONS)) -> DataFrame:
    """``df`` with a struct per dimension in ``keys``: its score and diagnostics. What others need is not computed."""
    config = (config or Config()).sane()
    chosen = [d for d in DIMENSIONS if d.key in keys]
    staged = stage(with_inputs(spread(df)), config, tuple(d.key for d in chosen))
    made = {f"_d_{d.key}": F.struct(*(v.alias(k) for k, v in d.make(config).items())) for d in chosen}
    return staged.withColumns(made)


def score(df: DataFrame, config: Config | None = None, keep_extra: bool = False) -> DataFrame:
    """The scored trace of each row: OUTPUT columns, and the other columns of ``df`` too if ``keep_extra``. A narrow projection; only few files are spread over the cores first."""
    config = config or Config()
    d = dimensions(df, config)
    raw = composite({x.key: F.col(f"_d_{x.key}.score") for x in DIMENSIONS}, config)
    d = d.withColumn("raw_score", raw).withColumn("quality_score", calibrate(F.col("raw_score")))
    flat = {x.column: F.col(f"_d_{x.key}.score") for x in DIMENSIONS} | {
        "thinking_word_count": F.col("_tokens"), "restart_count": F.col("_d_efficiency.restart_count"), "detected_language": F.col("_d_language.detected_language"),
        "has_self_verification": F.col("_d_verification.has_verification"), "is_language_mixed": F.col("_d_language.is_mixed"), "answer_in_trace_end": F.col("_d_alignment.answer_in_trace_end"),
    }
    extra = [c for c in df.columns if c not in OUTPUT and c not in flat] if keep_extra else []
    return d.select(*((flat[c].alias(c) if c in flat else F.col(c)) for c in OUTPUT), *extra)


def score_detailed(df: DataFrame, config: Config | None = None) -> DataFrame:
    """id, the extracted thinking, raw and quality score, and an array of all nine dimensions: name, score, weight and diagnostics as a map of strings."""
    config = config or Config()
    d = dimensions(df, config)
    rows = []
    for x in DIMENSIONS:
        names = [k for k in x.make(config.sane()) if k != "score"]
        pairs = F.map_filter(F.create_map(*(y for k in names for y in (F.lit(k), F.col(f"_d_{x.key}.{k}").cast("string")))), lambda k, v: v.isNotNull())
        rows.append(F.struct(F.lit(x.name).alias("name"), F.col(f"_d_{x.key}.score").alias("score"), f32(float(getattr(config.weights, x.key))).alias("weight"), pairs.alias("diagnostics")))
    raw = composite({x.key: F.col(f"_d_{x.key}.score") for x in DIMENSIONS}, config)
    return d.withColumn("raw_score", raw).select("id", F.col("_x").alias("extracted"), "raw_score", calibrate(F.col("raw_score")).alias("quality_score"), F.array(*rows).alias("scores"))
