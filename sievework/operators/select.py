"""Filters, rankings and reports over scored traces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from .dimensions import DIMENSIONS
from .order import first_rows, quantiles, running

#: The eight dimensions of a scored trace.
SHOWN = tuple(d.column for d in DIMENSIONS if d.key != "accuracy_efficiency")
ISSUES = {"efficiency_score": 50, "language_score": 70, "answer_alignment_score": 50, "repetition_score": 50, "overthinking_score": 50, "verification_score": 40}


def gates(df: DataFrame, min_efficiency: float | None = None, min_language: float | None = None) -> DataFrame:
    for column, least in (("efficiency_score", min_efficiency), ("language_score", min_language)):
        if least is not None:
            df = df.filter(F.col(column) >= least)
    return df


def at_least(scored: DataFrame, min_score: float = 70.0, **limits: float | None) -> DataFrame:
    """Rows of a quality of at least ``min_score`` that pass the gates."""
    return gates(scored, **limits).filter(F.col("quality_score") >= min_score)


def how_many(n: int, percent: float) -> int:
    """``percent`` of ``n``, halves rounded up."""
    if not 0 <= percent <= 100:
        raise ArgumentError(f"percent must be from 0 to 100, not {percent}")
    return math.floor(n * percent / 100 + 0.5)


def top_percent(scored: DataFrame, percent: float, **limits: float | None) -> DataFrame:
    """The best ``percent`` of the rows that pass the gates, by quality, ties by id; in no order.

    Counts find the last score that stays and, among rows that have it, the last id; the rest is a filter.
    """
    passed = gates(scored, **limits)
    return first_rows(passed, -F.col("quality_score").cast("double"), "id", how_many(passed.count(), percent))


def ranked(scored: DataFrame) -> DataFrame:
    """(id, n): the place of every row by quality, ties by id. A range sort; each partition counts on from the sizes of those before it."""
    rows = scored.orderBy(F.desc("quality_score"), "id").select("id").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1))
    return scored.sparkSession.createDataFrame(rows, "id string, n long")


def removed(scored: DataFrame, min_score: float = 70.0) -> DataFrame:
    """One row: how many rows the threshold removes, and what per cent."""
    gone = F.count_if(F.col("quality_score") < min_score)
    return scored.agg(F.count("*").alias("total"), gone.alias("removed"), F.round(gone * 100.0 / F.count("*"), 4).alias("percent"))


def sweep(df: DataFrame, key: str, correct: str = "correct", descending: bool = True, percents: tuple[int, ...] = tuple(range(90, 0, -10)), partitions: str | None = None) -> DataFrame:
    """For each retention: rows kept by ``key``, and the accuracy of what is kept and dropped.

    Keys are ranked through counts per distinct value, so no task sorts all rows.
    """
    order = F.desc("k") if descending else F.asc("k")
    grouped = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("good"))
    placed = running(grouped, (), [order], {"before": F.col("n")})
    totals = grouped.agg(F.sum("n").alias("total"), F.sum("good").alias("all_good"))
    pct = F.explode_outer(F.array(*map(F.lit, percents))).alias("percent")
    cuts = totals.select("*", pct).withColumn("keep", F.bround(F.col("total") * F.col("percent") / 100, 0).cast("long"))
    # a value that the cut divides counts by its share
    part = F.greatest(F.least(F.col("keep") - F.col("before"), F.col("n")), F.lit(0))
    kept = placed.join(F.broadcast(cuts)).groupBy("percent", "keep", "total", "all_good").agg(F.sum(part * F.col("good") / F.col("n")).alias("kept_good"))
    return kept.select("percent", "keep", F.round(F.col("kept_good") / F.col("keep"), 6).alias("kept_accuracy"), F.round((F.col("all_good") - F.col("kept_good")) / (F.col("total") - F.col("keep")), 6).alias("dropped_accuracy"))


def random_keep(df: DataFrame, k: int, replicate: int) -> DataFrame:
    """``k`` rows in the order of a hash of id and replicate: a random drop that every engine repeats."""
    digest = F.md5(F.concat_ws(":", F.col("id"), F.lit(str(replicate))))
    # its first 48 bits are a number; only rows that agree in them are told apart by the rest
    kept = first_rows(df.withColumn("_digest", F.concat(digest, F.lit(" "), F.col("id"))), F.conv(F.left("_digest", F.lit(12)), 16, 10).cast("double"), "_digest", k)
    return kept.drop("_digest")


def above_quantile(scored: DataFrame, q: float = 0.7, column: str = "quality_score") -> DataFrame:
    """Rows not below the interpolated quantile."""
    (cut,) = quantiles(scored, column, [q])
    return scored.filter(F.col(column).cast("double") >= F.lit(cut))


def _issues() -> Column:
    return F.array_compact(F.array(*(F.when(F.col(c) < limit, F.lit(c.removesuffix("_score"))) for c, limit in ISSUES.items())))


def worst(scored: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rows of lowest quality with what is wrong with them; ties by id."""
    return scored.orderBy("quality_score", "id").limit(n).select("id", "quality_score", _issues().alias("issues"), F.left("thinking", F.lit(500)).alias("preview"))


def summary(scored: DataFrame) -> DataFrame:
    good, mixed, n = F.count_if(F.col("quality_score") >= 70), F.count_if("is_language_mixed"), F.count("*")
    return scored.agg(n.alias("n"), F.avg(F.col("quality_score").cast("double")).alias("avg_quality"), good.alias("good"), (good * 100.0 / n).alias("good_pct"), mixed.alias("mixed"), (mixed * 100.0 / n).alias("mixed_pct"))


def dimension_stats(scored: DataFrame, columns: tuple[str, ...] = ("quality_score", *SHOWN)) -> DataFrame:
    """One row per score: average, least, largest and the share of 80 or more. One pass over the rows."""
    long = scored.select(F.explode_outer(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s"))
    return long.groupBy("s.dimension").agg(F.avg("s.v").alias("avg"), F.min("s.v").alias("min"), F.max("s.v").alias("max"), (F.count_if(F.col("s.v") >= 80) * 100.0 / F.count("*")).alias("pct_80"))


def issue_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if("is_language_mixed").alias("mixed"), F.count_if(~F.col("has_self_verification")).alias("unverified"), F.count_if(F.col("overthinking_score") < 50).alias("overthinking"), F.count_if(F.col("answer_alignment_score") < 50).alias("misaligned"))


def recommendation(scored: DataFrame) -> DataFrame:
    low = F.count_if(F.col("quality_score") < 70)
    return scored.agg(low.alias("removable"), (F.count("*") - low).alias("clean"))


def systematic(scored: DataFrame, every: int, by: str = "domain") -> DataFrame:
    """Every ``every``-th row by quality within each value of ``by``."""
    return running(scored, (by,), [F.desc("quality_score"), F.asc("id")], {"_n": F.lit(1)}).filter((F.col("_n") + 1) % every == 0).drop("_n")
