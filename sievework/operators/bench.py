"""Benchmark runs: tasks from samples, metrics, leaderboards and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

SORTS = {
    "accuracy": [F.desc, "accuracy", "tokens_per_correct"], "quality": [F.desc, "quality"], "tokens": [F.asc_nulls_last, "tokens_per_correct"], "cost": [F.asc_nulls_last, "cost_per_1k"],
}


def fold(samples: DataFrame) -> DataFrame:
    """One row per task from samples (task_id, sample_idx, correct, quality, thinking, answer, completion_tokens, error)."""
    ok = F.col("error").isNull()
    guess = t.token_count(F.col("thinking")) + t.token_count(F.col("answer"))
    rows = samples.withColumn("_tokens", F.when(ok, F.coalesce(F.col("completion_tokens"), guess)))
    return rows.groupBy("task_id").agg(
        F.coalesce(F.bool_or(ok & F.col("correct")), F.lit(False)).alias("correct"), F.avg(F.when(ok, F.col("quality"))).alias("quality"), F.coalesce(F.sum("_tokens"), F.lit(0)).alias("tokens"),
        F.bool_or(ok & F.col("completion_tokens").isNull()).alias("tokens_estimated"), F.count("*").alias("samples"), F.count_if(ok & F.col("correct")).alias("samples_correct"),
        F.when(F.count_if(ok) == 0, F.min_by("error", "sample_idx")).alias("error"),
    )


def metrics(tasks: DataFrame, price_per_mtok: float | None = None) -> DataFrame:
    """Attempted, scored and errored tasks, accuracy, quality, tokens per correct task and cost per thousand of them."""
    ok = F.col("error").isNull()
    right, scored, tokens = F.count_if(ok & F.col("correct")), F.count_if(ok), F.sum(F.when(ok, F.col("tokens")))
    cost = F.try_divide(tokens / F.lit(1e6) * F.lit(price_per_mtok).cast("double") * 1000, right)
    return tasks.agg(F.count("*").alias("n_attempted"), scored.alias("n_scored"), F.count_if(~ok).alias("n_errored"), F.coalesce(F.try_divide(right, scored), F.lit(0.0)).alias("accuracy"), F.avg(F.when(ok, F.col("quality"))).alias("quality"), F.try_divide(tokens, right).alias("tokens_per_correct"), cost.alias("cost_per_1k"))


def judge_band(tasks: DataFrame, low: float, high: float) -> DataFrame:
    """Tasks without an error whose quality lies in a closed band."""
    return tasks.filter(F.col("error").isNull() & F.col("quality").between(low, high))


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of each set, hash, model and number of samples; of equally new ones the first by path."""
    w = Window.partitionBy("set_name", "set_sha", "model", "samples").orderBy(F.desc("generated_at"), "path")
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def leaderboard(entries: DataFrame, by: str = "accuracy", task_set: str | None = None) -> DataFrame:
    """Entries ranked within each set and hash; missing numbers come last, models decide ties."""
    rows = latest(entries if task_set is None else entries.filter(F.col("set_name") == task_set))
    how, first, *more = SORTS[by]
    order: list[Column] = [how(first), *(F.asc_nulls_last(c) for c in more), F.asc("model")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("set_name", "set_sha").orderBy(*order)))


def rendered(board: DataFrame) -> DataFrame:
    """A leaderboard's cells as text; a dash for what is missing."""
    cell = lambda c: F.coalesce(c, F.lit("-"))
    return board.select("set_name", "set_sha", "rank", "model", F.format_string("%.1f", F.col("accuracy") * 100).alias("accuracy"), F.format_string("%.1f", "quality").alias("quality"), cell(F.when(F.col("tokens_per_correct").isNotNull(), F.format_string("%.0f", "tokens_per_correct"))).alias("tokens"), F.when(F.col("generated_at") > 0, F.date_format(F.timestamp_seconds("generated_at"), "yyyy-MM-dd")).otherwise("-").alias("date"))


def problems(entries: DataFrame, bundled: DataFrame | None = None) -> DataFrame:
    """What is wrong with each entry: (path, problem), one row each."""
    bad = lambda cond, text: F.when(F.coalesce(cond, F.lit(True)), F.lit(text))
    rows = entries
    checks = [
        bad(F.col("schema_version") != "1", "schema version"), bad(F.trim("model") == "", "model"), bad(F.trim("set_name") == "", "set name"), bad(~F.regexp_like("set_sha", F.lit("^[0-9a-f]{64}$")), "set hash"),
        bad(~F.col("accuracy").between(0, 1) | F.isnan("accuracy"), "accuracy"), bad(~F.col("quality").between(0, 100) | F.isnan("quality"), "quality"), bad(F.col("samples") < 1, "samples"), F.when((F.col("n_attempted") > 0) & (F.col("n_scored") > F.col("n_attempted")), F.lit("scored tasks")),
    ]
    if bundled is not None:
        rows = rows.join(F.broadcast(bundled.select(F.col("name").alias("set_name"), F.col("sha").alias("_sha"))), "set_name", "left")  # the sets that ship with a release
        checks.append(F.when(F.col("_sha") != F.col("set_sha"), F.lit("bundled hash")))
    return rows.select("path", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two detailed scores (name, score) side by side: what one side lacks is a dash, the difference has a sign."""
    left, right = a.select("name", F.col("score").alias("a")), b.select("name", F.col("score").alias("b"))
    text = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.1f", c)), F.lit("-"))
    return left.join(right, "name", "full_outer").select("name", text("a").alias("a"), text("b").alias("b"), F.coalesce(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.format_string("%+.1f", F.col("b") - F.col("a"))), F.lit("-")).alias("delta"))
