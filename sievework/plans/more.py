"""Queries of filters, rankings, aggregates, joins, spans and benchmark tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import bench, select, spans, stats
from ..operators.score import score, spread
from . import oracle as o
from .core import query, r4, table
from .traces import traces

_SCORED: dict[tuple[str, str], DataFrame] = {}
SHOWN = select.SHOWN
_ALL = ("quality_score", *SHOWN)
_S = ", ".join(f"{c}::DOUBLE AS {c}" for c in ("quality_score", "raw_score", *SHOWN))
#: Scored traces with labels: of an id that is labelled twice the last label counts.
_LABELLED = f"lab AS (SELECT s.id, s.problem_id, s.model, s.domain, s.tok, {_S}, l.quality = 1 AS correct FROM scored s JOIN labels l ON s.id = l.doc_id::VARCHAR)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores without the long texts, kept for the queries of one session that read the same folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SCORED:
        df = score(traces(spark, sf), keep_extra=True).drop("problem", "answer").withColumn("thinking", F.left("thinking", F.lit(500)))
        _SCORED[key] = df.persist()
    return _SCORED[key]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("correct"))
    return scored(spark, sf).join(labels, "id").withColumns({c: F.col(c).cast("double") for c in ("quality_score", "raw_score", *SHOWN)})


def known(spark: SparkSession, sf: str) -> DataFrame:
    """``labelled`` without the scores, for queries that read none: nothing has to be scored."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("correct"))
    return traces(spark, sf).join(labels, "id")


def add(name: str, sql: str, f) -> None:
    query(name, sql)(f)


def on_scored(name: str, body: str, f, *ctes: str) -> None:
    add(name, o.over_scored(body, *ctes), lambda spark, sf: f(scored(spark, sf)))


_D = lambda c: F.round(F.col(c), 4).alias(c)
_P = "(SELECT * FROM scored WHERE efficiency_score >= 60 AND language_score >= 50)"
on_scored("q_flt_1_min_score", f"SELECT id, {o.r4('quality_score')} AS q FROM scored WHERE quality_score >= 40", lambda s: select.at_least(s, 40).select("id", r4(F.col("quality_score")).alias("q")))
on_scored("q_flt_2_gates", f"SELECT id FROM {_P}", lambda s: select.gates(s, 60, 50).select("id"))
on_scored("q_flt_3_top_percent", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY quality_score DESC, id) AS n, count(*) OVER () AS total FROM {_P}) WHERE n <= floor(total * 30 / 100.0 + 0.5)", lambda s: select.top_percent(s, 30, min_efficiency=60, min_language=50).select("id"))
on_scored("q_flt_4_removed", "SELECT count(*) AS total, count(*) FILTER (quality_score < 70) AS removed, round(count(*) FILTER (quality_score < 70) * 100.0::DOUBLE / count(*), 4) AS percent FROM scored", lambda s: select.removed(s).withColumn("percent", F.col("percent").cast("double")))
on_scored("q_flt_6_random", "SELECT id FROM scored ORDER BY md5(id || ':3'), id LIMIT 200", lambda s: select.random_keep(s.select("id"), 200, 3))
on_scored("q_flt_9_quantile", "SELECT id FROM scored WHERE quality_score::DOUBLE >= (SELECT quantile_cont(quality_score::DOUBLE, 0.7) FROM scored)", lambda s: select.above_quantile(s).select("id"))
on_scored("q_agg_1_summary", "SELECT count(*) AS n, round(avg(quality_score::DOUBLE), 4) AS avg_quality, count(*) FILTER (quality_score >= 70) AS good, round(count(*) FILTER (quality_score >= 70) * 100.0::DOUBLE / count(*), 4) AS good_pct, count(*) FILTER (is_language_mixed) AS mixed, round(count(*) FILTER (is_language_mixed) * 100.0::DOUBLE / count(*), 4) AS mixed_pct FROM scored", lambda s: select.summary(s).withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("avg_quality", "good_pct", "mixed_pct")}))
_LONG = "long_ AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS dimension, {c}::DOUBLE AS v FROM scored" for c in _ALL) + ")"
on_scored("q_agg_2_dimensions", "SELECT dimension, round(avg(v), 4) AS avg, round(min(v), 4) AS min, round(max(v), 4) AS max, round(count(*) FILTER (v >= 80) * 100.0::DOUBLE / count(*), 4) AS pct_80 FROM long_ GROUP BY 1", lambda s: select.dimension_stats(s).withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("avg", "min", "max", "pct_80")}), _LONG)
on_scored("q_agg_3_issues", "SELECT count(*) FILTER (is_language_mixed) AS mixed, count(*) FILTER (NOT has_self_verification) AS unverified, count(*) FILTER (overthinking_score < 50) AS overthinking, count(*) FILTER (answer_alignment_score < 50) AS misaligned FROM scored", select.issue_counts)
on_scored("q_agg_4_recommendation", "SELECT count(*) FILTER (quality_score < 70) AS removable, count(*) FILTER (NOT quality_score < 70) AS clean FROM scored", select.recommendation)
on_scored("q_agg_5_report_dimensions", "SELECT dimension, CASE WHEN avg(v) >= 80 THEN 'good' WHEN avg(v) >= 50 THEN 'okay' ELSE 'bad' END AS css FROM long_ WHERE dimension <> 'quality_score' GROUP BY 1", lambda s: select.dimension_stats(s, SHOWN).select("dimension", t.css_band(F.col("avg")).alias("css")), _LONG)
on_scored("q_agg_17_knots", "SELECT p::INT AS p, round(ks[p + 1], 4) AS knot FROM (SELECT quantile_cont(raw_score::DOUBLE, [" + ", ".join(str(p / 100) for p in range(101)) + "]) AS ks FROM scored), range(101) t(p)", lambda s: stats.fit_knots(s).select("p", F.round("knot", 4).alias("knot")))
on_scored("q_agg_18_at_least_70", "SELECT round(avg((raw_score >= 70)::INT), 6) AS share FROM scored", lambda s: s.agg(F.round(F.avg((F.col("raw_score") >= 70).cast("int")), 6).alias("share")))
on_scored("q_srt_1_order", "SELECT id, row_number() OVER (ORDER BY quality_score DESC, id) AS n FROM scored ORDER BY n LIMIT 100", lambda s: s.orderBy(F.desc("quality_score"), "id").limit(100).withColumn("n", F.row_number().over(Window.orderBy(F.desc("quality_score"), "id")).cast("long")).select("id", "n"))
on_scored("q_srt_1_full", "SELECT id, row_number() OVER (ORDER BY quality_score DESC, id) AS n FROM scored", select.ranked)
_IS = " || ".join(f"CASE WHEN {c} < {k} THEN '{c.removesuffix('_score')},' ELSE '' END" for c, k in select.ISSUES.items())
on_scored("q_srt_2_worst", f"SELECT id, {o.r4('quality_score')} AS q, rtrim({_IS}, ',') AS issues, left(thinking, 500) AS preview FROM scored ORDER BY quality_score, id LIMIT 10", lambda s: select.worst(s).select("id", r4(F.col("quality_score")).alias("q"), F.array_join("issues", ",").alias("issues"), "preview"))
on_scored("q_srt_8_lowest", "SELECT id, left(replace(thinking, chr(10), ' '), 280) AS preview FROM scored ORDER BY quality_score, id LIMIT 3", lambda s: s.orderBy("quality_score", "id").limit(3).select("id", F.left(F.replace(F.col("thinking"), F.lit("\n"), F.lit(" ")), F.lit(280)).alias("preview")))
on_scored("q_win_8_systematic", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY domain ORDER BY quality_score DESC, id) AS n FROM scored) WHERE n % 25 = 0", lambda s: select.systematic(s.select("id", "domain", "quality_score"), 25).select("id"))
on_scored("q_set_1_union", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id FROM scored UNION ALL SELECT id FROM scored WHERE quality_score < 20)", lambda s: s.select("id").unionByName(s.filter("quality_score < 20").select("id")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")))
on_scored("q_set_3_dropped", "SELECT id FROM scored EXCEPT SELECT id FROM scored WHERE quality_score >= 40", lambda s: s.join(s.filter("quality_score >= 40").select("id"), "id", "left_anti").select("id"))
on_scored("q_set_4_distinct", "SELECT DISTINCT domain FROM scored", lambda s: s.select("domain").distinct())
on_scored("q_set_5_intersect", "SELECT problem_id FROM scored WHERE model = 'A' INTERSECT SELECT problem_id FROM scored WHERE model = 'B'", lambda s: s.filter("model = 'A'").select("problem_id").intersect(s.filter("model = 'B'").select("problem_id")))
on_scored("q_jon_12_semi", "SELECT id FROM scored WHERE id IN (SELECT id FROM scored WHERE quality_score >= 40)", lambda s: s.join(s.filter("quality_score >= 40").select("id"), "id", "left_semi").select("id"))


def on_labelled(name: str, body: str, f, *ctes: str) -> None:
    add(name, o.over_scored(body, _LABELLED, *ctes), lambda spark, sf: f(labelled(spark, sf)))


add("q_jon_1_labels", o.over_scored("SELECT id, correct FROM lab", _LABELLED), lambda spark, sf: known(spark, sf).select("id", "correct"))
on_labelled("q_flt_5_sweep", """SELECT percent::INT AS percent, keep, round(kept_good / keep, 6) AS kept_accuracy, round((all_good - kept_good) / (total - keep), 6) AS dropped_accuracy FROM (
    SELECT percent, keep, total, all_good, sum(greatest(least(keep - before, n), 0) * good / n::DOUBLE) AS kept_good FROM (
      SELECT g.*, coalesce(sum(n) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total, sum(good) OVER () AS all_good
      FROM (SELECT quality_score AS k, count(*) AS n, sum(correct::INT) AS good FROM lab GROUP BY 1) g) p,
      LATERAL (SELECT percent, round_even(total * percent / 100.0::DOUBLE, 0)::BIGINT AS keep FROM unnest([90, 80, 70, 60, 50, 40, 30, 20, 10]) u(percent)) c GROUP BY 1, 2, 3, 4)""", lambda d: select.sweep(d, "quality_score"))
on_labelled("q_flt_agg_25_lift", "SELECT quality_score >= 40 AS kept, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM lab GROUP BY 1", lambda d: d.groupBy((F.col("quality_score") >= 40).alias("kept")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy")))
_LL = "ll AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {v} AS v, correct FROM lab" for c, v in [*((c, c) for c in _ALL), ("length", "-tok::DOUBLE")]) + ")"
on_labelled("q_agg_12_auc", """SELECT dimension, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM (
    SELECT *, coalesce(sum(neg) OVER (PARTITION BY dimension ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
      SELECT dimension, v, count(*) FILTER (correct) AS pos, count(*) FILTER (NOT correct) AS neg FROM ll GROUP BY 1, 2)) GROUP BY 1""", lambda d: stats.auc(stats.unpivot(d.withColumn("length", -F.col("thinking_word_count")), (*_ALL, "length"), ("correct",))).withColumn("auc", F.round("auc", 6)), _LL)
on_labelled("q_agg_11_auc", """SELECT round(sum(CASE WHEN p.quality_score > n.quality_score THEN 1 WHEN p.quality_score = n.quality_score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc
    FROM lab p, lab n WHERE p.correct AND NOT n.correct""", lambda d: stats.auc(d.withColumn("all", F.lit(1)), ("all",), "quality_score").select(F.round("auc", 6).alias("auc")))
_RANKS = "rk AS (SELECT domain, rank() OVER (PARTITION BY domain ORDER BY raw_score) + (count(*) OVER (PARTITION BY domain, raw_score) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY domain ORDER BY tok) + (count(*) OVER (PARTITION BY domain, tok) - 1) / 2.0::DOUBLE AS ry FROM (SELECT * FROM lab UNION ALL SELECT * REPLACE ('ALL' AS domain) FROM lab))"
on_labelled("q_agg_15_spearman", "SELECT domain, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(1.96::DOUBLE / sqrt(count(*) - 1), 6) AS threshold FROM rk GROUP BY 1", lambda d: stats.spearman(stats.with_all(d, "domain"), "raw_score", "thinking_word_count", ("domain",)).withColumns({c: F.round(c, 6) for c in ("rho", "threshold")}), _RANKS)
on_labelled("q_win_1_ranks", "SELECT id, rank() OVER (ORDER BY raw_score) + (count(*) OVER (PARTITION BY raw_score) - 1) / 2.0::DOUBLE AS r FROM lab", lambda d: stats.average_rank(d.select("id", "raw_score", F.lit(0).alias("g")), "raw_score", ("g",), "r").select("id", F.col("r").cast("double").alias("r")))
on_labelled("q_agg_21_pairs", "SELECT signal, count(*) FILTER (g > b) AS wins, count(*) FILTER (g < b) AS losses, count(*) FILTER (g = b) AS ties FROM pr GROUP BY 1", lambda d: stats.discordant_pairs(d, _ALL), "pp AS (SELECT problem_id, count(*) AS n, count(*) FILTER (correct) AS good, " + ", ".join(f"max(CASE WHEN correct THEN {c} END) AS g_{c}, max(CASE WHEN NOT correct THEN {c} END) AS b_{c}" for c in _ALL) + " FROM lab GROUP BY 1 HAVING count(*) = 2 AND count(*) FILTER (correct) = 1), pr AS (" + " UNION ALL ".join(f"SELECT '{c}' AS signal, g_{c} AS g, b_{c} AS b FROM pp" for c in _ALL) + ")")
on_labelled("q_agg_22_standardize", "SELECT id, round((raw_score - avg(raw_score) OVER ()) / CASE WHEN stddev_pop(raw_score) OVER () > 0 THEN stddev_pop(raw_score) OVER () ELSE 1 END, 4) AS z FROM lab", lambda d: stats.standardized(d.select("id", "raw_score"), ("raw_score",)).select("id", F.round("raw_score", 4).alias("z")))
add("q_agg_26_label_stats", o.over_scored("SELECT model, count(*) AS n, round(avg(correct::INT) * 100, 4) AS pct FROM lab GROUP BY 1", _LABELLED), lambda spark, sf: known(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")) * 100, 4).alias("pct")))
query("q_agg_19_bootstrap")(lambda spark, sf: stats.bootstrap_auc(labelled(spark, sf), "quality_score", replicates=2000))
query("q_agg_20_paired_bootstrap")(lambda spark, sf: stats.bootstrap_auc(labelled(spark, sf).withColumn("length", -F.col("thinking_word_count").cast("double")), "quality_score", replicates=2000, other="length"))
query("q_agg_23_logistic")(lambda spark, sf: stats.logistic_by_group(labelled(spark, sf), "model", SHOWN))

# spans
_PIECES = f"pc AS (SELECT id, unnest(list_concat(regexp_extract_all(x, '(?s).{{10,}}?[.!?。！？]'), list_filter([regexp_replace(x, '(?s).{{10,}}?[.!?。！？]', '', 'g')], lambda r: r <> ''))) AS piece, generate_subscripts(list_concat(regexp_extract_all(x, '(?s).{{10,}}?[.!?。！？]'), list_filter([regexp_replace(x, '(?s).{{10,}}?[.!?。！？]', '', 'g')], lambda r: r <> '')), 1) AS n FROM s1), po AS (SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, {o.normal('piece')} AS norm FROM pc), rp AS (SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY n) AS nth FROM po WHERE length(norm) >= 15)"


def _x(spark: SparkSession, sf: str) -> DataFrame:
    return spread(traces(spark, sf)).select("id", t.extract_thinking(F.col("thinking")).alias("x"))


add("q_ann_3_repetitions", o.over_scored('SELECT id, start, (start + strlen(piece))::INT AS "end", nth::INT AS nth FROM rp WHERE nth > 1', _PIECES), lambda spark, sf: spans.repetitions(_x(spark, sf)).select("id", "start", "end", "nth"))
add("q_ann_6_groups", o.over_scored("SELECT id, regexp_replace(norm, '[.!?,;:。！？，；：]+$', '') AS key, count(*) + 1 AS total, min(start) AS first FROM rp WHERE nth > 1 GROUP BY 1, 2", _PIECES), lambda spark, sf: spans.repetition_groups(_x(spark, sf)))
query("q_ann_1_spans")(lambda spark, sf: spans.annotate(spread(traces(spark, sf))))


query("q_ann_5_segments")(lambda spark, sf: spans.text_segments(spread(traces(spark, sf))))


# benchmark tables made from the documents
_SAMPLES = """samples AS (SELECT floor(doc_id / 4)::BIGINT AS task_id, (doc_id % 4)::INT AS sample_idx, doc_id % 3 = 0 AS correct, (doc_id % 101)::DOUBLE AS quality, 'a b c' AS thinking, CASE doc_id % 2 WHEN 0 THEN 'x' ELSE 'x y' END AS answer,
    CASE WHEN doc_id % 5 < 3 THEN doc_id % 900 END AS completion_tokens, CASE WHEN doc_id % 7 = 0 OR floor(doc_id / 4) % 11 = 0 THEN 'e' || (doc_id % 4)::VARCHAR END AS error FROM documents)"""
_FOLD = """fold AS (SELECT task_id, coalesce(bool_or(error IS NULL AND correct), false) AS correct, avg(CASE WHEN error IS NULL THEN quality END) AS quality,
    coalesce(sum(CASE WHEN error IS NULL THEN coalesce(completion_tokens, 3 + CASE answer WHEN 'x' THEN 1 ELSE 2 END) END), 0)::BIGINT AS tokens, bool_or(error IS NULL AND completion_tokens IS NULL) AS tokens_estimated,
    count(*) AS samples, count(*) FILTER (error IS NULL AND correct) AS samples_correct, CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN min_by(error, sample_idx) END AS error FROM samples GROUP BY 1)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.floor(d / 4).alias("task_id"), (d % 4).cast("int").alias("sample_idx"), (d % 3 == 0).alias("correct"), (d % 101).cast("double").alias("quality"), F.lit("a b c").alias("thinking"), F.when(d % 2 == 0, "x").otherwise("x y").alias("answer"),
        F.when(d % 5 < 3, d % 900).alias("completion_tokens"), F.when((d % 7 == 0) | (F.floor(d / 4) % 11 == 0), F.concat(F.lit("e"), (d % 4).cast("string"))).alias("error"),
    )


add("q_agg_7_fold", f"WITH {_SAMPLES}, {_FOLD} SELECT * REPLACE (round(quality, 4) AS quality) FROM fold", lambda spark, sf: bench.fold(samples(spark, sf)).withColumn("quality", F.round("quality", 4)))
add("q_agg_6_metrics", f"WITH {_SAMPLES}, {_FOLD} SELECT count(*) AS n_attempted, count(*) FILTER (error IS NULL) AS n_scored, count(*) FILTER (error IS NOT NULL) AS n_errored, round(count(*) FILTER (error IS NULL AND correct)::DOUBLE / count(*) FILTER (error IS NULL), 6) AS accuracy, round(avg(CASE WHEN error IS NULL THEN quality END), 6) AS quality, round(sum(CASE WHEN error IS NULL THEN tokens END)::DOUBLE / count(*) FILTER (error IS NULL AND correct), 6) AS tokens_per_correct, round(sum(CASE WHEN error IS NULL THEN tokens END)::DOUBLE / 1e6 * 3 * 1000 / count(*) FILTER (error IS NULL AND correct), 6) AS cost_per_1k FROM fold", lambda spark, sf: bench.metrics(bench.fold(samples(spark, sf)), 3.0).withColumns({c: F.round(c, 6) for c in ("accuracy", "quality", "tokens_per_correct", "cost_per_1k")}))
add("q_flt_7_band", f"WITH {_SAMPLES}, {_FOLD} SELECT task_id FROM fold WHERE error IS NULL AND quality BETWEEN 20 AND 60", lambda spark, sf: bench.judge_band(bench.fold(samples(spark, sf)), 20, 60).select("task_id"))
_ENTRIES = """entries AS (SELECT 'r/' || lpad(doc_id::VARCHAR, 8, '0') || '.json' AS path, CASE WHEN doc_id % 50 = 7 THEN '2' ELSE '1' END AS schema_version, CASE WHEN doc_id % 60 = 9 THEN ' ' ELSE 'm' || (doc_id % 13)::VARCHAR END AS model, 'set' || (doc_id % 3)::VARCHAR AS set_name,
    CASE WHEN doc_id % 40 = 1 THEN 'xyz' ELSE repeat((doc_id % 2)::VARCHAR, 64) END AS set_sha, (doc_id % 105) / 100.0::DOUBLE AS accuracy, (doc_id % 102)::DOUBLE AS quality, (doc_id % 4)::INT AS samples, (doc_id % 9)::INT AS n_attempted, (doc_id % 10)::INT AS n_scored,
    CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 700)::DOUBLE END AS tokens_per_correct, CASE WHEN doc_id % 8 <> 0 THEN (doc_id % 70)::DOUBLE END AS cost_per_1k, CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 1700000000 + (doc_id % 97) * 86400 END AS generated_at FROM documents)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("r/"), F.lpad(d.cast("string"), 8, "0"), F.lit(".json")).alias("path"), F.when(d % 50 == 7, "2").otherwise("1").alias("schema_version"), F.when(d % 60 == 9, " ").otherwise(F.concat(F.lit("m"), (d % 13).cast("string"))).alias("model"), F.concat(F.lit("set"), (d % 3).cast("string")).alias("set_name"),
        F.when(d % 40 == 1, "xyz").otherwise(F.repeat((d % 2).cast("string"), F.lit(64))).alias("set_sha"), ((d % 105) / 100).alias("accuracy"), (d % 102).cast("double").alias("quality"), (d % 4).cast("int").alias("samples"), (d % 9).cast("int").alias("n_attempted"), (d % 10).cast("int").alias("n_scored"),
        F.when(d % 6 != 0, (d % 700).cast("double")).alias("tokens_per_correct"), F.when(d % 8 != 0, (d % 70).cast("double")).alias("cost_per_1k"), F.when(d % 31 == 0, F.lit(0)).otherwise(1700000000 + (d % 97) * 86400).alias("generated_at"),
    )


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_name, set_sha, model, samples ORDER BY generated_at DESC, path) AS n FROM entries) WHERE n = 1)"
add("q_agg_27_latest", f"WITH {_ENTRIES}, {_LATEST} SELECT path, model FROM latest", lambda spark, sf: bench.latest(entries(spark, sf)).select("path", "model"))
for _by, _order in {"accuracy": "accuracy DESC, tokens_per_correct ASC NULLS LAST, model", "quality": "quality DESC, model", "tokens": "tokens_per_correct ASC NULLS LAST, model", "cost": "cost_per_1k ASC NULLS LAST, model"}.items():
    add(f"q_srt_4_by_{_by}", f"WITH {_ENTRIES}, {_LATEST} SELECT set_name, set_sha, rank, max({_by if _by in ('accuracy', 'quality') else 'tokens_per_correct' if _by == 'tokens' else 'cost_per_1k'}) AS v FROM (SELECT *, row_number() OVER (PARTITION BY set_name, set_sha ORDER BY {_order})::INT AS rank FROM latest) GROUP BY 1, 2, 3", lambda spark, sf, by=_by: bench.leaderboard(entries(spark, sf), by).groupBy("set_name", "set_sha", "rank").agg(F.max({"tokens": "tokens_per_correct", "cost": "cost_per_1k"}.get(by, by)).alias("v")))
_CHECKS = {"schema version": "schema_version <> '1'", "model": "trim(model) = ''", "set name": "trim(set_name) = ''", "set hash": "NOT regexp_full_match(set_sha, '[0-9a-f]{64}')", "accuracy": "NOT accuracy BETWEEN 0 AND 1", "quality": "NOT quality BETWEEN 0 AND 100", "samples": "samples < 1", "scored tasks": "n_attempted > 0 AND n_scored > n_attempted"}
add("q_val_1_problems", f"WITH {_ENTRIES} " + " UNION ALL ".join(f"SELECT path, '{k}' AS problem FROM entries WHERE {v}" for k, v in _CHECKS.items()), lambda spark, sf: bench.problems(entries(spark, sf)))
add("q_snk_7_rendered", f"WITH {_ENTRIES} SELECT path, printf('%.1f', quality) AS quality, CASE WHEN tokens_per_correct IS NULL THEN '-' ELSE printf('%.0f', tokens_per_correct) END AS tokens, CASE WHEN generated_at > 0 THEN strftime(to_timestamp(generated_at) AT TIME ZONE 'UTC', '%Y-%m-%d') ELSE '-' END AS date FROM entries", lambda spark, sf: bench.rendered(entries(spark, sf).withColumns({"set_name": F.col("path"), "rank": F.lit(1)})).select(F.col("set_name").alias("path"), "quality", "tokens", "date"))
