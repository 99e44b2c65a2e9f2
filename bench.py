"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework.operators.score import OUTPUT, score
from sievework.operators.select import at_least, dimension_stats, top_percent
from sievework.operators.stats import auc, unpivot
from sievework.ship import ship

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    traces = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("What follows?").alias("problem"), F.col("text").alias("thinking"), F.lit("4").alias("answer"), F.lit(None).cast("string").alias("expected_answer"), F.col("lang").alias("domain"))
    rows = traces.count()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)

    sink = lambda df: df.write.mode("overwrite").format("noop").save()
    sink(score(traces.limit(50)))  # starts the JVM's compilers
    timed("score", lambda: sink(score(traces)))
    scored = score(traces).select(*(c for c in OUTPUT if c not in ("thinking", "problem", "answer"))).persist()
    timed("score_and_keep", lambda: scored.count())
    timed("filter_70", lambda: sink(at_least(scored)))
    timed("top_30_percent", lambda: sink(top_percent(scored, 30)))
    timed("dimension_stats", lambda: sink(dimension_stats(scored)))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("correct"))
    timed("auc_all_dimensions", lambda: sink(auc(unpivot(scored.join(labels, "id"), ("quality_score", "efficiency_score", "structural_score", "repetition_score"), ("correct",)))))
    try:
        from sievework.llm import queries as llm
    except ImportError:
        llm = None
    if llm:
        for name in ("op6_exact_dedup", "op9_packing", "op8_pii_boost", "op5_html_mincut"):
            timed(name, lambda name=name: sink(llm.queries()[name](spark, SF_DIR)))
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR, "rows": rows, "rows_per_sec_score": round(rows / times["score"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
