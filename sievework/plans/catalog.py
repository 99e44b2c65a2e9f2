"""All queries of the library outside of ``llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import score
from ..operators.select import dimension_stats, top_percent
from . import more, sourced
from .core import QUERIES, SQL
from .traces import traces

__all__ = ["QUERIES", "SQL", "flagship", "more", "sourced"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every trace, keeps the best 30 per cent and describes each dimension."""
    scored = score(traces(spark, sf_dir)).drop("thinking", "problem", "answer").persist()
    return dimension_stats(top_percent(scored, 30)).withColumns({c: F.round(c, 4) for c in ("avg", "min", "max", "pct_80")})
