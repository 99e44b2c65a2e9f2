"""A corpus pipeline over the documents table: five stages, each of which works on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``, whatever they are called, with their values. Null ids and repeated rows are rows like others: the
two dedup stages number the rows first, so ids name no row; rows without an id count as smaller than all
others. An empty table gives an empty result of the same columns. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import langid_crf
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.jaccard_join import jaccard_join
from sievework.llm.packing import pack_documents
from sievework.llm.pii_boost import redact_pii
from sievework.llm.shared import clear, join_skewed, keep, made, shared_folder, small, unused
from sievework.ship import ship

#: Share of words that must be expected in one language; switched text of three even languages still passes.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) or of no recognisable language; a null ``lang`` becomes the prediction.

    Equal texts have equal scores, so rows that repeat stay or go together.
    """
    ship(spark)
    model = langid_crf.fit(docs)
    if model is None:  # nothing to learn from: only texts without a letter go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score, held = unused(docs, "_lang_pred", "_lang_score", "_lang_held_out")
    stays = langid_crf.identify(docs, model=model, names=(pred, score, held)).filter(F.col(score) >= LEAST_SHARE)
    return stays.withColumn("lang", F.coalesce("lang", pred)).select(docs.columns)


def _numbered(docs: DataFrame, row: str, at: str) -> DataFrame:
    """``docs``, written, with column ``row``: a number of its own for each row, whatever its id is."""
    return keep(docs.withColumn(row, F.monotonically_increasing_id()), f"{at}/rows", compression="zstd")


def _without(rows: DataFrame, row: str, groups: DataFrame, pick: Callable[[Column], Column], at: str, begun: int) -> DataFrame:
    """``rows`` less all but one of each group: ``pick`` chooses by id, then number; rows without an id count as smallest.

    ``groups``: (row, grp) of the rows that share a group with others. Only ``rows`` and what goes is read later, so all
    that the operator wrote since ``begun`` is removed.
    """
    named = keep(groups.join(rows.select(F.col(row), F.col("doc_id").cast("long").alias("id")), row), f"{at}/named")
    stays = keep(named.groupBy("grp").agg(pick(F.struct("id", row)).getField(row).alias("stays"), F.count("*").alias("size")), f"{at}/stays")
    gone = keep(join_skewed(named, stays, ["grp"], "size", named.count()).filter(F.col(row) != F.col("stays")).select(row), f"{at}/gone")
    clear(rows.sparkSession, begun, but=at)
    return rows.join(small(gone), row, "left_anti").drop(row)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts (null and empty ones are equal), the one with the largest id; of several such any one."""
    ship(spark)
    begun, at = made(), shared_folder(spark, "copies")
    (row,) = unused(docs, "_row")
    rows = _numbered(docs, row, at)
    found = exact_dedup(rows, row).filter("group_size > 1")
    return _without(rows, row, found.select(row, F.col("keep_id").alias("grp")), F.max, at, begun).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links connect, the one with the smallest id; of several such any one. Null, empty and white texts link with nothing."""
    ship(spark)
    begun, at = made(), shared_folder(spark, "near")
    (row,) = unused(docs, "_row")
    rows = _numbered(docs, row, at)
    found = jaccard_join(rows, row).filter("n_similar > 0")
    return _without(rows, row, found.select(row, F.col("component_id").alias("grp")), F.min, at, begun).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind; n_chars follows, null texts stay null. All rows stay."""
    ship(spark)
    out = redact_pii(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents' tokens into sequences; null and empty texts are one token, repeated rows are packed each."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: SQL can't express the first, fourth and fifth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; what a stage returns is written to the shared folder and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    begun = made()
    for _, stage in STAGES[:-1]:
        at = shared_folder(spark, "stage")
        docs = keep(stage(spark, docs, sf_dir), at)
        clear(spark, begun, but=at)  # the stage's own tables and its input
    return STAGES[-1][1](spark, docs, sf_dir)
