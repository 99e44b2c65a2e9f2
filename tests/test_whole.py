"""Queries that once did a part of their job."""

import pytest
from test_core import test_queries_match_sql as match

from sievework.operators import select
from sievework.plans import catalog, more


def test_ranks_of_all_rows(spark):
    rows = [(str(k), float(k % 7)) for k in range(500)]
    got = {r.id: r.n for r in select.ranked(spark.createDataFrame(rows, "id string, quality_score double").repartition(5)).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1)}


def test_full_order_matches_sql(spark):
    match(spark, "q_srt_1_full")


@pytest.mark.parametrize("name", ["q_agg_19_bootstrap", "q_agg_20_paired_bootstrap"])
def test_bootstraps_draw_as_often_as_the_reference(name, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(more.stats, "bootstrap_auc", lambda *a, replicates=400, **k: seen.append(replicates))
    monkeypatch.setattr(more, "labelled", lambda spark, sf: spark.createDataFrame([("a", 1)], "id string, thinking_word_count int"))
    catalog.QUERIES[name](spark, "")
    assert seen == [2000]
