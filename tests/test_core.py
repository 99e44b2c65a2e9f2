"""Sources, sinks, scoring, statistics and streams; queries against their SQL on the smallest tables."""

import gzip
import json
import os

import pytest

from sievework import config
from sievework.errors import ArgumentError, EmptyInput, ParseError, WeightError
from sievework.operators import select, spans, stats
from sievework.operators.score import OUTPUT, score, score_detailed
from sievework.plans import catalog
from sievework.sources import jsonl, registry, sinks

SF = "/root/testdata/sf0.001"
TRACES = [("a", "What is 2+2?", "Step 1: first, we know that two and two make four because of counting. Let me check: indeed, it is 4. Therefore, the answer is 4.", "4", "4."), ("b", "", "", "x", None), ("c", "p", "<think>wait, let me see. Wait, I need to redo this.</think> out", "five", "six")]


def traces(spark):
    return spark.createDataFrame(TRACES, "id string, problem string, thinking string, answer string, expected_answer string")


def test_scores(spark):
    rows = {r.id: r for r in score(traces(spark)).collect()}
    assert tuple(rows["a"].asDict()) == OUTPUT
    assert rows["a"].answer_in_trace_end and rows["a"].has_self_verification and rows["a"].length_score == 5
    assert rows["b"].raw_score == pytest.approx(0.2 * 100 + 0.12 * 100 + 0.18 * 20 + 0.1 * 50 + 0.15 * 100 + 0.1 * 100 + 0.08 * 50 + 0.07 * 5, abs=1e-3) or rows["b"].thinking_word_count == 0
    assert rows["c"].restart_count == 2 and rows["c"].thinking_word_count == 10
    detail = score_detailed(traces(spark)).filter("id = 'a'").first()
    assert [s.name for s in detail.scores][-1] == "accuracy_efficiency" and detail.scores[8].diagnostics["accurate"] == "true"


def test_selection(spark):
    s = score(traces(spark)).persist()
    assert select.top_percent(s, 34).count() == 1 and select.how_many(10, 25) == 3
    with pytest.raises(ArgumentError):
        select.top_percent(s, 101)
    assert {r.dimension for r in select.dimension_stats(s).collect()} >= {"quality_score", "length_score"}
    assert "<h1>" in sinks.report(s)
    kinds = [(r.kind, r.start) for r in spans.annotate(traces(spark)).filter("id = 'c'").collect()]
    assert ("restart", 0) in kinds


def test_jsonl(spark, tmp_path):
    good = [{"idx": 1.0, "question": "q", "cot": "t", "response": "a", "label": None, "tag": [1]}, {"id": "x", "problem": "", "thinking": "t", "answer": ""}]
    bad = ["not json", '{"id": 1}', json.dumps({"id": 1, "idx": 2, "problem": "", "thinking": "", "answer": ""}), json.dumps({"id": None, "problem": "", "thinking": "", "answer": ""}), json.dumps({"id": 1, "problem": 3, "thinking": "", "answer": ""})]
    p = tmp_path / "t.jsonl.gz"
    p.write_bytes(gzip.compress("\n".join([json.dumps(good[0]), "", *bad, json.dumps(good[1])]).encode()))
    rows = {r.id: r for r in jsonl.read_jsonl(spark, str(p)).collect()}
    assert set(rows) == {"1.0", "x"} and rows["1.0"].thinking == "t" and rows["1.0"].extra == {"tag": "[1]"}
    assert jsonl.bad_lines(spark, str(p)).count() == len(bad)
    with pytest.raises(ParseError):
        jsonl.read_jsonl(spark, str(p), strict=True)
    (tmp_path / "e.jsonl").write_text("nope\n")
    with pytest.raises(EmptyInput):
        jsonl.read_jsonl(spark, str(tmp_path / "e.jsonl"))
    sinks.write_kept(jsonl.read_jsonl(spark, str(p)), str(tmp_path / "kept"))
    back = [json.loads(line) for f in os.listdir(tmp_path / "kept") if f.startswith("part") for line in open(tmp_path / "kept" / f)]
    assert {b["id"] for b in back} == {"1.0", "x"} and [b["tag"] for b in back if b["id"] == "1.0"] == [[1]]
    lines = spark.createDataFrame([(1, '{"reasoning": "r", "zz": 1, "uuid": 5}'), (2, '{"problem": "p"}')], "ordinal int, value string")
    row = jsonl.loose(lines).first()
    assert (row.id, row.thinking, row.unknown) == ("5", "r", ["zz"])
    assert jsonl.suggest_mapping(["cot", "query"]) == {"query": "problem", "cot": "thinking"}


def test_registry(spark):
    df = spark.createDataFrame([("a <think> x </think> b", '{"reasoning_content": "r"}'), ("none", "{}")], "t string, j string")
    f = registry.family("deepseek-r1")
    assert [tuple(r) for r in df.select(registry.by_tags(df.t, f.tags), registry.by_fields(df.j, f.fields)).collect()] == [("x", "r"), (None, None)]
    assert registry.table(spark).count() == 5


def test_config():
    c = config.parse("[scoring.weights]\nefficiency = 0.3\nlanguage = 0.02\n[other]\nx = 1\n")
    assert c.weights.efficiency == 0.3 and config.parse(config.default_toml()) == config.Config()
    with pytest.raises(WeightError):
        config.parse("[scoring.weights]\nefficiency = 0.9\n")


def test_statistics(spark):
    df = spark.createDataFrame([(str(k), float(k % 5), k % 3 == 0) for k in range(60)], "id string, v double, correct boolean")
    pos, neg = [k % 5 for k in range(60) if k % 3 == 0], [k % 5 for k in range(60) if k % 3]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert stats.auc(stats.unpivot(df, ("v",), ("correct",))).first().auc == pytest.approx(want)
    b = stats.bootstrap_auc(df, "v", replicates=40).first()
    assert b.low <= b.mean <= b.high
    assert stats.binomial_p(5, 5) == 1.0 and stats.binomial_p(10, 0) == pytest.approx(2 / 1024)


def test_streams(spark, tmp_path):
    from sievework.streaming import live

    rows = [("s", 1, '{"message": {"thinking": "one "}}'), ("s", 2, "broken"), ("s", 3, '{"message": {"thinking": "two", "content": "4"}, "done": true}')]
    lines = spark.createDataFrame(rows, "stream_id string, seq int, value string")
    got = live.gathered_batch(live.deltas(lines)).first()
    assert (got.thinking, got.content, got.final) == ("one two", "4", True)
    lines.write.parquet(str(tmp_path / "in"))
    stream = live.deltas(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")))
    q = live.live_scores(live.as_traces(live.gathered(stream))).writeStream.outputMode("update").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.id, r.thinking, r.answer) for r in spark.table("live").select("id", "thinking", "answer").collect()] == [("s", "one two", "4")]


@pytest.mark.parametrize("name", ["q_txt_8_no_code", "q_txt_12_windows", "q_dim_2_alignment", "q_dim_10_calibrate", "q_agg_27_latest", "q_val_1_problems"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(catalog.SQL[name])
    columns = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SF)
    plain = lambda rows, order: sorted(tuple(str(r[order.index(c)]) for c in columns) for r in rows)
    assert sorted(got.columns) == columns
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)
