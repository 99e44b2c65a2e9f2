"""Queries of readers, mappings, tags, side-by-side scores and gathered streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bench
from ..operators.dimensions import DIMENSIONS
from ..operators.score import score_detailed
from ..sources import jsonl, registry
from ..streaming import live
from . import oracle as o
from .core import query, table
from .traces import traces

# one JSON line per document, good or bad by its id; both engines read this SQL
_LINE = """CASE doc_id % 8 WHEN 0 THEN concat('{"id": ', doc_id, ', "problem": "p", "thinking": "t', doc_id, '", "answer": "a", "extra": [1, 2]}')
    WHEN 1 THEN concat('{"idx": "k', doc_id, '", "question": "q", "cot": "c", "response": "r", "label": null}') WHEN 2 THEN concat('{"id": ', doc_id, ', "uuid": "u", "problem": "p", "thinking": "t", "answer": "a"}')
    WHEN 3 THEN concat('{"id": ', doc_id, ', "problem": "p", "answer": "a"}') WHEN 4 THEN concat('{"id": ', doc_id, '.0, "prompt": "p", "reasoning": "t", "output": "a", "target": "x"}')
    WHEN 5 THEN concat('{"id": ', doc_id, ', "problem": 3, "thinking": "t", "answer": "a"}') WHEN 6 THEN 'no json' ELSE concat('{"id": null, "problem": "p", "thinking": "t', doc_id, '", "answer": null, "zz": 1}') END"""
_NAMES = {k: "[" + ", ".join(f"'{n}'" for n in v) + "]" for k, v in jsonl.ALIASES.items()}


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.expr(_LINE).alias("value"))


def _first(field: str) -> str:
    return "coalesce(" + ", ".join(f"j ->> '$.{n}'" for n in jsonl.ALIASES[field]) + ")"


_J = f"WITH l AS (SELECT doc_id, {_LINE} AS value FROM documents), v AS (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM l)"
_GOOD = " AND ".join(
    [f"len(list_intersect(json_keys(j), {_NAMES[f]})) = 1" for f in jsonl.REQUIRED] + [f"json_type(coalesce({', '.join(f'j -> {o.q(chr(36) + chr(46) + n)}' for n in jsonl.ALIASES[f])})) = 'VARCHAR'" for f in ("problem", "thinking", "answer")]
    + [f"json_type(coalesce({', '.join(f'j -> {o.q(chr(36) + chr(46) + n)}' for n in jsonl.ALIASES['id'])})) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE')"]
)
query("q_src_3_aliases", f"{_J} SELECT {_first('id')} AS id, {_first('problem')} AS problem, {_first('thinking')} AS thinking, {_first('answer')} AS answer, {_first('expected_answer')} AS expected_answer FROM v WHERE j IS NOT NULL AND {_GOOD}")(
    lambda spark, sf: jsonl.parsed(_lines(spark, sf)).filter("problem_found is null").select("id", "problem", "thinking", "answer", "expected_answer")
)
query("q_src_6_loose", f"{_J} SELECT coalesce(regexp_replace({_first('id')}, '[.]0$', ''), doc_id::VARCHAR) AS id, coalesce({_first('problem')}, '') AS problem, {_first('thinking')} AS thinking, coalesce({_first('answer')}, '') AS answer FROM v WHERE j IS NOT NULL AND {_first('thinking')} IS NOT NULL")(
    lambda spark, sf: jsonl.loose(_lines(spark, sf)).select("id", "problem", "thinking", "answer")
)
query("q_src_12_conversations", "SELECT * FROM (SELECT conv_id::VARCHAR AS id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS problem, arg_max(text, turn) FILTER (role = 'assistant') AS thinking FROM conversations GROUP BY 1) WHERE thinking <> ''")(
    lambda spark, sf: jsonl.from_conversations(table(spark, sf, "conversations"))
)
query("q_src_9_tags", o.over_scored(f"SELECT id, CASE WHEN contains(thinking, '<think>') AND contains(substr(thinking, strpos(thinking, '<think>') + 7), '</think>') THEN {o.trim('string_split(substr(thinking, strpos(thinking, ' + o.q('<think>') + ') + 7), ' + o.q('</think>') + ')[1]')} END AS inner_ FROM traces"))(
    lambda spark, sf: traces(spark, sf).select("id", registry.by_tags(F.col("thinking"), registry.family("deepseek-r1").tags).alias("inner_"))
)
_SIDES = " UNION ALL ".join(f"SELECT '{d.name}' AS name, printf('%.1f', a.{d.column}) AS a, printf('%.1f', b.{d.column}) AS b, printf('%+.1f', b.{d.column} - a.{d.column}) AS delta FROM scored a, scored b WHERE a.id = '1' AND b.id = '4'" for d in DIMENSIONS)


@query("q_jon_8_compare", o.over_scored(_SIDES))
def _compare(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda i: score_detailed(traces(spark, sf).filter(F.col("id") == i)).select(F.explode_outer("scores").alias("s")).select("s.name", "s.score")
    return bench.compare(side("1"), side("4"))


@query("q_str_2_gathered", "SELECT doc_id::VARCHAR AS stream_id, text AS thinking, 'x' AS content, true AS final FROM documents")
def _gathered(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in three deltas of a stream, put together again."""
    d, n = table(spark, sf, "documents"), F.floor(F.char_length("text") / 3).cast("int")
    piece = F.when(F.col("seq") == 2, F.col("text").substr(2 * n + 1, F.char_length("text"))).otherwise(F.col("text").substr(F.col("seq") * n + 1, n))
    parts = d.withColumn("seq", F.explode(F.array(*map(F.lit, (2, 0, 1)))))
    line = F.to_json(F.struct(F.struct(piece.alias("thinking"), F.when(F.col("seq") == 2, "x").alias("content")).alias("message"), (F.col("seq") == 2).alias("done")))
    return live.gathered_batch(live.deltas(parts.select(F.col("doc_id").cast("string").alias("stream_id"), "seq", line.alias("value"))))
