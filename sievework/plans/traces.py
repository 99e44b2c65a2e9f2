"""Trace records made from the documents table, in SQL that Spark and DuckDB read alike.

The documents hold none of the wording that the dimensions look for, so each gets some, chosen by
remainders of its id: restarts, steps, checks, conclusions, doubt, fences, other scripts, tags.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"


def _pick(n: int, *options: str) -> str:
    """A CASE over doc_id % n; options are SQL, the last is for all other remainders."""
    return f"CASE doc_id % {n} " + " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options[:-1])) + f" ELSE {options[-1]} END"


_FRONT = _pick(9, "'Wait, let me reconsider this. Actually, no. '", "'Step 1: first, we know that it holds. Step 2: second, because of this. '", "'Hmm, let me think. Okay so now, '", f"'Let me start over. I made an error.' || {_NL} || {_NL}", "'On second thought, I need to restart. '", "'1. Given that x, thus y. 2. Since y, then z. '", "'Let me verify this. Indeed, as expected. '", "'WAIT, I NEED TO redo. Let me Redo it. '", "''")
_MID = _pick(7, "' Let me check: substituting back works. '", f"{_NL} || '```python' || {_NL} || 'the code is here' || {_NL} || '```' || {_NL}", "' That is wrong, let me recalculate. Ugh, let me try again. '", "' 我们可以检查一下。因此答案是这样。所以确实。 '", "' This makes sense, consistent with the rest. '", f"'　' || {_NL} || {_NL} || ' however, next, therefore, '", "' '")
_END = _pick(11, "' Therefore, the answer is 4. Sanity check: that checks out.'", "' So the answer: 42'", "' I''m not sure. Let me try another way?'", "' Thus, in conclusion, we get \\boxed{7}!'", "' 最终答案：七。'", "' To verify, plugging back in. Let''s check. Everything fits.'", "' Hence we conclude. Final answer 12, result: 12.'", "' This confirms it. It seems like 3. '", "' I need to rethink'", "' We obtain ' || left(text, 12) || '.'", "''")
_CJK = "repeat('这是一个很长的中文推理步骤，我们需要仔细检查每一个细节。 ', 40)"
_BODY = f"CASE WHEN doc_id % 3 = 0 THEN replace(text, {_NL}, {_NL} || {_NL}) ELSE text END"
_SECOND = f"CASE WHEN doc_id % 7 = 0 THEN {_NL} || {_NL} || body ELSE '' END"
_WRAP = "CASE doc_id % 6 WHEN 0 THEN 'Sure. <think> ' || inner_text || ' </think> done' WHEN 1 THEN '<reasoning>' || inner_text || '</reasoning>' WHEN 2 THEN 'a <thought>' || inner_text || '</thought> b' WHEN 3 THEN '<think>' || inner_text WHEN 4 THEN '</think> ' || inner_text || ' <think>' ELSE '  ' || inner_text || '　' END"
_PROBLEM = _pick(5, "'What is 2 + 2?'", "repeat('A farmer has many fields and wants to know the area of each one. ', 12)", "'Prove that \\frac{1}{2} + \\sqrt{x} ≤ ∫ x^{2} and \\sum_{i} holds'", "'Write a function that returns def f( and class A with import os and fn main'", "''")
_ANSWER = _pick(4, "'4'", "'4.0'", "'twelve'", "left(text, 12)")
_EXPECTED = _pick(8, "'4'", "' 4. '", "'thirteen'", "NULL", "'4.'", "'4'", "'Twelve,'", "NULL")

SQL = f"""
    SELECT CAST(doc_id AS VARCHAR(20)) AS id, CAST(floor(doc_id / 2) AS BIGINT) AS problem_id, CASE doc_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS model,
           {_PROBLEM} AS problem, {_WRAP} AS thinking, {_ANSWER} AS answer, lang AS domain, source, {_EXPECTED} AS expected_answer
    FROM (SELECT *, {_FRONT} || substring(body, 1, half) || {_MID} || substring(body, half + 1, 10000000) || {_SECOND} || {_END} AS inner_text
          FROM (SELECT *, CAST(floor(length(body) / 2) AS INT) AS half
                FROM (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_BODY.replace("text", "coalesce(text, '')")} AS body FROM documents) b) h) t"""
# Edge rows that the documents don't have
EDGES = {
    "e1": "''", "e2": "'   ' || chr(10)", "e3": "repeat('汉', 30)", "e4": "repeat('a', 49)", "e5": "repeat('ab ', 33)", "e6": "repeat('é', 100)", "e7": "repeat('ü ', 267)",
    "e8": "repeat('ß', 999) || ' therefore.'", "e9": "'<think>never closed'", "e10": "'</think> early <think>'", "e11": "repeat('𝄞 wait, let me see. ', 60)", "e12": "repeat('word ', 10500)",
    "e13": "repeat('word ', 20500)", "e14": "repeat('x', 20000)", "e15": "'Same thing here again. Same thing here again. Same  thing here AGAIN. Other.'",
}
_EDGE_TEXT = "CASE i " + " ".join(f"WHEN {k[1:]} THEN {v}" for k, v in EDGES.items()) + " END"
# from a range, so that no engine computes them while it plans
EDGE_SQL = f"SELECT 'e' || CAST(i AS VARCHAR(3)) AS id, CAST(-1 AS BIGINT) AS problem_id, 'A' AS model, 'p' AS problem, {_EDGE_TEXT} AS thinking, '7' AS answer, 'xx' AS domain, 'edge' AS source, CAST(NULL AS VARCHAR(5)) AS expected_answer FROM numbers"
_COUNT = f"(SELECT CAST({{}} AS INT) + 1 AS i FROM range({len(EDGES)}))"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(_spark(SQL).replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {docs}") + " UNION ALL " + _spark(EDGE_SQL).replace("FROM numbers", "FROM " + _COUNT.format("id")), docs=docs)


def _spark(sql: str) -> str:
    """Spark reads backslashes in literals as escapes, and has no VARCHAR casts to speak of."""
    return re.sub(r"VARCHAR\(\d+\)", "STRING", sql.replace("\\", "\\\\")).replace("I''m", "I\\'m").replace("Let''s", "Let\\'s")


#: The same rows for DuckDB.
ORACLE = f"{SQL} UNION ALL {EDGE_SQL}".replace("FROM numbers", "FROM " + _COUNT.format("range"))
