"""JSON lines in: strict or tolerant, with aliases of field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyInput, ParseError

ALIASES = {
    "id": ("id", "idx", "index", "uuid"),
    "problem": ("problem", "question", "prompt", "query", "input"),
    "thinking": ("thinking", "reasoning", "chain_of_thought", "cot", "thought"),
    "answer": ("answer", "solution", "response", "output", "result"),
    "expected_answer": ("expected_answer", "ground_truth", "label", "target"),
    "domain": ("domain",),
    "source": ("source",),
}
REQUIRED = ("id", "problem", "thinking", "answer")
KNOWN = tuple(n for names in ALIASES.values() for n in names)


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))


def _value(name: str) -> Column:
    return F.try_variant_get("_v", f"$.{name}", "string")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trace columns, ``extra`` (map of other fields to their JSON) and ``problem_found`` (null for a good line) for each non-blank line.

    A record names each field once, under any alias; ids are strings or numbers, all else strings.
    """
    df = lines.withColumn(column, F.trim(F.regexp_replace(column, r"^\s+|\s+$", ""))).filter(F.col(column) != "")
    df = df.withColumn("_v", F.try_parse_json(column)).withColumn("_keys", F.json_object_keys(column)).withColumn("_raw", F.from_json(column, "map<string,string>"))
    staged = {}
    for field, names in ALIASES.items():
        staged[f"_n_{field}"] = F.size(F.array_intersect("_keys", F.array(*map(F.lit, names))))
        staged[f"_k_{field}"] = F.coalesce(*(F.when(F.array_contains("_keys", n), _kind(n)) for n in names))
        # an id that is a number keeps its own spelling
        staged[f"_f_{field}"] = F.coalesce(*((F.when(F.array_contains("_keys", n), F.element_at("_raw", n)) if field == "id" else _value(n)) for n in names))
    df = df.withColumns(staged)
    faults = [F.when(F.col("_v").isNull() | F.col("_keys").isNull(), F.lit("not a JSON object"))]
    for field in ALIASES:
        n, kind = F.col(f"_n_{field}"), F.col(f"_k_{field}")
        faults.append(F.when(n > 1, F.lit(f"several names for {field}")))
        if field in REQUIRED:
            faults.append(F.when(n == 0, F.lit(f"no {field}")))
            good = kind == "STRING" if field != "id" else kind.isin("STRING", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        else:
            good = F.coalesce(kind, F.lit("VOID")).isin("STRING", "VOID")
        faults.append(F.when(~good, F.lit(f"{field} has a wrong type")))
    extra = F.map_filter(F.coalesce("_raw", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*KNOWN))
    return df.select(*(F.col(f"_f_{k}").alias(k) for k in ALIASES), extra.alias("extra"), F.coalesce(*faults).alias("problem_found"), F.col(column).alias("line"))


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Good records of JSON-lines files, plain or gzipped. ``strict`` fails at the first bad line; no good record at all is an error."""
    rows = parsed(spark.read.text(path))
    if strict:
        bad = rows.filter("problem_found is not null").select("problem_found").head(1)
        if bad:
            raise ParseError(bad[0][0])
    good = rows.filter("problem_found is null").drop("problem_found", "line")
    if good.isEmpty():
        raise EmptyInput(f"no record in {path}")
    return good


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """What a tolerant read skips: problem and line."""
    return parsed(spark.read.text(path)).filter("problem_found is not null").select("problem_found", "line")


def loose(lines: DataFrame, column: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """The forgiving mapping: the first name in list order counts, only a thinking text is needed, ids default to the ordinal; ``unknown`` lists other keys."""
    df = lines.withColumn("_v", F.try_parse_json(column)).withColumn("_keys", F.json_object_keys(column)).filter("_v is not null and _keys is not null")
    pick = lambda f: F.coalesce(*(_value(n) for n in ALIASES[f]))
    empty = F.lit("")
    return df.select(F.coalesce(pick("id"), F.col(ordinal).cast("string")).alias("id"), F.coalesce(pick("problem"), empty).alias("problem"), pick("thinking").alias("thinking"), F.coalesce(pick("answer"), empty).alias("answer"), pick("expected_answer").alias("expected_answer"), pick("domain").alias("domain"), pick("source").alias("source"), F.array_except("_keys", F.array(*map(F.lit, KNOWN))).alias("unknown")).filter("thinking is not null")


def suggest_mapping(keys: list[str]) -> dict[str, str]:
    """Field for each key that is a known name of one; the first key wins a field."""
    out: dict[str, str] = {}
    for field, names in ALIASES.items():
        found = next((n for n in names if n in keys), None)
        if found:
            out[found] = field
    return out


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``df`` with its columns renamed by ``mapping``; some key must map to thinking."""
    if "thinking" not in mapping.values():
        raise ParseError("no field is mapped to thinking")
    return df.select(*(F.col(k).cast("string").alias(v) for k, v in mapping.items()))


def required(c: Column, name: str) -> Column:
    """``c``, or an error in the row that lacks it."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(f"column {name} is empty"))).otherwise(c)


def from_conversations(df: DataFrame) -> DataFrame:
    """Conversations to traces: the last user turn is the problem, the last assistant turn the thinking; those without thinking are left out."""
    last = lambda role, c: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))).alias(c)
    out = df.groupBy(F.col("conv_id").cast("string").alias("id")).agg(last("user", "problem"), last("assistant", "thinking"))
    return out.filter(F.coalesce(F.col("thinking"), F.lit("")) != "").withColumn("problem", F.coalesce("problem", F.lit("")))
