"""Model families: which tags and fields hold their thinking, and what they cost."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RegistryError
from ..functions.text import trim_u


@dataclass(frozen=True)
class Family:
    id: str
    name: str
    tags: tuple[tuple[str, str], ...] = ()
    fields: tuple[str, ...] = ()
    output_per_mtok: float | None = None
    notes: str | None = None
    lexicon: dict[str, dict[str, list[str]]] = field(default_factory=dict)


FAMILIES = (
    Family("claude-extended-thinking", "Claude extended thinking", (("<thinking>", "</thinking>"),), ("thinking",)),
    Family("deepseek-r1", "DeepSeek R1", (("<think>", "</think>"),), ("reasoning_content",)),
    Family("glm", "GLM", (("<think>", "</think>"),), ("reasoning_content",)),
    Family("gpt-oss", "gpt-oss", (("<|channel|>analysis<|message|>", "<|end|>"),), ("reasoning", "reasoning_content")),
    Family("qwen3", "Qwen3", (("<think>", "</think>"),), ("reasoning_content",)),
)


def family(id_: str) -> Family:
    for f in FAMILIES:
        if f.id == id_:
            return f
    raise RegistryError(f"unknown model family {id_}")


def table(spark: SparkSession) -> DataFrame:
    """One row per family."""
    rows = [(f.id, f.name, [list(t) for t in f.tags], list(f.fields), f.output_per_mtok) for f in FAMILIES]
    return spark.createDataFrame(rows, "id string, name string, tags array<array<string>>, fields array<string>, output_per_mtok double")


def by_tags(raw: Column, tags: tuple[tuple[str, str], ...]) -> Column:
    """What stands in the first pair of tags that is opened and then closed, trimmed; null without one."""
    def inner(open_: str, close: str) -> Column:
        rest = F.when(F.contains(raw, F.lit(open_)), F.substring(raw, F.locate(open_, raw) + len(open_), F.char_length(raw)))
        return F.when(F.contains(rest, F.lit(close)), trim_u(F.substring_index(rest, close, 1)))

    return F.coalesce(*(inner(a, b) for a, b in tags), F.lit(None).cast("string"))


def by_fields(json: Column, fields: tuple[str, ...]) -> Column:
    """The first of the fields that is a string and not empty."""
    v = F.try_parse_json(json)
    return F.coalesce(*(F.nullif(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.try_variant_get(v, f"$.{f}", "string")), F.lit("")) for f in fields), F.lit(None).cast("string"))
