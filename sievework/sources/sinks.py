"""Results out: Parquet, JSON lines and an HTML report."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FormatError
from ..operators.score import INPUT, OUTPUT
from ..operators.select import dimension_stats, summary, worst


def format_of(path: str, default: str = "parquet") -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if "." not in name:
        return default
    kind = name.rsplit(".", 1)[-1]
    if kind not in ("parquet", "jsonl"):
        raise FormatError(f"unknown output format {kind}")
    return kind


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line; nulls are written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_scored(df: DataFrame, path: str, default: str = "parquet", mode: str = "errorifexists") -> None:
    rows = df.select(*OUTPUT)
    if format_of(path, default) == "parquet":
        rows.write.mode(mode).option("compression", "snappy").parquet(path)
    else:
        write_jsonl(rows, path, mode)


def write_kept(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Filtered traces as they came: canonical names, no scores, other fields at the top level again."""
    own = F.to_json(F.struct(*(c for c in INPUT if c in df.columns)), {"ignoreNullFields": "false"})
    if "extra" in df.columns:
        text = lambda v: F.when(F.try_parse_json(v).isNotNull(), v).otherwise(F.regexp_replace(F.to_json(F.struct(v.alias("v"))), r'^\{"v":|\}$', ""))
        name = lambda k: F.regexp_replace(F.to_json(F.struct(k.alias("v"))), r'^\{"v":|\}$', "")
        rest = F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat(F.lit(","), name(e["key"]), F.lit(":"), F.coalesce(text(e["value"]), F.lit("null")))), "")
        own = F.concat(F.regexp_replace(own, r"\}$", ""), rest, F.lit("}"))
    df.select(own.alias("value")).write.mode(mode).text(path)


def report(scored: DataFrame, title: str = "Trace quality") -> str:
    """An HTML page: summary, dimensions and the ten worst traces. Only aggregates and ten rows reach the driver."""
    s = summary(scored).first()
    dims = dimension_stats(scored).orderBy("dimension").collect()
    low = worst(scored).collect()
    e = html.escape
    cards = "".join(f"<div class=card><b>{v}</b> {k}</div>" for k, v in (("traces", s.n), ("average quality", f"{s.avg_quality or 0:.1f}"), ("at 70 or above", f"{s.good or 0} ({s.good_pct or 0:.1f}%)"), ("mixed languages", s.mixed)))
    rows = "".join(f"<tr><td>{e(d.dimension)}<td>{d.avg:.1f}<td>{d.min:.1f}<td>{d.max:.1f}<td>{d.pct_80:.1f}%" for d in dims)
    items = "".join(f"<details><summary>{e(w.id)}: {w.quality_score:.1f} {e(', '.join(w.issues))}</summary><pre>{e(w.preview or '')}</pre></details>" for w in low)
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1>{cards}<table><tr><th>dimension<th>average<th>least<th>most<th>80 or more{rows}</table><h2>Worst</h2>{items}"
