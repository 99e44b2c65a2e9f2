"""Command line: score, filter, stats, report, explain, init-config, models."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import config as settings
from .errors import ArgumentError, SieveError
from .operators.dimensions import DIMENSIONS
from .operators.score import score
from .operators.select import at_least, dimension_stats, summary, top_percent
from .ship import ship
from .sources import jsonl, registry, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework")
    p.add_argument("--threads", type=int, default=0, help="cores to use, 0 for all")
    p.add_argument("--config", default="sievework.toml")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("score", "filter", "stats", "report"):
        c = sub.add_parser(name)
        c.add_argument("-i", "--input", required=True)
        if name != "stats":
            c.add_argument("-o", "--output", required=True)
        if name == "filter":
            c.add_argument("--min-score", type=float)
            c.add_argument("--top-percent", type=float)
            c.add_argument("--min-efficiency", type=float)
            c.add_argument("--min-language", type=float)
    sub.add_parser("explain")
    sub.add_parser("models")
    c = sub.add_parser("init-config")
    c.add_argument("-o", "--output", default="sievework.toml")
    return p


def _work(a: argparse.Namespace) -> None:
    if a.command == "explain":
        for d in DIMENSIONS:
            print(f"{d.name}: weight {getattr(settings.Weights(), d.key):g}, column {d.column}")
    elif a.command == "models":
        for f in registry.FAMILIES:
            print(f"{f.id}: {f.name}")
    elif a.command == "init-config":
        if Path(a.output).exists():
            raise ArgumentError(f"{a.output} is there already")
        Path(a.output).write_text(settings.default_toml())
    else:
        conf = settings.load(a.config)
        spark = ship(SparkSession.builder.master(f"local[{a.threads or '*'}]").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate())
        traces = jsonl.read_jsonl(spark, a.input, conf.strict)
        scored = score(traces, conf, keep_extra=True).persist()
        if a.command == "score":
            sinks.write_scored(scored, a.output, conf.format)
        elif a.command == "report":
            Path(a.output).write_text(sinks.report(scored))
        elif a.command == "stats":
            summary(scored).show(truncate=False)
            dimension_stats(scored).orderBy("dimension").show(truncate=False)
        else:
            if a.min_score is not None and a.top_percent is not None:
                raise ArgumentError("give a least score or a per cent, not both")
            limits = {"min_efficiency": a.min_efficiency, "min_language": a.min_language}
            kept = top_percent(scored, a.top_percent, **limits) if a.top_percent is not None else at_least(scored, conf.min_score if a.min_score is None else a.min_score, **limits)
            sinks.write_kept(kept, a.output)


def main(args: list[str] | None = None) -> int:
    try:
        _work(_parser().parse_args(args))
    except SieveError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
