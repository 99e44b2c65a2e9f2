"""Live traces: deltas of a stream are gathered per stream and scored as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..operators.score import score

#: Seconds without a delta after which a stream counts as stalled.
STALL = 90
TRACE = "stream_id string, thinking string, content string, final boolean, stalled boolean"


def deltas(lines: DataFrame, stream_id: str = "stream_id", value: str = "value") -> DataFrame:
    """Lines of JSON ({message: {thinking, content}, done}) to deltas; malformed lines are left out."""
    v = F.try_parse_json(value)
    get = lambda p, t: F.try_variant_get("_v", p, t)
    rows = lines.withColumn("_v", v).filter("_v is not null")
    keep = [c for c in lines.columns if c != value]
    return rows.select(*keep, F.coalesce(get("$.message.thinking", "string"), F.lit("")).alias("thinking"), F.coalesce(get("$.message.content", "string"), F.lit("")).alias("content"), F.coalesce(get("$.done", "boolean"), F.lit(False)).alias("done"))


def gathered(df: DataFrame, stall: int = STALL) -> DataFrame:
    """The text of each stream so far after every micro-batch. A stream ends once: at ``done``, or stalled without a delta for ``stall`` seconds."""

    def update(key, frames, state: GroupState):
        import pandas as pd

        thinking, content, done = state.get if state.exists else ("", "", False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], thinking, content, not done, True)], columns=["stream_id", "thinking", "content", "final", "stalled"])
            return
        was_done = done
        for f in frames:
            f = f.sort_values("seq")
            thinking += "".join(f["thinking"])
            content += "".join(f["content"])
            done = done or bool(f["done"].any())
        state.update((thinking, content, done))
        if not done:
            state.setTimeoutDuration(stall * 1000)
        if not was_done:
            yield pd.DataFrame([(key[0], thinking, content, done, False)], columns=["stream_id", "thinking", "content", "final", "stalled"])

    return df.groupBy("stream_id").applyInPandasWithState(update, TRACE, "thinking string, content string, done boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def gathered_batch(df: DataFrame) -> DataFrame:
    """The same of deltas at rest: (stream_id, seq, thinking, content, done) in the order of seq."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "thinking", "content")))  # one stream's deltas
    text = lambda c: F.array_join(F.transform("_r", lambda r: r[c]), "")
    got = df.groupBy("stream_id").agg(rows.alias("_r"), F.bool_or("done").alias("final"))
    return got.select("stream_id", text("thinking").alias("thinking"), text("content").alias("content"), "final")


def as_traces(df: DataFrame, problem: str = "") -> DataFrame:
    """Gathered text as traces: without thinking the content is the thinking, and there is no answer yet."""
    empty = F.col("thinking") == ""
    return df.select(F.col("stream_id").alias("id"), F.lit(problem).alias("problem"), F.when(empty, F.col("content")).otherwise(F.col("thinking")).alias("thinking"), F.when(empty, "").otherwise(F.col("content")).alias("answer"))


def live_scores(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Scores of traces, streaming or at rest: scoring keeps no state."""
    return score(df, config)


def start(df: DataFrame, name: str, every: str = "500 milliseconds"):
    """Writes the latest scores of each micro-batch to a table in memory; a trigger interval coalesces updates."""
    return live_scores(as_traces(gathered(df))).writeStream.outputMode("update").format("memory").queryName(name).trigger(processingTime=every).start()
