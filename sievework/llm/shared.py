"""What the operators share: the cluster's shared folder, size-checked broadcasts and joins that stand hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of rows that have none, while they are processed; they sort before all others.
NULL_ID = -(2**63)
#: Rows that a broadcast may hold. Callers count before they broadcast.
BROADCAST_ROWS = 1_000_000


class _Made(threading.local):
    """Folders that this thread of the driver made, in order."""

    def __init__(self) -> None:
        self.at: list[str] = []


_MADE = _Made()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one is made only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
            base = spark.sparkContext.getCheckpointDir()
    _MADE.at.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE.at[-1]


def made() -> int:
    """How many folders were made so far; for ``clear``."""
    return len(_MADE.at)


def clear(spark: SparkSession, since: int = 0, but: str = "") -> None:
    """Removes the folders made after ``since`` but one. Results that were not written elsewhere can't be read any more."""
    jvm = spark.sparkContext._jvm
    for at in _MADE.at[since:]:
        if at != but:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.at[since:] = [at for at in _MADE.at[since:] if at == but]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def keep(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here."""
    df.write.options(**options).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(spark: SparkSession, rows: int, per_task: int) -> int:
    """Shuffle partitions for ``rows`` rows (or bytes) at ``per_task`` each, the session's own number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise as it is. ``df`` should be a written table, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int, hot: int = 1000) -> DataFrame:
    """Left join to a table with one row per key, where a key may hold any share of ``left``.

    ``size`` says how many rows of ``left`` a key has. At most ``hot`` keys have more than
    total / hot rows: these go by broadcast, so no task gets a hot key's rows; all others by shuffle.
    """
    limit = max(1, total // hot)
    extra = [c for c in right.columns if c not in on]
    heavy = right.filter(F.col(size) > limit)
    first = left.join(F.broadcast(heavy.withColumn("_hot", F.lit(True))), on, "left")
    done = first.filter(F.col("_hot").isNotNull()).drop("_hot")
    rest = first.filter(F.col("_hot").isNull()).drop("_hot", *extra)
    cold = rest.join(right.filter(F.col(size) <= limit), on, "left")
    return done.unionByName(cold)


def semi_skewed(left: DataFrame, keys: DataFrame, on: str, size: str, total: int, rows: int = BROADCAST_ROWS, hot: int = 1000) -> DataFrame:
    """Rows of ``left`` whose key is in the written table ``keys``, where a key may hold any share of ``left``.

    Up to ``rows`` keys go by broadcast. Of more, those with more than total / hot rows do (``hot`` at most),
    so their rows stay where they are; the others meet their rows by a shuffle.
    """
    if keys.count() <= rows:
        return left.join(F.broadcast(keys.select(on)), on, "left_semi")
    limit = max(1, total // hot)
    heavy = F.broadcast(keys.filter(F.col(size) > limit).select(on))
    cold = left.join(heavy, on, "left_anti").join(keys.filter(F.col(size) <= limit).select(on).hint("merge"), on, "left_semi")
    return left.join(heavy, on, "left_semi").unionByName(cold)


def row_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def back(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that results are passed on before much is held."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            release()
    finally:
        release()
