"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once per application, unless workers find it by PYTHONPATH."""
    home = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app not in _shipped and home.parent not in on_path and home.parent.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="sievework-ship-")) / "sievework.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(home.rglob("*")):
                if p.is_file() and p.suffix != ".pyc":
                    z.write(p, p.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
    return spark
