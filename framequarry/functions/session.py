"""Session set-up for operators that run Python on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches and put this package on every executor, once a context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))  # rows of bytes: a batch of few
    context = spark.sparkContext
    if getattr(context, "_framequarry_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    bundle = os.path.join(tempfile.mkdtemp(), f"{top.name}-package.zip")
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(bundle)
    context._framequarry_shipped = True
