"""Shared plumbing of the training-data operators: tables, shared folders, sizes, Arrow helpers.

Nothing here keeps a document, a link or a fingerprint on the driver.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import python_ready

#: Rows per Arrow batch: a worker holds one batch of texts at a time.
ARROW_ROWS = 1000
#: How many bytes of input stand behind a range of numbered rows.
RANGE_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Ready a session for Python workers: bounded batches, and this package on every executor."""
    python_ready(spark, rows)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="framequarry-checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, deleted when the application ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The planner's size of an input (file sizes for files), without running anything."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0  # the planner's "unknown": rows made on the driver


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame, bytes_each: int = 2 << 20) -> int:
    """How many buckets to deal out: grows with the input, at least four a shuffle partition."""
    return max(4 * shuffle_partitions(df.sparkSession), math.ceil(input_bytes(df) / bytes_each))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `grp`: their number `idx` within it, and how many it has (`n`). `order` decides, then place in the input."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ranges = max(shuffle_partitions(rows.sparkSession), input_bytes(rows) // RANGE_BYTES)
    keys = ["grp", *order, "tie"]
    sorted_rows = rows.repartitionByRange(int(ranges), *keys).sortWithinPartitions(*keys).drop("tie")
    # written, so that the numbers stay what they are
    placed = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("at", 33))
    stretches = placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("many"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")  # a row a partition that the group reaches
    before = F.coalesce(F.sum("many").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stretches.select("part", "grp", (before - F.col("first")).alias("shift"), F.sum("many").over(group).alias("n"))
    return placed.join(starts, ["part", "grp"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id; null and empty differ from nothing else."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes end to end, and each row's start (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def batches_of(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text; a longer text stands alone."""
    ends = text_bytes(batch.column(text))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def kept_ddl(docs: DataFrame, keep: tuple[str, ...]) -> str:
    """The DDL of columns that a map passes through unchanged (doc_id is always there)."""
    return "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep if c != "doc_id")


def with_kept(out: pa.RecordBatch, batch: pa.RecordBatch, keep: tuple[str, ...]) -> pa.RecordBatch:
    also = [c for c in keep if c != "doc_id"]
    return pa.RecordBatch.from_arrays([*out.columns, *(batch.column(c) for c in also)], names=[*out.schema.names, *also]) if also else out


def record(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)
