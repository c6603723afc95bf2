"""What several operators use: table reading, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of texts that a worker handles at once.
SLICE_ROWS = 400
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not where:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sigmill-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder, a folder for each value of ``by``, and read back: its lineage ends there,
    and lost executors cost nothing. The folder is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sigmill-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def slices(parts: Iterator[pa.RecordBatch], text: int = 1, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches with ``rows`` rows at most, and ``size`` bytes of column ``text`` unless one row has more; at
    the end, the worker gives what it freed back to the machine."""
    for whole in parts:
        column = whole.column(text)
        width = 8 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else 4
        ends = memoryview(column.buffers()[1] or b"").cast("i" if width == 4 else "q") if len(column) else None
        at = 0
        while at < whole.num_rows:
            begun, end = ends[column.offset + at], at + 1
            while end < whole.num_rows and end - at < rows and ends[column.offset + end + 1] - begun <= size:
                end += 1
            yield whole.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Workers stay alive between tasks: memory they freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that name in either case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
