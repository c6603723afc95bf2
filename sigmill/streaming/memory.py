"""Findings as a stream: the memory of patterns grows by batches, and stale sources are read again.

Both are Structured Streaming jobs that take what is there and stop (``availableNow``), so a scheduler decides how often they run.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = "id long, repo string, pr long, pattern_key string, detail string"


def summary(findings: DataFrame) -> DataFrame:
    """Occurrences of each pattern, its first and last pull request by id, and its first detail."""
    return findings.groupBy("repo", "pattern_key").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("id").alias("first_id"), F.min_by("pr", "id").alias("first_pr"), F.max("id").alias("last_id"), F.max_by("pr", "id").alias("last_pr"),
        F.min_by(F.substring("detail", 1, 200), "id").alias("example"),
    )


def combined(parts: DataFrame) -> DataFrame:
    """Summaries of the same patterns as one; adding a batch needs no earlier finding."""
    return parts.groupBy("repo", "pattern_key").agg(
        F.sum("occurrences").alias("occurrences"), F.min("first_id").alias("first_id"), F.min_by("first_pr", "first_id").alias("first_pr"), F.max("last_id").alias("last_id"), F.max_by("last_pr", "last_id").alias("last_pr"),
        F.min_by("example", "first_id").alias("example"),
    )


def remember(spark: SparkSession, landing: str, memory: str, checkpoint: str) -> None:
    """Reads new files of findings (JSON lines) and adds each batch's summary to the memory, a Parquet folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice."""

    def add(batch: DataFrame, number: int) -> None:
        summary(batch).write.mode("overwrite").parquet(f"{memory}/batches/batch={number}")

    stream = spark.readStream.schema(FINDINGS).json(landing)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _finished(folder: str, key: str) -> list[int]:
    """The numbers of a folder's finished writes (key=number), in order: those that Spark has marked as a success."""
    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    numbers = {int(x.base_name.split("=")[1]): x.path for x in found if x.base_name.startswith(f"{key}=")}
    return sorted(n for n, path in numbers.items() if system.get_file_info(f"{path}/_SUCCESS").type == fs.FileType.File)


def recalled(spark: SparkSession, memory: str) -> DataFrame:
    """The memory as it stands: the last compaction and the batches after it."""
    compacted, batches = _finished(f"{memory}/compacted", "upto"), _finished(f"{memory}/batches", "batch")
    upto = compacted[-1] if compacted else -1
    paths = [f"{memory}/compacted/upto={upto}"] * bool(compacted) + [f"{memory}/batches/batch={n}" for n in batches if n > upto]
    parts = spark.read.parquet(*paths) if paths else summary(spark.createDataFrame([], FINDINGS))
    return combined(parts)


def compact(spark: SparkSession, memory: str) -> int | None:
    """Writes the memory as one table, which later recalls read in place of its batches, and returns the last batch in it; None if there is nothing new.

    The table counts from the moment that its write is marked as a success: until then, and if it fails, the batches are read. A batch that is run
    again after it is in a compaction changes nothing."""
    batches, compacted = _finished(f"{memory}/batches", "batch"), _finished(f"{memory}/compacted", "upto")
    if not batches or compacted and compacted[-1] >= batches[-1]:
        return None
    recalled(spark, memory).write.mode("overwrite").parquet(f"{memory}/compacted/upto={batches[-1]}")
    return batches[-1]


def refreshed(spark: SparkSession, path: str, now: str, make: Callable[[], DataFrame], days: int = 7) -> bool:
    """Makes a result anew if the last one is more than ``days`` whole days old at ``now`` (a UTC time), or there is none; whether it did. Each result is a
    folder with its time, so readers of the last one aren't disturbed, and one that fails half way is passed over."""
    at = int(datetime.fromisoformat(now).replace(tzinfo=timezone.utc).timestamp())
    done = _finished(path, "at")
    if done and (at - done[-1]) // 86400 <= days:
        return False
    make().write.mode("overwrite").parquet(f"{path}/at={at}")
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last result that ``refreshed`` has finished."""
    return spark.read.parquet(f"{path}/at={_finished(path, 'at')[-1]}")


def stale(spark: SparkSession, path: str, now: str, days: int = 7) -> DataFrame:
    """(path, age) of the files that are more than ``days`` whole days old at ``now`` (a UTC time)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("modificationTime")) / 86400).alias("age"))
    return files.where(F.col("age") > days)
