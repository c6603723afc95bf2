"""Exact duplicates by a heavy-hitter split.

1. Each text becomes its sha256, written once: later passes read 40 bytes a row, never the texts.
2. Misra-Gries: each task keeps COUNTERS counters of digests. Summed over the tasks, a counter is below the digest's true count by
   1 / (COUNTERS + 1) of all rows at most, so every digest with more than 2 / (COUNTERS + 1) of the rows keeps a sum above
   1 / (COUNTERS + 1) of them; as all sums add up to no more than all rows, at most COUNTERS digests can: a proven bound, not a cut.
3. A second pass counts these candidates exactly and finds each one's winner (map-side, COUNTERS rows a task at most).
   The verified winners are broadcast: copies of frequent texts are decided, or removed, where they are read.
4. The other digests, each below 2 / (COUNTERS + 1) of the rows, are shuffled by digest.

Null texts count as empty, empty texts are equal. Of equal texts the row with the largest doc_id stays; rows that share it stay
together, so a repeated row is never lost; null doc_ids come before all others, and if a group has no other, all its rows stay.
An empty table gives an empty result. Other columns are ignored, or kept by ``deduplicated``. Two texts are taken as equal if
their sha256 agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.shared import table, unused, written

#: Misra-Gries counters of a task: a digest with more than 2 / (COUNTERS + 1) of all rows is always found.
COUNTERS = 1024


def digest(text: str | Column = "text") -> Column:
    """The binary sha256 of a text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def summary(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Misra-Gries: at most ``counters`` of the counts, each less the largest count that doesn't fit."""
    if len(counts) <= counters:
        return counts
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    less = int(np.partition(values, len(values) - counters - 1)[len(values) - counters - 1])
    return {k: v - less for k, v in counts.items() if v > less}


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, estimate) of at most ``counters`` digests, all those with more than 2 / (counters + 1) of the rows among them."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        rows = 0
        for part in parts:
            rows += part.num_rows
            for x in pc.value_counts(part.column(0)).to_pylist():
                kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
            kept = summary(kept, counters)
        yield pa.RecordBatch.from_arrays([pa.array([None, *kept], pa.binary()), pa.array([rows, *kept.values()], pa.int64())], names=["digest", "estimate"])

    # a null digest has the number of all rows
    sums = written(digests.select("digest").mapInArrow(count, "digest binary, estimate long").groupBy("digest").agg(F.sum("estimate").alias("estimate")))
    rows = sums.where("digest is null").agg(F.sum("estimate")).first()[0] or 0
    return sums.where(F.col("digest").isNotNull() & (F.col("estimate") * (counters + 1) > F.lit(rows)))


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests, counted exactly; at most ``counters`` rows."""
    some = digests.join(F.broadcast(frequent(digests, counters)), "digest", "left_semi")
    return written(some.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def decisions(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row of ``docs`` (doc_id, text)."""
    digests = written(docs.select("doc_id", digest().alias("digest")))
    heavy = F.broadcast(winners(digests, counters))
    same = W.partitionBy("digest")
    decided = digests.join(heavy, "digest").select("doc_id", "digest", "keep_id", "group_size")
    rest = digests.join(heavy, "digest", "left_anti").select("doc_id", "digest", F.max("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return decided.unionAll(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: copies of frequent texts go on the map side, the losers among
    the other rows by an anti join on digest and doc_id."""
    d, keep, gone, lost = (unused(docs, x) for x in ("digest", "keep_id", "group_size", "gone"))
    with_digest = docs.withColumn(d, digest())
    found = written(with_digest.select("doc_id", F.col(d).alias("digest")))
    heavy = winners(found, counters)
    light = found.join(F.broadcast(heavy), "digest", "left_anti")
    best = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    losers = light.join(best, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("digest").alias(gone), F.col("doc_id").alias(lost)).distinct()
    here = with_digest.join(F.broadcast(heavy.select(F.col("digest").alias(gone), F.col("keep_id").alias(keep))), F.col(d) == F.col(gone), "left")
    here = here.where(F.col(gone).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))).drop(gone, keep)
    return here.join(losers, (F.col(d) == F.col(gone)) & F.col("doc_id").eqNullSafe(F.col(lost)), "left_anti").drop(d)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLE = {
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
}
