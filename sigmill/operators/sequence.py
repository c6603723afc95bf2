"""Rows of a key in order, where one key may hold most rows: numbers, neighbours and carried values that no single task works out.

Rows are dealt to slices by their place in the order, with cuts out of a bounded sample; a key's rows of one slice are a window of their own, and what
crosses slices (counts, last values) is a row for each key and slice. Cuts only deal out the work: results don't depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the sample that cuts are taken from; rows of a slice, about; slices at most.
SAMPLE, ROWS, SLICES = 5_000, 1_000_000, 200


def sliced(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` with _slice, whose number rises with ``order`` (nulls first); as many slices as its rows need, or ``slices``. Rows that need one only are left as they are."""
    many = slices or min(SLICES, -(-df.count() // ROWS))
    if many <= 1:
        return df
    some = df.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLE).orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()
    cuts = [some[len(some) * k // many] for k in range(1, many)] if some else []
    types = [df.schema[c].dataType for c in order]
    place = F.struct(*order)
    borders = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, cut, types, strict=True)]) for cut in dict.fromkeys(cuts)])
    return df.withColumn("_slice", F.size(F.filter(borders, lambda b: b <= place)) if cuts else F.lit(0))


def _ordered(keys: list[str], order: list[str], slices: bool = True) -> W:
    return W.partitionBy(*keys, *["_slice"] * slices).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def _joined(rows: DataFrame, parts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the columns of their key's slice; keys may be null."""
    renamed = parts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_slice").alias("_of_slice"), *columns)
    same = F.col("_slice") == F.col("_of_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(renamed, same).drop("_of_slice", *[f"_of_{k}" for k in keys])


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``sliced`` rows with seq, the number from 0 within their key, and n, the key's rows."""
    if "_slice" not in rows.columns:
        alone = rows.withColumn("seq", F.row_number().over(_ordered(keys, order, False)) - 1)
        return alone.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    counts = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    parts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("n", F.sum("_c").over(W.partitionBy(*keys)))
    own = rows.withColumn("seq", F.row_number().over(_ordered(keys, order)) - 1)
    return _joined(own, parts, keys, ["_before", "n"]).withColumn("seq", F.col("seq") + F.col("_before")).drop("_before")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """``sliced`` rows with ``name``: the last value that isn't null up to them in their key, or ``before`` them."""
    if "_slice" not in rows.columns:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(_ordered(keys, order, False).rowsBetween(W.unboundedPreceding, -1 if before else 0)))
    held = rows.withColumn("_value", value)
    place = F.struct(*order)
    last = held.where("_value is not null").groupBy(*keys, "_slice").agg(F.max_by("_value", place).alias("_last"))
    every = held.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    parts = _joined_left(every, last, keys)
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_from", F.last("_last", ignorenulls=True).over(earlier))
    upto = _ordered(keys, order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    own = held.withColumn("_own", F.last("_value", ignorenulls=True).over(upto))
    return _joined(own, parts, keys, ["_from"]).withColumn(name, F.coalesce("_own", "_from")).drop("_own", "_from", "_value")


def _joined_left(every: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    renamed = last.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_slice").alias("_of_slice"), "_last")
    same = F.col("_slice") == F.col("_of_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return every.join(renamed, same, "left").drop("_of_slice", *[f"_of_{k}" for k in keys])
