"""Exact medians of few keys with any number of rows: the interval that holds the middle is narrowed by counts until few values are left in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that an interval is cut into at a time; values that are sorted at the end.
PARTS, FEW = 1024, 10_000


def medians(df: DataFrame, key: str, value: str, parts: int = PARTS, few: int = FEW) -> DataFrame:
    """(key, median) of doubles: the middle value, or the mean of the two. Null values and keys are left out. Each pass counts on the map side; the driver holds PARTS
    numbers for each key, which are few."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("k is not null and v is not null").persist()
    try:
        known = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        # of each key and rank: the interval that holds it, the rows before the interval, and those in it
        open_ = {(r.k, at): (r.low, r.high, 0, r.n) for r in known for at in {(r.n - 1) // 2, r.n // 2}}
        values = {}
        while True:
            values |= {t: low for t, (low, high, _, _) in open_.items() if low == high}
            open_ = {t: x for t, x in open_.items() if t not in values}
            wide = sorted({(t[0], x[0], x[1]) for t, x in open_.items() if x[3] > few}, key=repr)
            if not wide:
                break
            asked = spark.createDataFrame(wide, f"k {kind}, low double, high double")
            inside = rows.join(F.broadcast(asked), "k").where("v between low and high")
            place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * parts), F.lit(parts - 1))
            found: dict = {}
            for r in inside.groupBy("k", "low", "high", place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k", "low", "high", "p").collect():
                found.setdefault((r.k, r.low, r.high), []).append(r)
            for t, (low, high, before, _) in list(open_.items()):
                for r in found.get((t[0], low, high), ()):
                    if t[1] < before + r.n:
                        open_[t] = (r.a, r.b, before, r.n)
                        break
                    before += r.n
        if open_:
            asked = spark.createDataFrame(sorted({(t[0], x[0], x[1]) for t, x in open_.items()}, key=repr), f"k {kind}, low double, high double")
            inside = rows.join(F.broadcast(asked), "k").where("v between low and high")
            last = {(r.k, r.low, r.high): r.x for r in inside.groupBy("k", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("x")).collect()}
            values |= {t: last[(t[0], low, high)][t[1] - before] for t, (low, high, before, _) in open_.items()}
    finally:
        rows.unpersist()
    out = [(r.k, (values[(r.k, (r.n - 1) // 2)] + values[(r.k, r.n // 2)]) / 2) for r in known]
    return spark.createDataFrame(out, f"{key} {kind}, median double")
