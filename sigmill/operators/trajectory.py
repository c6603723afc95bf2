"""Sentiment trajectories: ordered scores per post and side, with their shift, trend, volatility, reliability and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators import sequence as Q


def sentiment_class(score: Column) -> Column:
    """Positive from 0.05, Negative to -0.05, else Neutral; null scores are Neutral."""
    return F.when(score >= 0.05, "Positive").when(score <= -0.05, "Negative").otherwise("Neutral")


def zone(score: Column) -> Column:
    return F.when(score > 0.25, "positive").when(score < -0.25, "negative").otherwise("neutral")


def trend_word(slope: Column) -> Column:
    return F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable")


def sequenced(scored: DataFrame, slices: int | None = None) -> DataFrame:
    """``scored`` (post, side, ts, ord, score) with seq from 0 and n, the length, within post and side. Times that are texts are ordered as texts, missing ones come first.
    A post's rows are numbered slice by slice, so one with most of all comments is no single task's work."""
    return Q.numbered(Q.sliced(scored, ["ts", "ord"], slices), ["post", "side"], ["ts", "ord"]).drop("_slice")


def stats(scored: DataFrame, slices: int | None = None) -> DataFrame:
    """One row for each post and side: n, mean, std, low, high, slope, variance, volatility, shift, reliability (unrounded).

    The slope needs two points, the reliability's part of it three; a shift needs four; volatility two. All are sums that tasks add up."""
    keys, order = ["post", "side"], ["ts", "ord"]
    numbered = Q.numbered(Q.sliced(scored, order, slices), keys, order)
    # a missing score is a step's missing end, not the one before it: the pair tells it from a missing row
    rows = Q.carried(numbered, keys, order, F.struct("score"), "_before", before=True).withColumn("step", F.abs(F.col("score") - F.col("_before.score")))
    half = F.floor(F.col("n") / 2)
    out = rows.groupBy("post", "side").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.var_pop("score").alias("variance"),
        F.regr_slope("score", "seq").alias("fit"),
        F.coalesce(F.avg("step"), F.lit(0.0)).alias("volatility"),
        F.avg(F.when(F.col("seq") < half, F.col("score"))).alias("early"),
        F.avg(F.when(F.col("seq") >= half, F.col("score"))).alias("late"),
    )
    slope = F.when(F.col("n") >= 2, F.coalesce("fit", F.lit(0.0))).otherwise(0.0)
    steep = F.when(F.col("n") >= 3, F.least(2 * F.abs(F.coalesce("fit", F.lit(0.0))), F.lit(1.0))).otherwise(0.0)
    reliable = 0.4 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("variance")) + 0.3 * steep
    return out.select(
        "post", "side", "n", "mean", "std", "low", "high", "variance", "volatility",
        slope.alias("slope"),
        F.when(F.col("n") < 4, 0.0).otherwise(F.col("late") - F.col("early")).alias("shift"),
        F.when(F.col("n") < 2, 0.0).otherwise(reliable).alias("reliability"),
    )


def quality(of_sides: DataFrame) -> DataFrame:
    """One row a post out of stats(): counts, means, divergence and shifts of both sides, and the overall quality (no upper bound)."""
    at = lambda side, c, none: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(none))
    sides = [at(s, c, 0 if c == "n" else 0.0).alias(f"{s}_{c}") for s in ("author", "community") for c in ("n", "mean", "shift", "reliability")]
    out = of_sides.groupBy("post").agg(*sides)
    score = 0.3 * (F.col("author_n") / 10) + 0.3 * (F.col("community_n") / 20) + 0.2 * F.col("author_reliability") + 0.2 * F.col("community_reliability")
    return out.withColumn("divergence", F.abs(F.col("author_mean") - F.col("community_mean"))).withColumn("quality", score)
