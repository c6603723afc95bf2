"""Trajectory queries: users of ``events`` stand for posts, purchases and signups for the author's comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import selection as M
from sigmill.operators import trajectory as T
from sigmill.sources.tables import load

_SCORED = """SELECT user_id AS post, CASE WHEN event_type IN ('purchase', 'signup') THEN 'author' ELSE 'community' END AS side,
  ts, event_id AS ord, value / 250.0 - 1 AS score FROM events"""
_SEQ = f"""SELECT *, row_number() OVER (PARTITION BY post, side ORDER BY ts, ord) - 1 AS seq, count(*) OVER (PARTITION BY post, side) AS n,
  abs(score - lag(score) OVER (PARTITION BY post, side ORDER BY ts, ord)) AS step FROM ({_SCORED})"""
_STATS = f"""SELECT post, side, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS low, max(score) AS high,
  var_pop(score) AS variance, coalesce(avg(step), 0) AS volatility, coalesce(regr_slope(score, seq), 0) AS slope,
  CASE WHEN count(*) < 4 THEN 0 ELSE avg(score) FILTER (seq >= n // 2) - avg(score) FILTER (seq < n // 2) END AS shift,
  CASE WHEN count(*) < 2 THEN 0 ELSE 0.4 * least(count(*) / 10, 1) + 0.3 * greatest(0, 1 - var_pop(score))
    + 0.3 * CASE WHEN count(*) >= 3 THEN least(2 * abs(regr_slope(score, seq)), 1) ELSE 0 END END AS reliability
  FROM ({_SEQ}) GROUP BY post, side"""
_SIDES = ", ".join(f"coalesce(max({c}) FILTER (side = '{s}'), 0) AS {s}_{c}" for s in ("author", "community") for c in ("n", "mean", "shift", "reliability"))
_QUALITY = f"""SELECT *, abs(author_mean - community_mean) AS divergence,
  0.3 * (author_n / 10) + 0.3 * (community_n / 20) + 0.2 * author_reliability + 0.2 * community_reliability AS quality
  FROM (SELECT post, {_SIDES} FROM ({_STATS}) GROUP BY post)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("purchase", "signup"), "author").otherwise("community")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("post"), side.alias("side"), "ts", F.col("event_id").alias("ord"), (F.col("value") / 250.0 - 1).alias("score"))


def _rounded(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(c, 3).alias(c) for c in cols])


def _rounded_sql(keys: str, cols: list[str], source: str) -> str:
    return f"SELECT {keys}, {', '.join(f'round({c}, 3) AS {c}' for c in cols)} FROM ({source})"


def traj_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sequenced(scored(spark, sf_dir)).select("post", "side", (F.col("seq") + 1).cast("long").alias("x"), F.round("score", 3).alias("y"))


def traj_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rounded(T.stats(scored(spark, sf_dir)), ["post", "side", "n"], ["mean", "std", "low", "high", "slope", "volatility"])
    return df.withColumn("trend", T.trend_word(F.col("slope")))


def traj_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.stats(scored(spark, sf_dir)), ["post", "side", "n"], ["shift"])


def traj_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.stats(scored(spark, sf_dir)), ["post", "side", "n"], ["variance", "reliability"])


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quality(T.stats(scored(spark, sf_dir)))


def traj_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with three author and five community comments or more, and a quality of 0.3 or more."""
    kept = _quality(spark, sf_dir).where("author_n >= 3 AND community_n >= 5 AND quality >= 0.3")
    return _rounded(kept, ["post", "author_n", "community_n"], ["author_mean", "community_mean", "divergence", "quality"])


def divergence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round("divergence", 3)
    band = F.when(d < 0.2, "low").when(d < 0.5, "moderate").otherwise("high")
    counted = _quality(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("posts"))
    return counted.withColumn("percent", F.round(100 * F.col("posts") / F.sum("posts").over(W.partitionBy(F.lit(1))), 3))


def trend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.round("shift", 3)
    word = F.when(s > 0.05, "improving").when(s < -0.05, "declining").otherwise("stable")
    return T.stats(scored(spark, sf_dir)).groupBy("side", word.alias("trend")).agg(F.count(F.lit(1)).alias("posts"))


def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("side", T.zone(F.col("score")).alias("zone")).agg(F.count(F.lit(1)).alias("comments"))


def topk_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three posts of each sentiment class with the best quality, then the strongest sentiment."""
    q = _quality(spark, sf_dir).select("post", F.round("quality", 3).alias("quality"), F.round("community_mean", 3).alias("compound"))
    q = q.withColumn("class", T.sentiment_class(F.col("compound")))
    rank = F.row_number().over(W.partitionBy("class").orderBy(F.desc("quality"), F.desc(F.abs("compound")), "post"))
    return q.withColumn("rank", rank.cast("long")).where("rank <= 3")


def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 20 lowest scores, the first five and the last five."""
    top = scored(spark, sf_dir).orderBy("score", "ord").limit(20)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy("score", "ord")).cast("long"))
    return ranked.where("rank <= 5 OR rank > 15").select("rank", "post", "ord", F.round("score", 3).alias("score"))


def overview_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and population deviation; author figures only over posts where the author replied, divergence where above 0."""
    q = _quality(spark, sf_dir)
    author, diverging = F.when(F.col("author_n") > 0, F.col("author_mean")), F.when(F.col("divergence") > 0, F.col("divergence"))
    metrics = [(n, c) for n, c in (("author", author), ("divergence", diverging), ("quality", F.col("quality")))]
    long = q.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("v")) for n, c in metrics])).alias("x")).select("x.*")
    out = long.groupBy("metric").agg(F.count("v").alias("n"), *[F.round(f("v"), 3).alias(a) for f, a in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"), (F.stddev_pop, "std"))])
    return out.join(F.broadcast(M.medians(long, "metric", "v").withColumn("median", F.round("median", 3))), "metric", "left")


def side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author and community turns of each conversation, and whether it passes the engagement gate."""
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("author"), F.count_if(F.col("role") != "user").alias("community")
    )
    return turns.withColumn("engaged", (F.col("author") >= 3) & (F.col("community") >= 5))


QUERIES = {f.__name__: f for f in (traj_points, traj_stats, traj_shift, traj_reliability, traj_quality, divergence_bands, trend_counts, zone_counts, topk_per_class, head_tail, overview_stats, side_counts)}
_CLASS = "CASE WHEN compound >= 0.05 THEN 'Positive' WHEN compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END"
ORACLE = {
    "traj_points": f"SELECT post, side, seq + 1 AS x, round(score, 3) AS y FROM ({_SEQ})",
    "traj_stats": "SELECT *, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS trend FROM ("
    + _rounded_sql("post, side, n", ["mean", "std", "low", "high", "slope", "volatility"], _STATS) + ")",
    "traj_shift": _rounded_sql("post, side, n", ["shift"], _STATS),
    "traj_reliability": _rounded_sql("post, side, n", ["variance", "reliability"], _STATS),
    "traj_quality": _rounded_sql("post, author_n, community_n", ["author_mean", "community_mean", "divergence", "quality"], f"SELECT * FROM ({_QUALITY}) WHERE author_n >= 3 AND community_n >= 5 AND quality >= 0.3"),
    "divergence_bands": f"""SELECT band, count(*) AS posts, round(100 * count(*) / sum(count(*)) OVER (), 3) AS percent FROM (
      SELECT CASE WHEN round(divergence, 3) < 0.2 THEN 'low' WHEN round(divergence, 3) < 0.5 THEN 'moderate' ELSE 'high' END AS band FROM ({_QUALITY})) GROUP BY band""",
    "trend_counts": f"""SELECT side, CASE WHEN round(shift, 3) > 0.05 THEN 'improving' WHEN round(shift, 3) < -0.05 THEN 'declining' ELSE 'stable' END AS trend,
      count(*) AS posts FROM ({_STATS}) GROUP BY 1, 2""",
    "zone_counts": f"SELECT side, CASE WHEN score > 0.25 THEN 'positive' WHEN score < -0.25 THEN 'negative' ELSE 'neutral' END AS zone, count(*) AS comments FROM ({_SCORED}) GROUP BY 1, 2",
    "topk_per_class": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY quality DESC, abs(compound) DESC, post) AS rank FROM (
      SELECT *, {_CLASS} AS class FROM (SELECT post, round(quality, 3) AS quality, round(community_mean, 3) AS compound FROM ({_QUALITY})))) WHERE rank <= 3""",
    "head_tail": f"""SELECT rank, post, ord, round(score, 3) AS score FROM (SELECT *, row_number() OVER (ORDER BY score, ord) AS rank FROM ({_SCORED}))
      WHERE rank <= 5 OR rank BETWEEN 16 AND 20""",
    "overview_stats": f"""SELECT metric, count(v) AS n, round(avg(v), 3) AS mean, round(median(v), 3) AS median, round(min(v), 3) AS low, round(max(v), 3) AS high,
      round(stddev_pop(v), 3) AS std FROM (SELECT 'author' AS metric, CASE WHEN author_n > 0 THEN author_mean END AS v FROM ({_QUALITY})
      UNION ALL SELECT 'divergence', CASE WHEN divergence > 0 THEN divergence END FROM ({_QUALITY}) UNION ALL SELECT 'quality', quality FROM ({_QUALITY})) GROUP BY metric""",
    "side_counts": """SELECT *, author >= 3 AND community >= 5 AS engaged FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS author,
      count(*) FILTER (role <> 'user') AS community FROM conversations GROUP BY conv_id)""",
}
