"""Keyword labels, mentions and enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import text as X

#: Terms up to which a lexicon is broadcast; a larger one is joined by shuffle.
MOST_TERMS = 100_000


def sized(df: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def keyword_labels(docs: DataFrame, lexicon: DataFrame, taxonomy: str, default: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with labels, the sorted categories whose terms are words of the text.

    Terms match whole words only, so one of several words or with punctuation never does. Without a match labels
    holds ``default`` alone, or nothing."""
    terms = lexicon.where(F.col("taxonomy") == taxonomy).select("category", F.lower("term").alias("term")).distinct()
    found = docs.select("doc_id", F.explode(X.words(F.col("text"))).alias("term")).join(sized(terms), "term")
    labels = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("category")).alias("labels"))
    none = F.array(F.lit(default)) if default else F.array().cast("array<string>")
    return docs.drop("labels").join(labels, "doc_id", "left").withColumn("labels", F.coalesce("labels", none))


def with_security(labels: Column, is_security: Column) -> Column:
    """SECURITY joins the labels, and UNKNOWN leaves, where the flag is true; null flags change nothing."""
    return F.when(is_security, F.array_sort(F.array_remove(F.array_union(labels, F.array(F.lit("SECURITY"))), "UNKNOWN"))).otherwise(labels)


def rollup_mentions(posts: DataFrame, k: int = 5) -> DataFrame:
    """One row a mention out of posts (ord, created, source, url, mentions): the number of posts, the earliest, its sources, its first k urls.

    The earliest ignores null times, ties go to the smaller ord."""
    each = posts.select("ord", "created", "source", "url", F.explode("mentions").alias("mention"))
    first = F.min(F.when(F.col("created").isNotNull(), F.struct("created", "ord")))
    out = each.groupBy("mention").agg(
        F.count(F.lit(1)).alias("posts"), first.alias("first"), F.array_join(F.array_sort(F.collect_set(F.nullif("source", F.lit("")))), ";").alias("sources")
    )
    urls = first_k_distinct(each.select("mention", "url", "ord"), "mention", "url", k).groupBy("mention").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]), ";").alias("urls"))
    return out.join(urls, "mention", "left").select("mention", "posts", F.col("first.created").alias("created"), F.col("first.ord").alias("ord"), "sources", "urls")


def first_k_distinct(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, value, rank): each key's first k distinct values by ord."""
    once = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min("ord").alias("ord"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("ord", value)).cast("long")).where(F.col("rank") <= k).drop("ord")


def by_lead(rows: DataFrame, lead: str, posts: str, key: str) -> DataFrame:
    """``rows`` in order of their lead, longest first and missing ones last; then of the number of posts, 0 where it can't be read; then of the key."""
    return rows.orderBy(F.coalesce(lead, F.lit(-1e9)).desc(), F.coalesce(F.col(posts).try_cast("bigint"), F.lit(0)).desc(), key)


def lead(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, earliest, ...) with published from ``lookup``, found, and the lead in days and hours: positive where ``rows`` came first."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("published") - micros("earliest")) / 1e6
    joined = rows.join(lookup.withColumn("_in", F.lit(True)), key, "left").withColumn("found", F.coalesce("_in", F.lit(False))).drop("_in")
    return joined.withColumn("lead_days", F.round(seconds / 86400, 3)).withColumn("lead_hours", F.round(seconds / 3600, 3))
