"""URL filters as a temporal list join.

List entries are dated events: from its day on, a key (a host suffix, or a host with a path prefix) is blocked or
allowed, until the key's next event. Events become validity intervals, and every capture is joined with the
entries of its own keys that are active at its fetch time. The most specific active entry decides: a longer path
before a shorter one, then a longer host before a shorter one. Captures are reduced to distinct (url, fetch time)
before the join, so a host or url with very many captures is decided once for each.

Null and odd urls have no keys: they are not blocked, entry and action are null. Captures with null fetch time match
nothing either. Several events of a key on one day: the last by action name (block over allow) holds. An empty list
blocks nothing. Repeated rows give equal rows. Other columns pass through, but for those that the result adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.shared import table

#: Intervals up to which the list is broadcast; a longer list is joined by shuffle.
MOST_BROADCAST = 200_000

# The dated list entries of the registered query (key, action, day).
ENTRIES = (
    ("casino-win.example.com", "block", "2024-01-01"),
    ("casino-win.example.com", "allow", "2024-07-01"),
    ("free-bets.example.com", "block", "2024-03-15"),
    ("example.net", "block", "2024-05-01"),
    ("example.net", "allow", "2024-06-01"),
    ("tionsh.example.net/de", "block", "2024-02-01"),
    ("tionsh.example.net/de", "allow", "2024-11-01"),
    ("example.org", "block", "2024-09-01"),
    ("blog.ththth.example.org", "allow", "2024-01-01"),
    ("example.com/en", "block", "2024-12-01"),
)

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of dated events (key, action, day); until is null for a key's last event."""
    day = entries.select(F.lower(F.element_at(F.split("key", "/", 2), 1)).alias("host"), F.element_at(F.split("key", "/", 2), -1).alias("rest"), "key", "action", F.col("day").cast("date").alias("since"))
    key = F.when(F.instr("key", "/") > 0, F.concat("host", F.lit("/"), "rest")).otherwise(F.col("host"))
    one = day.select(key.alias("key"), "action", "since").where("key is not null and since is not null").groupBy("key", "since").agg(F.max("action").alias("action"))
    return one.withColumn("until", F.lead("since").over(W.partitionBy("key").orderBy("since")))


def keys_of(url: Column, depth: int, most: int) -> Column:
    """Every key that may stand for a url: each suffix of its host of ``most`` labels at most, alone and with each prefix of its path of ``depth`` parts at most."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.slice(F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != ""), 1, depth)
    prefixes = F.concat(F.array(F.lit("")), F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>")))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched date, ...) with the entry and action that hold at the fetch, and whether it is blocked."""
    captures = captures.drop("entry", "action", "blocked")
    spans = intervals(entries)
    # longer prefixes and hosts than the list has match nothing, so long ones cost no more than the list's longest
    host = F.size(F.split(F.element_at(F.split("key", "/"), 1), r"\."))
    size = spans.agg(F.coalesce(F.max(host), F.lit(1)).alias("labels"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(F.split("key", "/")) - 1), F.lit(0)).alias("depth")).first()
    if size.n <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    asked = captures.select("url", "fetched").distinct().where("url is not null and fetched is not null")
    each = asked.select("url", "fetched", F.explode(keys_of(F.col("url"), size.depth, size.labels)).alias("key"))
    active = each.join(spans, "key").where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    path = F.when(F.instr("key", "/") > 0, F.length("key") - F.instr("key", "/") + 1).otherwise(0)
    rank = F.struct(path.alias("path"), F.length("key").alias("long"), F.col("key").alias("key"), F.col("action").alias("action"))
    best = active.groupBy("url", "fetched").agg(F.max(rank).alias("best")).select(F.col("url").alias("_url"), F.col("fetched").alias("_fetched"), F.col("best.key").alias("entry"), F.col("best.action").alias("action"))
    out = captures.join(best, (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_fetched")), "left").drop("_url", "_fetched")
    return out.withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day of 2024 that follows its page_id, against the dated entries."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 7919, 366) as int))").alias("fetched"))
    entries = spark.createDataFrame(list(ENTRIES), "key string, action string, day string")
    return decide(pages, entries).select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "entry", "action", "blocked")


_VALUES = ", ".join(f"('{k}', '{a}', DATE '{d}')" for k, a, d in ENTRIES)
QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE = {
    "op8_url_filters": f"""
WITH events(key, action, since) AS (VALUES {_VALUES}),
spans AS (SELECT key, action, since, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM events),
captures AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched,
  lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
active AS (SELECT c.page_id, s.key, s.action,
  row_number() OVER (PARTITION BY c.page_id ORDER BY CASE WHEN contains(s.key, '/') THEN length(s.key) - instr(s.key, '/') + 1 ELSE 0 END DESC, length(s.key) DESC, s.key DESC) AS n
  FROM captures c JOIN spans s ON s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
  AND (c.host = split_part(s.key, '/', 1) OR ends_with(c.host, '.' || split_part(s.key, '/', 1)))
  AND (NOT contains(s.key, '/') OR c.path || '/' LIKE substr(s.key, instr(s.key, '/') + 1) || '/%'))
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, a.key AS entry, a.action AS action, coalesce(a.action = 'block', false) AS blocked
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.n = 1"""
}
