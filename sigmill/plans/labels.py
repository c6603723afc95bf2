"""Label, version, mention and enrichment queries over ``documents``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.operators import labels as L
from sigmill.sources.tables import load

# The lexicon of the registered queries (taxonomy, category, term).
LEXICON = (
    ("breaking", "api", "token"), ("breaking", "api", "key"), ("breaking", "removal", "the end"), ("breaking", "format", "rewh"),
    ("component", "license", "mit"), ("component", "license", "license"), ("component", "network", "thha"), ("component", "storage", "thnt"), ("component", "ui", "ui"),
    ("security", "secrets", "password"), ("security", "secrets", "token"), ("security", "exploit", "thre"), ("security", "exploit", "zero-day"),
)
STOP = ("the", "and", "that", "for", "was", "with", "this", "are", "from")
_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LEXICON)
_FOUND = f"""SELECT DISTINCT doc_id, taxonomy, category FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{X.WORD}')) AS term FROM documents)
  JOIN (VALUES {_VALUES}) AS l(taxonomy, category, term) USING (term)"""


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS l(taxonomy, category, term)")


def _labelled(spark: SparkSession, sf_dir: str, taxonomy: str, default: str | None = None) -> DataFrame:
    return L.keyword_labels(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"), lexicon(spark), taxonomy, default)


def kw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, "security", "UNKNOWN").select("doc_id", F.array_join("labels", ";").alias("labels"))


def kw_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _labelled(spark, sf_dir, "component").select("lang", F.explode("labels").alias("category"))
    return each.rollup("lang", "category").agg(F.count(F.lit(1)).alias("documents"))


def component_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, "component").select("doc_id", F.coalesce(F.array_min("labels"), F.lit("NONE")).alias("component"))


def security_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("flag"))
    df = _labelled(spark, sf_dir, "security", "UNKNOWN").join(flags, "doc_id", "left")
    labels = L.with_security(F.col("labels"), F.col("flag"))
    return df.select("doc_id", F.array_join(labels, ";").alias("labels"), F.exists(labels, lambda x: x != "UNKNOWN").alias("security"))


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _labelled(spark, sf_dir, "breaking", "UNKNOWN").select("lang", F.explode("labels").alias("label"))
    counted = each.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("documents"))
    return counted.withColumn("percent", F.round(100 * F.col("documents") / F.sum("documents").over(W.partitionBy("lang")), 3))


def version_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.version_last(F.col("text")).alias("version"))


def release_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_last(spark, sf_dir).groupBy(X.release_type(F.col("version")).alias("release_type")).agg(F.count(F.lit(1)).alias("documents"))


def breaking_version_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.breaking_version(F.col("text")).alias("breaking"))


def word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent words of three letters or more that are no stop words; ties by word."""
    plain = F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", ""), r"[ \t\n\r\f\v]+")
    each = load(spark, sf_dir, "documents").select(F.explode(plain).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(*STOP))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "word").limit(50)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: version tokens stand for mentions, doc_id * 1000 for the time, a cut source for the url."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), (F.col("doc_id") * 1000).alias("created"), "source", F.concat(F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("url"), X.mentions(F.col("text"), X.VERSION).alias("mentions"))


def mention_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.substring(F.array_join("mentions", ";"), 1, 320)
    return _posts(spark, sf_dir).where(F.size("mentions") > 0).select("ord", "source", cut.alias("mentions"))


def mention_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rollup_mentions(_posts(spark, sf_dir))


def first_k_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("ord"))
    return L.first_k_distinct(rows, "user_id", "event_type", 3)


def _lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("earliest"), F.col("o_orderpriority").alias("priority"))
    lookup = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_shipdate").alias("published"))
    return L.lead(rows, lookup, "key")


def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lead(spark, sf_dir).select("key", "found", "lead_days", "lead_hours")


def lead_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 longest leads; missing ones come last."""
    return _lead(spark, sf_dir).orderBy(F.coalesce("lead_days", F.lit(-1e9)).desc(), "priority", "key").select("key", "priority", "lead_days").limit(20)


def lookup_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count(F.lit(1)).alias("found"))


QUERIES = {f.__name__: f for f in (kw_labels, kw_rollup, component_primary, security_binary, label_distribution, version_last, release_type_counts, breaking_version_flag, word_freq, mention_audit, mention_rollup, first_k_distinct, lead_lag, lead_top, lookup_misses, severity_counts)}
_LABELS = lambda taxonomy: f"SELECT d.doc_id, d.lang, list_sort(list(f.category) FILTER (f.category IS NOT NULL)) AS labels FROM documents d LEFT JOIN (SELECT * FROM ({_FOUND}) WHERE taxonomy = '{taxonomy}') f USING (doc_id) GROUP BY d.doc_id, d.lang"
_LAST = f"SELECT doc_id, list_extract(regexp_extract_all(text, '{X.VERSION}'), -1) AS version FROM documents"
_POSTS = f"SELECT doc_id AS ord, doc_id * 1000 AS created, source, '/' || lang || '/' || (doc_id % 7) AS url, list_sort(list_distinct(regexp_extract_all(text, '{X.VERSION}'))) AS mentions FROM documents"
_MENTIONS = f"SELECT ord, created, source, url, unnest(mentions) AS mention FROM ({_POSTS})"
_LEADS = """SELECT o_orderkey AS key, o_orderpriority AS priority, l.p IS NOT NULL AS found, round(date_diff('microsecond', o_orderdate, l.p) / 1e6 / 86400, 3) AS lead_days,
  round(date_diff('microsecond', o_orderdate, l.p) / 1e6 / 3600, 3) AS lead_hours FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS p FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""
ORACLE = {
    "kw_labels": f"SELECT doc_id, coalesce(array_to_string(labels, ';'), 'UNKNOWN') AS labels FROM ({_LABELS('security')})",
    "kw_rollup": f"SELECT lang, category, count(*) AS documents FROM ({_FOUND}) f JOIN documents USING (doc_id) WHERE taxonomy = 'component' GROUP BY ROLLUP (lang, category)",
    "component_primary": f"SELECT doc_id, coalesce(labels[1], 'NONE') AS component FROM ({_LABELS('component')})",
    "security_binary": f"""SELECT doc_id, coalesce(array_to_string(l, ';'), 'UNKNOWN') AS labels, l IS NOT NULL AS security FROM (
      SELECT d.doc_id, CASE WHEN t.toxic = 1 THEN list_sort(list_append(coalesce(d.labels, []), 'SECURITY')) ELSE d.labels END AS l
      FROM ({_LABELS('security')}) d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) t USING (doc_id))""",
    "label_distribution": f"""SELECT lang, label, count(*) AS documents, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 3) AS percent
      FROM (SELECT lang, unnest(coalesce(labels, ['UNKNOWN'])) AS label FROM ({_LABELS('breaking')})) GROUP BY lang, label""",
    "version_last": _LAST,
    "release_type_counts": f"""SELECT CASE WHEN version IS NULL THEN 'UNKNOWN'
        WHEN len(p) >= 3 THEN CASE WHEN list_sum(p[2:]) = 0 THEN 'MAJOR' WHEN p[-1] = 0 THEN 'MINOR' ELSE 'PATCH' END
        WHEN p[-1] = 0 THEN 'MAJOR' ELSE 'MINOR' END AS release_type, count(*) AS documents
      FROM (SELECT version, CAST(string_split(version, '.') AS INTEGER[]) AS p FROM ({_LAST})) GROUP BY 1""",
    "breaking_version_flag": r"""SELECT doc_id, regexp_matches(text, '\b\d{1,2}\.0\.0\b') OR (regexp_matches(text, '\b\d{1,2}\.0\b')
      AND NOT regexp_matches(text, '\b\d{1,2}\.0\.\d+\b')) AS breaking FROM documents""",
    "word_freq": rf"""SELECT word, count(*) AS times FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '[ \t\n\r\f\v]+')) AS word FROM documents)
      WHERE length(word) > 2 AND word NOT IN {STOP} GROUP BY word ORDER BY times DESC, word LIMIT 50""",
    "mention_audit": f"SELECT ord, source, substr(array_to_string(mentions, ';'), 1, 320) AS mentions FROM ({_POSTS}) WHERE len(mentions) > 0",
    "mention_rollup": f"""WITH m AS ({_MENTIONS}), u AS (SELECT mention, url, min(ord) AS o FROM m GROUP BY ALL),
      r AS (SELECT mention, url, row_number() OVER (PARTITION BY mention ORDER BY o, url) AS n FROM u),
      k AS (SELECT mention, string_agg(url, ';' ORDER BY n) AS urls FROM r WHERE n <= 5 GROUP BY mention)
      SELECT mention, count(*) AS posts, min(created) AS created, min(ord) AS ord, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, any_value(urls) AS urls
      FROM m JOIN k USING (mention) GROUP BY mention""",
    "first_k_distinct": """SELECT user_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, event_type) AS rank FROM (
      SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL)) WHERE rank <= 3""",
    "lead_lag": f"SELECT key, found, lead_days, lead_hours FROM ({_LEADS})",
    "lead_top": f"SELECT key, priority, lead_days FROM ({_LEADS}) ORDER BY coalesce(lead_days, -1e9) DESC, priority, key LIMIT 20",
    "lookup_misses": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "severity_counts": "SELECT o_orderpriority AS severity, count(*) AS found FROM orders GROUP BY 1",
}
