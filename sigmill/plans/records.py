"""Record queries: documents stand for nested records whose fields go by different names, parts for vulnerability entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.operators import records as R
from sigmill.sources.tables import load

#: A record of three kinds by doc_id, as text, in Spark's SQL and in DuckDB's: only the names of functions differ.
_HEAD = "regexp_replace(substring(text, 1, 60), '[^A-Za-z0-9 .,]', ' ', 'g')"
_RECORD = """concat('{"', CASE doc_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'postTitle' ELSE 'name' END, '":"', head, '","', CASE doc_id % 2 WHEN 0 THEN 'selftext' ELSE 'content' END, '":"', lang,
 '","', CASE doc_id % 3 WHEN 0 THEN 'sub' ELSE 'subreddit' END, '":', CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE concat('"', source, '"') END, ',"', CASE doc_id % 2 WHEN 0 THEN 'ups' ELSE 'score' END, '":', CAST(n_chars AS STRING),
 ',"', CASE doc_id % 4 WHEN 0 THEN 'redditId' WHEN 1 THEN 'postId' ELSE 'id' END, '":"p', CAST(doc_id AS STRING), '"',
 CASE doc_id % 4 WHEN 0 THEN concat(',"created_utc":"2024-01-0', CAST(1 + doc_id % 9 AS STRING), 'T10:00:00Z"') WHEN 1 THEN concat(',"created":"soon","timestamp":', CAST(1700000000 + doc_id AS STRING)) WHEN 2 THEN concat(',"dateCreated":"', CAST(1600000000 + doc_id AS STRING), '"') ELSE '' END,
 CASE WHEN doc_id % 3 = 0 THEN concat(',"modified":"2025-02-03T04:05:06+02:00"') ELSE '' END,
 ',"comments":[{"body":"see cve-2024-', CAST(1000 + doc_id % 50 AS STRING), '.","deep":{"a":{"b":{"c":{"d":"CVE-2020-1111"}}}}},{"body":"', CASE WHEN doc_id % 2 = 0 THEN concat('CVE-2024-', CAST(1000 + doc_id % 30 AS STRING)) ELSE 'CVE-2024-12345678' END, '"}],"n":', CAST(doc_id AS STRING), '}')"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("head", F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z0-9 .,]", " "))
    return docs.select("doc_id", F.expr(_RECORD).alias("record"))


def _texts(a: Column) -> Column:
    return F.array_join(a, ";")


def record_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", *[R.alias(F.col("record"), n).alias(n) for n in R.ALIASES])


def string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", F.explode(R.string_leaves(F.col("record"))).alias("x")).select("doc_id", "x.path", "x.value")


def record_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cves, paths = R.identifiers(F.col("leaves"))
    return _records(spark, sf_dir).withColumn("leaves", R.string_leaves(F.col("record"))).select("doc_id", _texts(cves).alias("cves"), _texts(paths).alias("paths"))


def record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("doc_id", R.created(F.col("record")).alias("c"), R.updated(F.col("record")).alias("u"))
    return rows.select("doc_id", F.col("c.field").alias("created_field"), R.iso(F.col("c.at")).alias("created"), F.col("u.field").alias("updated_field"), R.iso(F.col("u.at")).alias("updated"))


def record_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.normalised(_records(spark, sf_dir)).drop("record")


def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit(R.normalised(_records(spark, sf_dir)))


def record_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each identifier, with its earliest time and sources."""
    normal = R.normalised(_records(spark, sf_dir))
    each = normal.select(F.explode(F.split("cves", ";")).alias("cve"), "created_epoch", "subreddit").where("cve <> ''")
    out = each.groupBy("cve").agg(F.count(F.lit(1)).alias("post_count"), F.min("created_epoch").alias("earliest"), _texts(F.array_sort(F.collect_set(F.nullif("subreddit", F.lit(""))))).alias("subreddits"))
    return out.orderBy(F.desc("post_count"), "cve")


def mention_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents name a version token, of all; the share is null for an empty table."""
    has = F.col("text").rlike(X.VERSION)
    out = load(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("posts"), F.count_if(has).alias("with_mention"))
    return out.withColumn("share", F.round(F.try_divide("with_mention", "posts"), 6))


def url_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of page urls (each gets one by its number), and of tags."""
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("#cve-2023-"), F.col("page_id").cast("string"))).otherwise(""))
    tags = F.when(F.col("page_id") % 4 > 0, F.array(F.lit("news"), F.when(F.col("page_id") % 4 == 1, "CVE2024").otherwise("cve-24")))
    return load(spark, sf_dir, "pages").select("page_id", R.identifier_of_url(url).alias("cve"), R.tagged(tags).alias("tagged"))


#: A vulnerability entry of a part, as text.
_ENTRY = """concat('{"metrics":{', CASE p_partkey % 4 WHEN 0 THEN concat('"cvssMetricV31":[{"cvssData":{"baseScore":', CAST(p_size AS STRING), ',"baseSeverity":"HIGH","vectorString":"V31"}}],"cvssMetricV2":[{"cvssData":{"baseScore":1}}]')
 WHEN 1 THEN concat('"cvssMetricV31":[],"cvssMetricV30":[{"cvssData":{"baseScore":', CAST(p_size AS STRING), ',"vectorString":"V30"},"baseSeverity":"LOW"}]')
 WHEN 2 THEN concat('"cvssMetricV2":[{"cvssData":{"baseScore":', CAST(p_size AS STRING), '},"baseSeverity":"MEDIUM"},{"cvssData":{"baseScore":99}}]') ELSE '"cvssMetricV40":[{}]' END,
 '},"configurations":', CASE WHEN p_partkey % 3 = 0 THEN '[]' ELSE concat('[{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:a:', lower(p_brand), ':x"},{"criteria":"cpe:2.3:a:*:y"},{"criteria":"cpe:2.3"}]},{"cpeMatch":[{"criteria":"cpe:2.3:a:acme:z"}]}]}]') END, '}')"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("p_partkey") % 6 == 0, F.concat("p_name", F.lit(" for Python on Docker"))).otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", F.expr(_ENTRY).alias("entry"), note.alias("note"))


def cvss_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, severity, vector = R.cvss(F.col("entry"))
    return _entries(spark, sf_dir).select("p_partkey", score.alias("score"), severity.alias("severity"), vector.alias("vector"))


def vendor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    configurations = F.from_json(F.get_json_object("entry", "$.configurations"), R.CONFIGURATIONS)
    return _entries(spark, sf_dir).select("p_partkey", R.vendors(configurations, F.col("note")).alias("vendors"))


QUERIES = {f.__name__: f for f in (record_alias, string_leaves, record_cves, record_times, record_normal, record_audit, record_rollup, mention_share, url_cve, cvss_pick, vendor_list)}
_R = f"(SELECT doc_id, {_RECORD.replace('STRING', 'VARCHAR')} AS record FROM (SELECT *, {_HEAD} AS head FROM documents))"
_PICK = lambda keys: "coalesce(" + ", ".join(f"json_extract_string(record, '$.{k}')" for k in keys) + ")"
_ALIAS = ", ".join(f"{_PICK(keys) if n == 'score' else f'coalesce({_PICK(keys)}, {chr(39)*2})'} AS {n}" for n, keys in R.ALIASES.items())
_LEAVES = f"""(SELECT doc_id, substr(t.fullkey, 3) AS path, t.value ->> '$' AS value FROM {_R} r, json_tree(r.record) t
  WHERE t.type = 'VARCHAR' AND len(regexp_extract_all(t.fullkey, '[.\\[]')) <= {R.DEPTH})"""
_CVES = f"""(SELECT d.doc_id, coalesce(c.cves, '') AS cves, coalesce(c.n, 0) AS n, coalesce(p.paths, '') AS paths FROM documents d
  LEFT JOIN (SELECT doc_id, string_agg(DISTINCT c, ';' ORDER BY c) AS cves, count(DISTINCT c) AS n FROM (SELECT doc_id, upper(unnest(regexp_extract_all(value, '{X.CVE}'))) AS c FROM {_LEAVES}) GROUP BY 1) c USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(DISTINCT path, ';' ORDER BY path) AS paths FROM {_LEAVES} WHERE regexp_matches(value, '{X.CVE}') GROUP BY 1) p USING (doc_id))"""
_ISO = lambda t: f"strftime({t}, '%Y-%m-%dT%H:%M:%S+00:00')"
_TIMES = f"""(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'created_utc' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'dateCreated' END AS cf,
  CASE doc_id % 4 WHEN 0 THEN CAST(json_extract_string(record, '$.created_utc')[:19] AS TIMESTAMP) WHEN 1 THEN make_timestamp(CAST(json_extract_string(record, '$.timestamp') AS BIGINT) * 1000000)
    WHEN 2 THEN make_timestamp(CAST(json_extract_string(record, '$.dateCreated') AS BIGINT) * 1000000) END AS c,
  CASE WHEN doc_id % 3 = 0 THEN 'modified' END AS uf, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2025-02-03 02:05:06' END AS u FROM {_R})"""
_NORMAL = f"""(SELECT doc_id, {_ALIAS}, cves, n AS cve_count, paths AS cve_paths, coalesce(cf, '') AS created_field, coalesce({_ISO('c')}, '') AS created_iso_utc, epoch(c)::BIGINT AS created_epoch,
  coalesce(uf, '') AS updated_field, coalesce({_ISO('u')}, '') AS updated_iso_utc, epoch(u)::BIGINT AS updated_epoch FROM {_R} r JOIN {_CVES} v USING (doc_id) JOIN {_TIMES} t USING (doc_id))"""
_E = f"(SELECT p_partkey, p_brand, p_name, p_size, {_ENTRY.replace('STRING', 'VARCHAR')} AS entry FROM part)"
_WORDS = ", ".join(f"('{k}', '{v}')" for k, v in R.VENDORS.items())
ORACLE = {
    "record_alias": f"SELECT doc_id, {_ALIAS} FROM {_R}",
    "string_leaves": f"SELECT doc_id, path, value FROM {_LEAVES}",
    "record_cves": f"SELECT doc_id, cves, paths FROM {_CVES}",
    "record_times": f"SELECT doc_id, cf AS created_field, {_ISO('c')} AS created, uf AS updated_field, {_ISO('u')} AS updated FROM {_TIMES}",
    "record_normal": f"SELECT * FROM {_NORMAL}",
    "record_audit": f"SELECT post_id, subreddit, created_iso_utc, substr(title, 1, 140) AS title, cves, substr(cve_paths, 1, 320) AS cve_paths, url FROM {_NORMAL} WHERE cve_count > 0",
    "record_rollup": f"""SELECT cve, count(*) AS post_count, min(created_epoch) AS earliest, coalesce(string_agg(DISTINCT nullif(subreddit, ''), ';' ORDER BY nullif(subreddit, '')), '') AS subreddits
      FROM (SELECT unnest(string_split(cves, ';')) AS cve, created_epoch, subreddit FROM {_NORMAL} WHERE cve_count > 0) GROUP BY 1""",
    "mention_share": f"SELECT count(*) AS posts, count(*) FILTER (regexp_matches(text, '{X.VERSION}')) AS with_mention, round(count(*) FILTER (regexp_matches(text, '{X.VERSION}')) / count(*), 6) AS share FROM documents",
    "url_cve": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'CVE-2023-' || page_id END AS cve, page_id % 4 = 1 AS tagged FROM pages""",
    "cvss_pick": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE CAST(p_size AS VARCHAR) END AS score, CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE '' END AS severity,
      CASE p_partkey % 4 WHEN 0 THEN 'V31' WHEN 1 THEN 'V30' ELSE '' END AS vector FROM part""",
    "vendor_list": f"""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN array_to_string(list_sort(list_distinct(['acme', lower(p_brand)])), ';') ELSE coalesce((SELECT string_agg(v, ';' ORDER BY v) FROM (VALUES {_WORDS}) w(k, v)
      WHERE contains(lower(CASE WHEN p_partkey % 6 = 0 THEN p_name || ' for Python on Docker' ELSE p_name END), k)), '') END AS vendors FROM part""",
}
