"""Answer queries: ``orders`` stand for release entries, conversations for posts with replies, events and pages for further sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import answers as A
from sigmill.sources.tables import load

WEIGHTS = {"cve": 3.0, "release": 2.0, "news": 1.0}
_K = "o_orderkey"
#: Columns of an entry, as SQL of both engines.
_ENTRY = {
    "id": _K, "cust": "o_custkey", "number": f"CASE WHEN {_K} % 9 = 0 THEN '' ELSE concat(CAST({_K} % 9 AS VARCHAR(9)), '.', CAST({_K} % 7 AS VARCHAR(9))) END", "brand": f"CASE WHEN {_K} % 4 = 0 THEN NULL WHEN {_K} % 4 = 1 THEN '' ELSE o_orderpriority END",
    "name": "o_orderstatus", "channel": f"CASE WHEN {_K} % 5 = 0 THEN 'hotfix' WHEN {_K} % 5 = 1 THEN '' ELSE 'stable' END", "url": f"CASE WHEN {_K} % 6 = 0 THEN concat('https://nvd.nist.gov/vuln/CVE-2024-', CAST({_K} AS VARCHAR(20))) WHEN {_K} % 6 = 1 THEN NULL ELSE 'https://x.example/r' END",
    "notes": "concat('Total ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)), '. Fixed it! And? more words')", "is_cve": f"CASE WHEN {_K} % 8 = 0 THEN true WHEN {_K} % 8 = 1 THEN NULL ELSE false END",
}
_SPARK_LISTS = {
    "tags": f"CASE WHEN {_K} % 7 = 0 THEN array('News', 'Security fix') WHEN {_K} % 7 = 1 THEN NULL ELSE array('news') END", "search_tags": f"CASE WHEN {_K} % 10 = 0 THEN array('CVE-2024', 'network issues') ELSE array() END",
    "breaking": f"CASE WHEN {_K} % 3 = 0 THEN array('Network Issues') WHEN {_K} % 3 = 1 THEN array() END", "security": f"CASE WHEN {_K} % 11 = 0 THEN array('SECURITY') ELSE array('UNKNOWN') END",
}


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders")
    made = {k: F.expr(v.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")) for k, v in {**_ENTRY, **_SPARK_LISTS}.items()}
    date = F.when(F.col(_K) % 13 == 0, "").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return rows.select(*[c.alias(k) for k, c in made.items()], date.alias("date"))


def release_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    e = e.where(A.about_vulnerability(e))
    return e.select("id", *A.answer(e, vulnerable=True))


def release_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return e.select("id", A.about_failure(e).alias("any_failure"), A.about_failure(e, "network ISSUES").alias("network"))


def release_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.on_dates(_entries(spark, sf_dir), "latest").select("id", "date")


def release_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.on_dates(_entries(spark, sf_dir), "exact", "19970101").select("id", "date")


def release_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return e.select("id", A.passage(e).alias("passage"), A.passage(e, 180, " ").alias("plain"))


def release_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return e.select("id", F.array_join(A.phrases(e, e["name"], F.lit("HIGH")), "|").alias("phrases"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", A.sentences(F.regexp_replace("text", r"\s+", " ")).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("sentences"), F.array_join("s", "|").alias("joined"))


def rerank_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest entries, the first five of them by price."""
    e = _entries(spark, sf_dir).join(load(spark, sf_dir, "orders").select(F.col(_K).alias("id"), F.col("o_totalprice").alias("score")), "id")
    return A.reranked(e, "cust", F.struct(-F.col("id")), F.col("score"), 5).select("cust", "id", "place")


def post_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations about usability and about defects, by their first turn and replies; the user is the author."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    title = turns.where("turn = 0").select("conv_id", F.concat(F.substring("text", 1, 80), F.when(F.col("conv_id") % 3 == 0, " build broken").when(F.col("conv_id") % 3 == 1, " fix").otherwise("")).alias("title"))
    around = A.context(turns.where("turn > 0"), "conv_id", F.col("turn"), F.col("role") == "user", "text")
    rows = title.join(around, "conv_id", "left")
    return rows.select("conv_id", A.relevance(F.col("title"), F.col("context"), A.USABILITY, A.DEFECTS).alias("usability"), A.relevance(F.col("title"), F.col("context"), A.DEFECTS, A.USABILITY).alias("defects"))


def topic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents pass as questions, with a model's rejection of every third one."""
    update, intent = F.lower("text").contains("update"), F.lower("text").rlike("error|update|token")
    score, relevant = A.topic(update, intent)
    kept = A.overridden(relevant, (F.col("doc_id") % 10) / 10, F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.5))
    return load(spark, sf_dir, "documents").select("doc_id", score.alias("score"), kept.alias("relevant"), A.broad_composite(relevant).alias("broad"))


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three sources in one shape, each text cut."""
    cut = lambda c: F.substring(c, 1, 500)
    docs = load(spark, sf_dir, "documents").select(F.lit("release").alias("kind"), F.col("doc_id").alias("idx"), cut("text").alias("title"))
    pages = load(spark, sf_dir, "pages").select(F.lit("news").alias("kind"), F.col("page_id").alias("idx"), cut("url").alias("title"))
    items = load(spark, sf_dir, "benchmark").select(F.lit("cve").alias("kind"), F.col("item_id").alias("idx"), cut("text").alias("title"))
    return docs.unionByName(pages).unionByName(items)


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_sources(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("signals"), F.sum(F.length("title")).alias("letters"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of events to rows of the three sources, some of them to none."""
    kind = F.element_at(F.array(F.lit("cve"), F.lit("release"), F.lit("news")), (F.col("event_id") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", F.concat(kind, F.lit(":"), F.when(F.col("event_id") % 17 == 0, "x").otherwise((F.col("event_id") % 300).cast("string"))).alias("ref"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged_sources(spark, sf_dir)
    sources = {k: rows.where(F.col("kind") == k) for k in WEIGHTS}
    return A.resolved(_references(spark, sf_dir), sources).select("event_id", "ref", F.length("title").alias("width"))


def evidence_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evidence_mix(_references(spark, sf_dir), WEIGHTS)


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates passed and failed of each document, and of answers with no entries."""
    gates = F.array(F.col("n_chars") >= 200, F.col("text").contains("the"), F.col("lang") == "en", F.col("doc_id") % 2 == 0)
    rows = load(spark, sf_dir, "documents").select("doc_id", gates.alias("g"))
    return rows.select("doc_id", F.size(F.filter("g", lambda x: x)).alias("passed"), F.size(F.filter("g", lambda x: ~x)).alias("failed"))


QUERIES = {f.__name__: f for f in (release_cve, release_failures, release_latest, release_exact, release_passages, release_phrases, sentence_split, rerank_first, post_relevance, topic_gate, merged_sources, source_counts, evidence, evidence_mix, gate_counts)}
_LISTS = {k: v.replace("array(", "[").replace(")", "]") for k, v in _SPARK_LISTS.items()}
_E = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in {**_ENTRY, **_LISTS}.items()) + f", CASE WHEN {_K} % 13 = 0 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS date FROM orders)"
_ANY = lambda c, p: f"coalesce(len(list_filter({c}, lambda t: regexp_matches(t, '{p}'))) > 0, false)"
_IDENT = "nullif(upper(regexp_extract(url, '(?i)CVE-\\d{4}-\\d+')), '')"
_DAY = "CASE WHEN length(date) = 8 THEN date[:4] || '-' || date[5:6] || '-' || date[7:] ELSE nullif(date, '') END"
_NAME = "coalesce(nullif(brand, ''), nullif(name, ''))"
_PASSAGE = lambda n, sep: f"concat_ws('{sep}', {_NAME}, CASE WHEN number <> '' THEN 'v' || number END, nullif(channel, ''), CASE WHEN is_cve THEN 'CVE security vulnerability' END, nullif(substr(notes, 1, {n}), ''))"
_COUNT = lambda c, words: "(" + " + ".join("contains({}, '{}')::BIGINT".format(c, w.replace("'", "''")) for w in words) + ")"
_RELEVANCE = lambda own, other: f"CASE WHEN {_COUNT('title', own)} = 0 AND {_COUNT('title', other)} > 0 THEN 0 ELSE 9 * {_COUNT('title', own)} + {_COUNT('around', own)} END"
_SOURCES = "(SELECT 'release' AS kind, doc_id AS idx, substr(text, 1, 500) AS title FROM documents UNION ALL SELECT 'news', page_id, substr(url, 1, 500) FROM pages UNION ALL SELECT 'cve', item_id, substr(text, 1, 500) FROM benchmark)"
_REFS = "(SELECT event_id, ['cve', 'release', 'news'][event_id % 3 + 1] AS kind, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 300 END AS idx FROM events)"
_MIX = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " END"
ORACLE = {
    "release_cve": f"""SELECT id, nullif(number, '') AS version, {_NAME} AS name, {_DAY} AS date, nullif(url, '') AS url, coalesce({_IDENT}, id::VARCHAR) AS cve_id FROM {_E} WHERE coalesce(is_cve, false) OR coalesce(contains(url, 'nvd.nist.gov'), false)
      OR list_contains(security, 'SECURITY') OR {_ANY('tags', '(?i)security|vulnerability|cve')} OR {_ANY('search_tags', '(?i)cve-?[0-9]{4}')}""",
    "release_failures": f"SELECT id, coalesce(len(breaking) > 0, false) AS any_failure, coalesce(list_contains(breaking, 'Network Issues'), false) OR coalesce(list_contains(search_tags, 'network issues'), false) AS network FROM {_E}",
    "release_latest": f"SELECT id, date FROM {_E} WHERE date = (SELECT max(date) FROM {_E})",
    "release_exact": f"SELECT id, date FROM {_E} WHERE date = '19970101'",
    "release_passages": f"SELECT id, {_PASSAGE(200, ' — ')} AS passage, {_PASSAGE(180, ' ')} AS plain FROM {_E}",
    "release_phrases": f"""SELECT id, array_to_string(list_filter(['software ' || nullif(name, ''), 'version ' || nullif(number, ''), 'released ' || nullif(date, ''), nullif(channel, '') || ' release channel', 'CVE identifier ' || {_IDENT}, 'severity HIGH', nullif(substr(notes, 1, 200), '')],
      lambda p: p IS NOT NULL AND length(trim(p)) > 4), '|') AS phrases FROM {_E}""",
    "sentence_split": r"""SELECT conv_id, turn, len(s)::INT AS sentences, array_to_string(s, '|') AS joined FROM (SELECT conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 8) AS s FROM conversations)""",
    "rerank_first": f"""WITH r AS (SELECT o_custkey AS cust, {_K} AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY {_K} DESC) AS n FROM orders)
      SELECT cust, id, row_number() OVER (PARTITION BY cust ORDER BY CASE WHEN n <= 5 THEN -score ELSE 1e300 END, n) AS place FROM r""",
    "post_relevance": f"""WITH t AS (SELECT conv_id, lower(substr(text, 1, 80) || CASE conv_id % 3 WHEN 0 THEN ' build broken' WHEN 1 THEN ' fix' ELSE '' END) AS title FROM conversations WHERE turn = 0),
      s AS (SELECT conv_id, role <> 'user' AS side, substr(text, 1, 200) AS x, row_number() OVER (PARTITION BY conv_id, role <> 'user' ORDER BY turn) AS n FROM conversations WHERE turn > 0),
      a AS (SELECT conv_id, lower(string_agg(x, ' ' ORDER BY side, n)) AS around FROM s WHERE n <= CASE WHEN side THEN 5 ELSE 3 END GROUP BY 1), j AS (SELECT conv_id, title, coalesce(around, '') AS around FROM t LEFT JOIN a USING (conv_id))
      SELECT conv_id, {_RELEVANCE(A.USABILITY, A.DEFECTS)} AS usability, {_RELEVANCE(A.DEFECTS, A.USABILITY)} AS defects FROM j""",
    "topic_gate": """WITH d AS (SELECT doc_id, contains(lower(text), 'update') AS u, regexp_matches(lower(text), 'error|update|token') AS i FROM documents)
      SELECT doc_id, greatest(CASE WHEN i THEN 0.85 ELSE 0.6 END, CASE WHEN u THEN 0.7 ELSE 0.0 END)::DOUBLE AS score, NOT (doc_id % 3 = 0 AND NOT (doc_id % 10 >= 7 AND doc_id % 2 = 1)) AS relevant, 0.925::DOUBLE AS broad FROM d""",
    "merged_sources": f"SELECT * FROM {_SOURCES}",
    "source_counts": f"SELECT kind, count(*) AS signals, sum(length(title)) AS letters FROM {_SOURCES} GROUP BY 1",
    "evidence": f"SELECT event_id, r.kind || ':' || coalesce(r.idx::VARCHAR, 'x') AS ref, length(title) AS width FROM {_REFS} r LEFT JOIN {_SOURCES} s ON s.kind = r.kind AND s.idx = r.idx",
    "evidence_mix": f"SELECT kind, count(*) AS found, round(100 * count(*) * ({_MIX})::DOUBLE / sum(count(*) * ({_MIX})::DOUBLE) OVER (), 3) AS percent FROM {_REFS} GROUP BY kind",
    "gate_counts": """SELECT doc_id, p::INT AS passed, (4 - p)::INT AS failed FROM (SELECT doc_id, (n_chars >= 200)::INT + contains(text, 'the')::INT + (lang = 'en')::INT + (doc_id % 2 = 0)::INT AS p FROM documents)""",
}
