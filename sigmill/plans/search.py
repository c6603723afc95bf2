"""Date, tag and intent filtered release search with gated answers: ``orders`` stand for releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.sources.tables import load

NOW = "2026-02-11"
# The questions of the registered queries.
QUESTIONS = (
    "any cve for chrome", "latest hotfix for macos", "is there a breaking api change", "what version of node is out", "hello there",
    "updates from yesterday", "security issues this week", "patches in the last 7 days", "what was released last week", "releases this month", "fixes last month", "is it safe today",
)
# Relevance keywords with the weight 1 each; a repeated one counts twice.
KEYWORDS = ("error", "mit", "license", "the", "broken", "broken")
_DATE = "strftime(o_orderdate, '%Y%m%d')"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each document, by its number."""
    text = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("doc_id") % len(QUESTIONS) + 1).cast("int"))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("question"))


def intent(q: Column) -> Column:
    """cve before patch, breaking, version and general; null is general."""
    has = lambda p: F.lower(q).rlike(p)
    return F.when(has("cve|vulnerab|security"), "cve").when(has("patch|hotfix"), "patch").when(has("break|deprecat|migrat"), "breaking").when(has("version|update|release"), "version").otherwise("general")


def date_range_of(q: Column, now: Column) -> Column:
    """The (from, to) dates that a relative phrase names, both inclusive; null without a phrase. Weeks run from Sunday to Saturday."""
    sunday = F.date_sub(now, (F.dayofweek(now) - 1))
    month = F.trunc(now, "month")
    days = F.regexp_extract(F.lower(q), r"last (\d{1,4}) days", 1)
    span = lambda a, b: F.struct(a.cast("date").alias("from"), b.cast("date").alias("to"))
    has = lambda p: F.lower(q).contains(p)
    return (
        F.when(has("yesterday"), span(F.date_sub(now, 1), F.date_sub(now, 1))).when(has("today"), span(now, now)).when(has("tomorrow"), span(F.date_add(now, 1), F.date_add(now, 1)))
        .when(has("this week"), span(sunday, F.date_add(sunday, 6))).when(has("last week"), span(F.date_sub(sunday, 7), F.date_sub(sunday, 1)))
        .when(has("this month"), span(month, F.last_day(now))).when(has("last month"), span(F.add_months(month, -1), F.date_sub(month, 1)))
        .when(days != "", span(F.date_sub(now, days.try_cast("int")), now))
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("tag"))


def newest(found: DataFrame, key: str, k: int) -> DataFrame:
    """Each key's k newest rows (date, then id) with the total found before the cut."""
    of = W.partitionBy(key)
    totals = found.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    ranked = found.withColumn("rank", F.row_number().over(of.orderBy(F.desc("date"), "id")).cast("long")).where(F.col("rank") <= k)
    return ranked.join(totals, key)


def _search(spark: SparkSession, sf_dir: str, where: Column) -> DataFrame:
    named = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("software"))
    return newest(releases(spark, sf_dir).where(where).join(named, "cust"), "software", 20).select("software", "rank", "id", "date", "total")


def search_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, F.lower("tag").contains("urgent"))


def search_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, F.col("channel").isin("P", "F"))


def search_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, F.coalesce(F.col("channel") == "F", F.lit(False)) | F.col("tag").rlike("(?i)high|urgent"))


def search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of the software that is asked for by name, whatever its case and outer spaces: each fiftieth customer's."""
    named = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.lower(F.trim("c_name")).alias("key"))
    asked = load(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("name")).select(F.lower(F.trim("name")).alias("key")).distinct()
    return releases(spark, sf_dir).join(named.join(asked, "key"), "cust").select("key", "id", "date")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by their first line."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n")[0].alias("title"))


def post_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten posts of strongest value for each kind of event, with a name: kind, rank and user."""
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc(F.abs(F.col("value") - 250)), "event_id"))
    rows = load(spark, sf_dir, "events").withColumn("rank", rank).where("rank <= 10")
    return rows.select("event_id", F.format_string("%s %d (%s)", F.initcap("event_type"), "rank", F.col("user_id").cast("string")).alias("label"))


def date_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The releases of each channel's newest date."""
    rows = releases(spark, sf_dir)
    last = rows.groupBy("channel").agg(F.max("date").alias("date"))  # small or not is known when it has run: adaptive execution picks the join
    return rows.join(last, ["channel", "date"]).select("channel", "date", "id")


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases(spark, sf_dir).where(F.col("date").between("19980101", "19980331")).select("id", F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2), F.substring("date", 7, 2)).alias("date"))


def broad_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases(spark, sf_dir).where(F.col("tag").isin("1-URGENT", "5-LOW")).orderBy(F.desc("date"), "id").limit(10).select("id", "date", "tag")


def merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All existing releases, and the incoming ones whose customer and date none of them has; repeats within the incoming ones stay."""
    rows = releases(spark, sf_dir).select("id", "cust", "date")
    held, new = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")
    seen = held.select(F.col("cust").alias("c"), F.col("date").alias("d")).distinct()
    return held.unionByName(new.join(seen, F.col("cust").eqNullSafe(F.col("c")) & F.col("date").eqNullSafe(F.col("d")), "left_anti"))


def tag_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isin("1", "7")).select("event_id", "event_type")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("tag")).agg(F.count(F.lit(1)).alias("events"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most relevant documents of each language: one point for each keyword that the text holds anywhere, repeated keywords again."""
    score = sum((F.lower("text").contains(k).cast("long") for k in KEYWORDS), F.lit(0).cast("long"))
    docs = load(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", score.alias("relevance"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("relevance"), F.desc("n_chars"), "doc_id")).cast("long")
    return docs.withColumn("rank", rank).where("rank <= 3")


def negative_only_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of toxic documents that no other labelled document has."""
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    each = docs.select("toxic", F.explode(X.words(F.col("text"))).alias("word"))
    sides = each.groupBy("word").agg(F.max("toxic").alias("most"), F.min("toxic").alias("least"))
    return sides.where("least = 1 AND most = 1").select("word")


def intent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", "question", intent(F.col("question")).alias("intent"))


def date_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = date_range_of(F.col("question"), F.lit(NOW).cast("date"))
    kind = F.when(F.lower("question").contains("latest"), "latest").when(F.col("span.from") == F.col("span.to"), "exact").when(F.col("span").isNotNull(), "range")
    return questions(spark, sf_dir).withColumn("span", span).select("id", kind.alias("kind"), F.col("span.from").cast("string").alias("since"), F.col("span.to").cast("string").alias("until"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of each document: topic, entity, retrieval, entries (more than one line), completeness; the fourth has no weight."""
    docs = load(spark, sf_dir, "documents")
    filled = sum((F.nullif(F.col(c), F.lit("")).isNotNull().cast("long") for c in ("text", "lang", "source")), F.lit(0)) + F.col("n_chars").isNotNull().cast("long")
    g1 = F.when(F.lower("text").contains("update"), 0.85).otherwise(0.6)
    g2 = F.when(X.version_last(F.col("text")).isNotNull(), 0.95).otherwise(0.55)
    return docs.select("doc_id", g1.alias("g1"), g2.alias("g2"), F.when(F.col("n_chars") >= 200, 1.0).otherwise(0.0).alias("g3"), F.when(F.col("text").contains("\n"), 1.0).otherwise(0.0).alias("g4"), (filled / 4).alias("g5"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", F.round("g5", 3).alias("completeness"))


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing gate, the composite of the gates and the decision: below 0.6, or at a failing gate, it abstains."""
    g = _gated(spark, sf_dir)
    failed = F.when(F.col("g1") < 0.6, 1).when(F.col("g2") < 0.7, 2).when(F.col("g3") == 0, 3).when(F.col("g4") == 0, 4).when(F.col("g5") < 0.3, 5)
    composite = 0.25 * (F.col("g1") + F.col("g2") + F.col("g3") + F.col("g5"))
    out = g.select("doc_id", failed.cast("long").alias("failed_gate"), F.round(composite, 3).alias("composite"))
    return out.withColumn("decision", F.when(F.col("failed_gate").isNotNull() | (F.col("composite") < 0.6), "abstain").otherwise("confident"))


QUERIES = {f.__name__: f for f in (search_breaking, search_patch, search_cve, search_name, first_lines, post_labels, date_latest, date_range, broad_top10, merge_dedupe, tag_contains, tag_counts, relevance, negative_only_words, intent_class, date_phrase, completeness, gate_decision)}
_SEARCH = lambda where: f"SELECT software, rank, id, date, total FROM (SELECT c_mktsegment AS software, o_orderkey AS id, {_DATE} AS date, count(*) OVER (PARTITION BY c_mktsegment) AS total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_DATE} DESC, o_orderkey) AS rank FROM orders JOIN customer ON c_custkey = o_custkey WHERE {where}) WHERE rank <= 20"
_Q = "(SELECT doc_id AS id, [" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"][doc_id % {len(QUESTIONS)} + 1] AS question FROM documents)"
_D = f"DATE '{NOW}'"
_SUN = f"({_D} - CAST(dayofweek({_D}) AS INTEGER))"
_SPAN = {
    "yesterday": (f"{_D} - 1", f"{_D} - 1"), "today": (_D, _D), "tomorrow": (f"{_D} + 1", f"{_D} + 1"), "this week": (_SUN, f"{_SUN} + 6"), "last week": (f"{_SUN} - 7", f"{_SUN} - 1"),
    "this month": (f"date_trunc('month', {_D})", f"last_day({_D})"), "last month": (f"date_trunc('month', {_D}) - INTERVAL 1 MONTH", f"date_trunc('month', {_D}) - INTERVAL 1 DAY"),
}
_WHEN = lambda side: "CASE " + " ".join(f"WHEN contains(question, '{p}') THEN CAST(CAST({s[side]} AS DATE) AS VARCHAR)" for p, s in _SPAN.items()) + " WHEN contains(question, 'last 7 days') THEN CAST(" + (f"{_D} - 7", _D)[side] + " AS VARCHAR) END"
_GATES = rf"""SELECT doc_id, CASE WHEN contains(lower(text), 'update') THEN 0.85 ELSE 0.6 END AS g1, CASE WHEN regexp_matches(text, '{X.VERSION}') THEN 0.95 ELSE 0.55 END AS g2,
  CASE WHEN n_chars >= 200 THEN 1.0 ELSE 0.0 END AS g3, contains(text, chr(10)) AS g4, ((nullif(text, '') IS NOT NULL)::INT + (nullif(lang, '') IS NOT NULL)::INT + (nullif(source, '') IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT) / 4 AS g5 FROM documents"""
ORACLE = {
    "search_breaking": _SEARCH("contains(lower(o_orderpriority), 'urgent')"),
    "search_patch": _SEARCH("o_orderstatus IN ('P', 'F')"),
    "search_cve": _SEARCH("o_orderstatus = 'F' OR regexp_matches(lower(o_orderpriority), 'high|urgent')"),
    "search_name": f"SELECT lower(trim(c_name)) AS key, o_orderkey AS id, {_DATE} AS date FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(trim(c_name)) IN (SELECT lower(trim(c_name)) FROM customer WHERE c_custkey % 50 = 0)",
    "first_lines": "SELECT conv_id, turn, string_split(text, chr(10))[1] AS title FROM conversations",
    "post_labels": """SELECT event_id, upper(event_type[1]) || event_type[2:] || ' ' || rank || ' (' || user_id || ')' AS label FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 250) DESC, event_id) AS rank FROM events) WHERE rank <= 10""",
    "date_latest": f"SELECT channel, date, id FROM (SELECT o_orderstatus AS channel, {_DATE} AS date, o_orderkey AS id, max({_DATE}) OVER (PARTITION BY o_orderstatus) AS last FROM orders) WHERE date = last",
    "date_range": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01'",
    "broad_top10": f"SELECT o_orderkey AS id, {_DATE} AS date, o_orderpriority AS tag FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY date DESC, id LIMIT 10",
    "merge_dedupe": f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS cust, {_DATE} AS date FROM orders), h AS (SELECT * FROM r WHERE id % 3 <> 0)
      SELECT * FROM h UNION ALL SELECT * FROM r WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.cust = r.cust AND h.date = r.date)""",
    "tag_contains": "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') IN ('1', '7')",
    "tag_counts": "SELECT event_type, json_extract_string(props, '$.k') AS tag, count(*) AS events FROM events GROUP BY 1, 2",
    "relevance": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY relevance DESC, n_chars DESC, doc_id) AS rank FROM (
      SELECT lang, doc_id, n_chars, {' + '.join(f"contains(lower(text), '{k}')::BIGINT" for k in KEYWORDS)} AS relevance FROM documents)) WHERE rank <= 3""",
    "negative_only_words": f"""WITH w AS (SELECT DISTINCT toxic, unnest(regexp_extract_all(lower(text), '{X.WORD}')) AS word FROM documents JOIN labels USING (doc_id))
      SELECT word FROM w WHERE toxic = 1 EXCEPT SELECT word FROM w WHERE toxic = 0""",
    "intent_class": f"""SELECT id, question, CASE WHEN regexp_matches(question, 'cve|vulnerab|security') THEN 'cve' WHEN regexp_matches(question, 'patch|hotfix') THEN 'patch'
      WHEN regexp_matches(question, 'break|deprecat|migrat') THEN 'breaking' WHEN regexp_matches(question, 'version|update|release') THEN 'version' ELSE 'general' END AS intent FROM {_Q}""",
    "date_phrase": f"SELECT id, CASE WHEN contains(question, 'latest') THEN 'latest' WHEN since = until THEN 'exact' WHEN since IS NOT NULL THEN 'range' END AS kind, since, until FROM (SELECT id, question, {_WHEN(0)} AS since, {_WHEN(1)} AS until FROM {_Q})",
    "completeness": f"SELECT doc_id, round(g5, 3) AS completeness FROM ({_GATES})",
    "gate_decision": f"""SELECT *, CASE WHEN failed_gate IS NOT NULL OR composite < 0.6 THEN 'abstain' ELSE 'confident' END AS decision FROM (SELECT doc_id,
      CAST(CASE WHEN g1 < 0.6 THEN 1 WHEN g2 < 0.7 THEN 2 WHEN g3 = 0 THEN 3 WHEN NOT g4 THEN 4 WHEN g5 < 0.3 THEN 5 END AS BIGINT) AS failed_gate, round(CAST(0.25 * (g1::DOUBLE + g2::DOUBLE + g3::DOUBLE + g5) AS DOUBLE), 3) AS composite FROM ({_GATES}))""",
}
