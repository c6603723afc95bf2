"""Question queries: each document asks one question, chosen and completed by its number, about its language's software. The entities of
documents' own texts are found with a list of names, the phrases of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import dictionary as D
from sigmill.operators import entities as E
from sigmill.sources.tables import load

# The questions of the registered queries.
ASKED = (
    "Any critical failures in Windows 11.2 or Chrome 120.1 today?", "what is new in ubuntu 22.04 and docker", "Is my iPhone safe", "list all breaking changes for node.js", "CVE-2024 advisories for OpenSSL 3.0",
    "hotfixes for macos 14.1 on my MacBook", "Data loss after the upgrade of postgresql 16", "vs code version 1.90 beta", "hello there", "network issues with k8s and nginx", "Pixel 8 out of memory", "show every outage of github",
    "configuration errors in firefox", "what was released for Linux Mint 21.3", "security update for Galaxy", "latest changelog of python 3.13",
)
# The failures that questions name, the first one counts; the last stands for any.
FAILURES = (
    (r"\b(critical\s+fail(?:ure)?s?|critical\s+break)\b", "Critical Failure"), (r"\b(limited\s+function(?:ality)?)\b", "Limited Functionality"),
    (r"\b(breaking\s+updates?|breaking\s+changes?|breaking\s+releases?)\b", "Breaking Update"), (r"\b(network\s+issues?|network\s+failures?|network\s+problems?)\b", "Network Issues"),
    (r"\b(logging.{0,15}monitoring\s*failures?|log\s+failures?|monitoring\s+fails?)\b", "Logging & Monitoring Failures"), (r"\b(config(?:uration)?\s+errors?|config(?:uration)?\s+issues?)\b", "Configuration Errors"),
    (r"\b(data\s+integrity|data\s+corruption|data\s+loss)\b", "Data Integrity Issues"), (r"\b(compatibility\s+issues?|compatibility\s+problems?|incompatib)\b", "Compatibility Issues"),
    (r"\b(resource\s+exhaustion|resource\s+limit|out\s+of\s+memory|oom)\b", "Resource Exhaustion"), (r"\b(dependency\s+fail(?:ure)?s?|dependency\s+issues?|dependency\s+errors?)\b", "Dependency Failures"),
    (r"\b(failures?|breakings?|broke|broken|incidents?|outages?)\b", None),
)
#: Names of software that stand for a list of components.
LISTED = ("Node", "PostgreSQL", "Firefox", "Docker", "NodeJS", "VSCode", "Linux-Mint")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("doc_id") % len(ASKED) + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" v"), (F.col("doc_id") % 7).cast("string"))).otherwise("")).alias("question"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different question is parsed once."""
    q, asked = F.col("question"), _asked(spark, sf_dir)
    rows = asked.select("question").distinct().select("question", E.entities(F.lower(q)).alias("found"), E.versions(q).alias("versions"), E.breaking(q, FAILURES).alias("failure"))
    rows = rows.withColumn("intent", E.intent(q, F.col("versions"), F.col("failure").isNotNull())).withColumn("primary", E.primary(F.col("found")))
    return asked.join(rows, "question")


def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.kind", "x.name", "x.sure")


def entity_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("doc_id", "primary.kind", "primary.name", "primary.sure")


def entity_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("doc_id", E.overall(F.col("found")).alias("confidence"))


def question_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("doc_id", F.array_join("versions", ";").alias("versions"))


def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("doc_id", "intent", F.col("failure.at").alias("failure_no"), "failure.name", F.lower("question").rlike(E.ABOUT_ALL).alias("wants_all"))


def question_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question in its fixed form; those without an entity have none."""
    rows = _parsed(spark, sf_dir).where(F.col("primary").isNotNull())
    dates = F.when(F.col("question").contains("today"), " on 2026-02-11 (today)").otherwise("")
    return rows.select("doc_id", E.prompt(F.col("question"), F.col("primary.name"), F.col("versions"), F.col("intent"), F.col("failure.name"), dates).alias("prompt"))


def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed name of each question's entities."""
    names = spark.createDataFrame([(n,) for n in LISTED], "name string")
    parsed = _parsed(spark, sf_dir).select("doc_id", "question", F.explode("found").alias("x"))
    near = D.longest(_asked(spark, sf_dir).select("question").distinct(), "question", "question", names).withColumnRenamed("name", "near")
    asked = parsed.select("doc_id", "question", E.plain_name(F.col("x.name")).alias("entity")).join(near, "question", "left")
    return E.canonical(asked, names, F.col("near")).select("doc_id", "entity", "canonical")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of one to three words of the benchmark."""
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    return load(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(F.concat(run(1), run(2), run(3))).alias("name")).where("name <> ''").distinct()


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name of the list that each document's text holds, stop words left out."""
    return D.longest(load(spark, sf_dir, "documents"), "doc_id", "text", _names(spark, sf_dir), D.STOPS)


def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of documents' texts by patterns, by the list of names, and by words that stand where nouns do."""
    return E.in_texts(load(spark, sf_dir, "documents"), "doc_id", "text", known_names(spark, sf_dir))


QUERIES = {f.__name__: f for f in (entity_list, entity_primary, entity_confidence, question_versions, question_intent, question_prompt, canonical_name, known_names, text_entities)}
_S = lambda text: "'" + text.replace("'", "''") + "'"
_Q = f"""(SELECT doc_id, [{', '.join(map(_S, ASKED))}][doc_id % {len(ASKED)} + 1] || CASE WHEN doc_id % 3 = 0 THEN ' v' || (doc_id % 7) ELSE '' END AS question FROM documents)"""
#: DuckDB takes constant patterns only, so each pattern is a branch.
_BRANCHES = " UNION ALL ".join(
    f"SELECT doc_id, {g} AS g, {k} AS p, '{kind}' AS kind, trim(unnest(x)) AS name, generate_subscripts(x, 1) AS spot, {sure}::DOUBLE AS sure FROM (SELECT doc_id, regexp_extract_all(lower(question), {_S(p)}, 1) AS x FROM q)"
    for g, (kind, patterns, sure) in enumerate(E.GROUPS) for k, p in enumerate(patterns)
)
_FOUND = f"WITH q AS MATERIALIZED {_Q}, f AS MATERIALIZED (SELECT doc_id, g, kind, name, sure, min(p * 1000 + spot) AS place FROM ({_BRANCHES}) GROUP BY ALL)"
_PLAIN = lambda c: f"trim(lower(regexp_replace(regexp_replace({c}, '\\s*\\d+(\\.\\d+)*\\s*$', ''), '\\s+', ' ', 'g')))"
_DEVICE = "CASE " + " ".join(f"WHEN contains(name, '{k}') THEN '{v}'" for k, v in E.DEVICE_OS.items()) + " END"
_FIRST = f"""{_FOUND}, first AS (SELECT doc_id, g, kind, name, sure FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY g, place) = 1),
 primary_ AS (SELECT doc_id, CASE WHEN g = 2 THEN 'os' ELSE kind END AS kind, CASE WHEN g = 2 THEN {_DEVICE} ELSE {_PLAIN('name')} END AS name, CASE WHEN g = 2 THEN 0.75 ELSE sure END AS sure FROM first)"""
_VERSIONS = f"(SELECT doc_id, question, list_filter(list_transform(list_zip(regexp_extract_all(lower(question), {_S(E.VERSION)}, 1), regexp_extract_all(lower(question), {_S(E.VERSION)}, 2)), lambda x: trim(CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END)), lambda v: v <> '') AS versions FROM {_Q})"
_HAS = lambda p: f"regexp_matches(lower(question), {_S(p)})"
_AT = "CASE " + " ".join(f"WHEN {_HAS(p)} THEN {k}" for k, (p, _) in enumerate(FAILURES)) + " END"
_NAME = "CASE " + " ".join(f"WHEN {_HAS(p)} THEN {_S(n) if n else 'NULL'}" for p, n in FAILURES) + " END"
_INTENT = f"""(SELECT doc_id, question, versions, {_AT} AS failure_no, {_NAME} AS name, {_HAS(E.ABOUT_ALL)} AS wants_all, CASE WHEN {_HAS(E.ABOUT_CVE)} THEN 'cve' WHEN {_HAS(E.ABOUT_PATCH)} THEN 'patch' WHEN {_AT} IS NOT NULL THEN 'breaking'
  WHEN len(versions) > 0 OR {_HAS(chr(92) + 'bversion' + chr(92) + 'b')} OR {_HAS(E.ABOUT_UPDATE)} THEN 'version' ELSE 'general' END AS intent FROM {_VERSIONS})"""
_STRIP = lambda c: f"regexp_replace(lower({c}), '[\\s.\\-_]', '', 'g')"
_PART = lambda c: f"trim(regexp_split_to_array(lower({c}), '[.\\-_]')[1])"
_LISTS = ", ".join(f"('{n}')" for n in LISTED)
_EDGE = _S(f"[{D.EDGE}]")
#: Whether t holds a name at word borders: the letters around one of its places.
_HOLDS = lambda t, n: f"""(contains({t}, {n}) AND len(list_filter(range(1, len(string_split({t}, {n}))), lambda i: (string_split({t}, {n})[i] = '' AND i = 1 OR string_split({t}, {n})[i] <> '' AND regexp_matches(right(string_split({t}, {n})[i], 1), {_EDGE}))
  AND (string_split({t}, {n})[i + 1] = '' AND i + 1 = len(string_split({t}, {n})) OR string_split({t}, {n})[i + 1] <> '' AND regexp_matches(left(string_split({t}, {n})[i + 1], 1), {_EDGE})))) > 0)"""  # noqa: E731
_NAMES = f"""n AS MATERIALIZED (SELECT DISTINCT name, lower(name) AS low FROM (SELECT unnest(list_transform(range(1, greatest(len(w), 1) + 1), lambda i: array_to_string(w[i : i], ' ')) || list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i : i + 1], ' ')) || list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS name
  FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)) WHERE length(name) >= {D.LEAST} AND lower(name) NOT IN ({', '.join(map(_S, D.STOPS))}))"""
_KNOWN = f"k AS MATERIALIZED (SELECT doc_id, arg_min(name, (-length(name), name)) AS name FROM (SELECT doc_id, name FROM (SELECT doc_id, lower(text) AS t FROM documents) d, n WHERE {_HOLDS('t', 'low')}) GROUP BY doc_id)"
_TEXT_FOUND = _FOUND.replace(_Q, "(SELECT doc_id, text AS question FROM documents)")
ORACLE = {
    "entity_list": f"{_FOUND} SELECT doc_id, kind, name, sure FROM f",
    "entity_primary": f"{_FIRST} SELECT q.doc_id, kind, name, sure FROM q LEFT JOIN primary_ USING (doc_id)",
    "entity_confidence": f"{_FOUND} SELECT q.doc_id, coalesce(round(avg(sure) + 1e-12, 2), 0) AS confidence FROM q LEFT JOIN f USING (doc_id) GROUP BY 1",
    "question_versions": f"SELECT doc_id, array_to_string(versions, ';') AS versions FROM {_VERSIONS}",
    "question_intent": f"SELECT doc_id, intent, failure_no, name, wants_all FROM {_INTENT}",
    "question_prompt": f"""{_FIRST}, i AS {_INTENT} SELECT doc_id, CASE WHEN len(versions) > 0 THEN 'What''s new in ' || p.name || ' ' || versions[1] || '?'
      WHEN intent = 'cve' THEN 'What are the CVEs or security vulnerabilities for ' || p.name || s || '?' WHEN intent = 'patch' THEN 'What patches are available for ' || p.name || s || '?'
      WHEN intent = 'breaking' THEN (CASE WHEN wants_all THEN 'List all ' ELSE 'What are the ' END) || '"' || coalesce(i.name, 'failures') || '" releases for ' || p.name || s || CASE WHEN wants_all THEN '' ELSE '?' END
      WHEN {_HAS(E.ABOUT_UPDATE)} THEN 'What''s the latest version of ' || p.name || s || '?' ELSE 'Tell me about ' || p.name || s END AS prompt
      FROM (SELECT *, CASE WHEN contains(question, 'today') THEN ' on 2026-02-11 (today)' ELSE '' END AS s FROM i) i JOIN primary_ p USING (doc_id) WHERE p.name IS NOT NULL""",
    "canonical_name": f"""{_FOUND}, e AS (SELECT doc_id, {_PLAIN('name')} AS entity FROM f), n AS (SELECT * FROM (VALUES {_LISTS}) AS v(name)),
      k AS (SELECT {_STRIP('name')} AS key, name FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(name) DESC, name) = 1), t AS (SELECT {_PART('name')} AS part, name FROM n QUALIFY row_number() OVER (PARTITION BY part ORDER BY length(name) DESC, name) = 1),
      g AS (SELECT doc_id, arg_min(name, (-length(name), name)) AS near FROM (SELECT doc_id, lower(question) AS t FROM q), (SELECT name, lower(name) AS low FROM n WHERE length(name) >= {D.LEAST}) WHERE {_HOLDS('t', 'low')} GROUP BY doc_id)
      SELECT doc_id, entity, coalesce(CASE entity {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in E.LISTED.items())} END, k.name, CASE WHEN regexp_matches(entity, '[.\\-_]') AND length({_PART('entity')}) >= 3 AND {_PART('entity')} <> entity THEN coalesce(t.name, {_PART('entity')}) END,
        CASE WHEN lower(near) <> entity AND length(near) / length(entity) BETWEEN 0.6 AND 1.5 THEN near END) AS canonical FROM e LEFT JOIN g USING (doc_id) LEFT JOIN k ON k.key = {_STRIP('entity')} LEFT JOIN t ON t.part = {_PART('entity')} AND regexp_matches(entity, '[.\\-_]')""",
    "known_names": f"WITH {_NAMES}, {_KNOWN} SELECT doc_id, name FROM k",
    "text_entities": f"""{_TEXT_FOUND}, {_NAMES}, {_KNOWN}, g_ AS (SELECT f.doc_id, f.kind, f.name, CASE WHEN lower(k.name) = f.name THEN greatest(sure, {E.DICTIONARY_SURE}) ELSE sure END AS sure FROM f LEFT JOIN k USING (doc_id)),
      d AS (SELECT * FROM g_ UNION ALL SELECT doc_id, 'software', lower(name), {E.DICTIONARY_SURE}::DOUBLE FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND f.name = lower(k.name))),
      o AS (SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all(lower(text), {_S(E.NOUN)}, 1))) AS name FROM documents)
      SELECT * FROM d UNION ALL SELECT doc_id, 'software', name, {E.NOUN_SURE}::DOUBLE FROM o WHERE length(name) > 2 AND NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = o.doc_id AND d.name = o.name)""",
}
