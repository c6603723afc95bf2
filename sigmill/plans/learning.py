"""Sentiment of conversation turns, and classifiers of documents by their words."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import classify as C
from sigmill.operators import neighbours as N
from sigmill.operators import sentiment as S
from sigmill.operators.trajectory import sentiment_class
from sigmill.plans import labels as P
from sigmill.sources.tables import load

# Valences of words of the test tables.
VALENCES = (("the", 0.4), ("and", -0.3), ("error", -1.8), ("please", 1.3), ("thanks", 1.9), ("thha", 2.1), ("onor", -2.2), ("good", 1.9), ("bad", -2.5), ("great", 3.1), ("mit", 0.8), ("ed", -0.9), ("der", 0.7), ("de", -0.5))


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VALENCES), "word string, valence double")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")


def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.polarity(_turns(spark, sf_dir), "id", "text", _lexicon(spark))


def sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each class by a plain sum of valences, normalised: what needs no rules of order can be checked in SQL."""
    words = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    summed = words.join(F.broadcast(_lexicon(spark)), "word").groupBy("conv_id", "turn").agg(F.sum("valence").alias("v"))
    score = F.coalesce(F.col("v") / F.sqrt(F.col("v") * F.col("v") + S.NORM), F.lit(0.0))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn").join(summed, ["conv_id", "turn"], "left")
    return rows.groupBy(sentiment_class(score).alias("label")).agg(F.count(F.lit(1)).alias("turns"))


def busy_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with four replies or more; missing counts are none."""
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return turns.where(F.coalesce(F.col("turns") - 1, F.lit(0)) >= 4)


def post_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a post's author and of others: marked ones, and those by the author's own name if it isn't empty."""
    turns = load(spark, sf_dir, "conversations").withColumn("name", F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role")))
    author = turns.where("turn = 0").select("conv_id", F.col("name").alias("author"))
    own = (F.col("turn") % 5 == 2) | ((F.col("name") == F.col("author")) & (F.col("name") != ""))
    return turns.where("turn > 0").join(author, "conv_id", "left").groupBy("conv_id").agg(F.count_if(F.coalesce(own, F.lit(False))).alias("author"), F.count_if(~F.coalesce(own, F.lit(False))).alias("community"))


def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the users' mean values for each kind of event, and the smallest and largest of these means."""
    each = load(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return each.groupBy("event_type").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.min("m"), 4).alias("least"), F.round(F.max("m"), 4).alias("most"))


def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders older than a week on a day, by their date."""
    return load(spark, sf_dir, "orders").select("o_orderkey", (F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate").cast("date")) > 7).alias("stale"))


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts with each keyword between asterisks, once and as it is written."""
    return load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?i)(?<![\p{L}\p{N}_])(the|token|error|mit)(?![\p{L}\p{N}_])", "**$1**").alias("shown"))


def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of 60 letters, and urls with their middle left out."""
    short = F.when(F.length("url") > 40, F.concat(F.substring("url", 1, 20), F.lit("..."), F.expr("right(url, 17)"))).otherwise(F.col("url"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return load(spark, sf_dir, "pages").select("page_id", F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 60), F.lit("..."))).otherwise(title).alias("title"), short.alias("url"))


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they are learned from: about four fifths."""
    rows = load(spark, sf_dir, "documents").groupBy(C.in_training(F.col("doc_id")).alias("training")).agg(F.count(F.lit(1)).alias("documents"))
    return rows


def _classified(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return C.agreement(C.predicted(docs, "doc_id", "lang", name)).select(F.lit(name).alias("classifier"), "n", "accuracy", "kappa")


def language_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well words tell a document's language."""
    return _classified(spark, sf_dir, "naive_bayes")


def language_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "logistic_regression")


def language_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "random_forest")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first component that their words name, which classifiers are to find from all words."""
    return load(spark, sf_dir, "documents").select("doc_id", "text").join(P.component_primary(spark, sf_dir), "doc_id")


def _secure(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = P.security_binary(spark, sf_dir).select("doc_id", F.when(F.col("security"), "security").otherwise("none").alias("security"))
    return load(spark, sf_dir, "documents").select("doc_id", "text").join(flags, "doc_id")


def _learned(rows: DataFrame, label: str, name: str) -> DataFrame:
    return C.agreement(C.predicted(rows, "doc_id", label, name)).select(F.lit(name).alias("classifier"), "n", "accuracy", "kappa")


def component_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well counted words tell the component that keywords give."""
    return _learned(_components(spark, sf_dir), "component", "naive_bayes")


def component_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(_components(spark, sf_dir), "component", "logistic_regression")


def component_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(_components(spark, sf_dir), "component", "random_forest")


def security_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well counted words tell whether keywords say that a document is about security."""
    return _learned(_secure(spark, sf_dir), "security", "linear_svm")


def security_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(_secure(spark, sf_dir), "security", "boosting")


def component_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component that most of the five nearest texts of the training rows have, for each other row."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null")
    labels = P.component_primary(spark, sf_dir).where("doc_id is not null").persist(StorageLevel.DISK_ONLY)  # worked out once
    training, rest = docs.where(C.in_training(F.col("doc_id"))), docs.where(~C.in_training(F.col("doc_id")))
    # the search sends words without labels: they join what is found
    found = N.nearest(training.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("label"), "text"), rest.select(F.col("doc_id").alias("query"), "text"))
    named = found.drop("label").join(labels.select(F.col("doc_id").alias("id"), F.col("component").alias("label")), "id")
    return labels.where(~C.in_training(F.col("doc_id"))).select("doc_id", "component").join(N.voted(named).withColumnRenamed("query", "doc_id"), "doc_id", "left")


def component_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and kappa of the nearest texts' vote."""
    return C.agreement(component_neighbours(spark, sf_dir), "component").select(F.lit("neighbours").alias("classifier"), "n", "accuracy", "kappa")


QUERIES = {f.__name__: f for f in (component_naive_bayes, component_logistic, component_forest, security_svm, security_boosting, component_neighbours, component_knn, sentiment_scores, sentiment_counts, busy_posts, post_sides, category_means, stale_rows, highlighted, shortened, split_sizes, language_naive_bayes, language_logistic, language_forest)}
_V = ", ".join(f"('{w}', {v})" for w, v in VALENCES)
_TRAINS = f"('0x' || md5(doc_id || ':{C.SEED}')[1:8])::BIGINT % 5 > 0"
_VOTES = f"""WITH d AS MATERIALIZED (SELECT doc_id, text, component, {_TRAINS} AS training FROM documents JOIN ({P.ORACLE['component_primary']}) USING (doc_id) WHERE text IS NOT NULL),
  c AS MATERIALIZED (SELECT doc_id, training, word, count(*) AS n FROM (SELECT doc_id, training, unnest(regexp_extract_all(lower(text), '{N.WORD}')) AS word FROM d) GROUP BY ALL),
  z AS MATERIALIZED (SELECT doc_id, sum(n * n) AS z FROM c GROUP BY 1), p AS MATERIALIZED (SELECT q.doc_id AS query, r.doc_id AS id, sum(q.n * r.n) AS p FROM c q JOIN c r ON r.word = q.word AND r.training AND NOT q.training GROUP BY ALL),
  s AS (SELECT q.doc_id AS query, r.doc_id AS id, r.component AS label, coalesce(a.z, 0) + coalesce(b.z, 0) - 2 * coalesce(p, 0) AS distance FROM d q JOIN d r ON r.training AND NOT q.training LEFT JOIN p ON p.query = q.doc_id AND p.id = r.doc_id
    LEFT JOIN z a ON a.doc_id = q.doc_id LEFT JOIN z b ON b.doc_id = r.doc_id QUALIFY row_number() OVER (PARTITION BY q.doc_id ORDER BY distance, r.doc_id) <= 5),
  v AS (SELECT query, label FROM (SELECT query, label, count(*) AS n FROM s GROUP BY query, label) QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1),
  g AS MATERIALIZED (SELECT d.doc_id, d.component, v.label AS guess FROM d LEFT JOIN v ON v.query = d.doc_id WHERE NOT d.training)"""
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_STEP = lambda k: f"""(CASE WHEN l{k} IN {_LIST(S.BOOSTERS)} THEN {S.BOOST} + CASE WHEN mixed AND s{k} THEN {S.CAPS} ELSE 0 END WHEN l{k} IN {_LIST(S.DAMPENERS)} THEN -{S.BOOST} - CASE WHEN mixed AND s{k} THEN {S.CAPS} ELSE 0 END ELSE 0 END * {S.DAMPED[k - 1]})"""
_LAGS = ", ".join(f"lag(l, {k}) OVER o AS l{k}, coalesce(lag(s, {k}) OVER o, false) AS s{k}" for k in (1, 2, 3))
_POLARITY = f"""WITH t AS (SELECT conv_id || ':' || turn AS id, coalesce(text, '') AS t FROM conversations),
  w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM (SELECT id, list_filter(list_transform(list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda x: length(x) > 1) AS ws FROM t)),
  x AS (SELECT *, lower(replace(w, chr(39), '')) AS l, upper(w) = w AND lower(w) <> w AS s FROM w), m AS (SELECT id, bool_or(s) AND bool_or(NOT s) AS mixed, min(place) FILTER (l = 'but') AS but FROM x GROUP BY id),
  y AS (SELECT x.*, mixed, but, {_LAGS} FROM x JOIN m USING (id) WINDOW o AS (PARTITION BY id ORDER BY place)),
  v AS (SELECT id, CASE WHEN l IN {_LIST(S.BOOSTERS + S.DAMPENERS)} OR valence IS NULL THEN 0 ELSE (valence + sign(valence) * (CASE WHEN mixed AND s THEN {S.CAPS} ELSE 0 END + {' + '.join(map(_STEP, (1, 2, 3)))}))
    * CASE WHEN coalesce(l1 IN {_LIST(S.NEGATIONS)}, false) OR coalesce(l2 IN {_LIST(S.NEGATIONS)}, false) OR coalesce(l3 IN {_LIST(S.NEGATIONS)}, false) THEN {S.NEGATED} ELSE 1 END * CASE WHEN place < but THEN 0.5 WHEN place > but THEN 1.5 ELSE 1 END END::DOUBLE AS v
    FROM y LEFT JOIN (VALUES {_V}) AS k(l, valence) USING (l)),
  a AS (SELECT id, sum(v) AS total, coalesce(sum(v + 1) FILTER (v > 0), 0) AS p, coalesce(sum(v - 1) FILTER (v < 0), 0) AS n, count(*) FILTER (v = 0) AS z FROM v GROUP BY id),
  e AS (SELECT t.id, coalesce(total, 0) AS total, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(z, 0) AS z, least(length(t) - length(replace(t, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN q > 3 THEN 0.96 WHEN q > 1 THEN q * 0.18 ELSE 0 END::DOUBLE AS e
    FROM (SELECT *, length(t) - length(replace(t, '?', '')) AS q FROM t) t LEFT JOIN a USING (id)),
  f AS (SELECT id, total + sign(total) * e AS whole, CASE WHEN p > -n THEN p + e ELSE p END AS p, CASE WHEN p < -n THEN n - e ELSE n END AS n, z FROM e),
  g AS (SELECT *, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, whole / sqrt(whole * whole + {S.NORM}))), 4) AS compound, p - n + z AS every FROM f)
  SELECT id, CASE WHEN every > 0 THEN round(abs(n / every), 3) ELSE 0 END AS neg, CASE WHEN every > 0 THEN round(abs(z / every), 3) ELSE 1 END AS neu, CASE WHEN every > 0 THEN round(abs(p / every), 3) ELSE 0 END AS pos, compound,
    CASE WHEN compound >= 0.05 THEN 'Positive' WHEN compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS label FROM g"""
ORACLE = {
    "sentiment_scores": _POLARITY,
    "split_sizes": f"SELECT {_TRAINS} AS training, count(*) AS documents FROM documents GROUP BY 1",
    "component_neighbours": f"{_VOTES} SELECT * FROM g",
    "component_knn": f"""{_VOTES} SELECT 'neighbours' AS classifier, n, round(po, 4) AS accuracy, CASE WHEN pe = 1 THEN 0 ELSE round((po - pe) / (1 - pe), 4) END AS kappa FROM (SELECT count(*) AS n, avg((component = guess)::INT) AS po,
      (SELECT sum(a.n * b.n) FROM (SELECT component AS x, count(*) AS n FROM g GROUP BY 1) a JOIN (SELECT guess AS x, count(*) AS n FROM g GROUP BY 1) b USING (x)) / (count(*) * count(*)) AS pe FROM g)""",
    "sentiment_counts": f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), s AS (SELECT conv_id, turn, sum(v::DOUBLE) AS v FROM w JOIN (VALUES {_V}) AS l(word, v) USING (word) GROUP BY ALL),
      c AS (SELECT coalesce(v / sqrt(v * v + 15.0), 0.0) AS x FROM conversations LEFT JOIN s USING (conv_id, turn)) SELECT CASE WHEN x >= 0.05 THEN 'Positive' WHEN x <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS label, count(*) AS turns FROM c GROUP BY 1""",
    "busy_posts": "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) - 1 >= 4",
    "post_sides": """WITH t AS (SELECT *, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS name FROM conversations), o AS (SELECT t.conv_id, t.turn % 5 = 2 OR coalesce(t.name = a.name AND t.name <> '', false) AS own FROM t LEFT JOIN t a ON a.conv_id = t.conv_id AND a.turn = 0 WHERE t.turn > 0)
      SELECT conv_id, count(*) FILTER (own) AS author, count(*) FILTER (NOT own) AS community FROM o GROUP BY 1""",
    "category_means": "SELECT event_type, round(avg(m), 4) AS mean, round(min(m), 4) AS least, round(max(m), 4) AS most FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1",
    "stale_rows": "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-01') > 7 AS stale FROM orders",
    "highlighted": r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE WHEN lower(x) IN ('the', 'token', 'error', 'mit') THEN '**' || x || '**' ELSE x END), '') AS shown FROM documents",
    "shortened": """SELECT page_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '...' ELSE t END AS title, CASE WHEN length(url) > 40 THEN substr(url, 1, 20) || '...' || right(url, 17) ELSE url END AS url
      FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""",
}
