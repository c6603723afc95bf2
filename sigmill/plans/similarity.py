"""String, token and vector similarity, and evaluation of label predictions.

Vector queries ask for every row whose vec_id is divisible by EVERY, fuzzy matching for every distinct name, against all rows in blocks.
DuckDB's Jaro similarity cuts half a transposition off, ours does not: the SQL of jaro_winkler and fuzzy_best takes letters one by one in a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.operators import blocks as B
from sigmill.operators.fuzzy import fuzzy
from sigmill.operators.labels import sized
from sigmill.sources.tables import load

#: The vector queries ask for every row whose vec_id is divisible by this number.
EVERY = 100
# The names of the dictionary query, and the letters that may stand around a name.
NAMES = ("The Rewh", "the", "that in", "orantion", "mit license", "token")
EDGE = r"[\s,.()\[\]\"'!?;:/\\]"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name with the next key's."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    return part.join(part.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


def _paired(spark: SparkSession, sf_dir: str, score: Column) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", F.round(score, 4).alias("score"))


def levenshtein_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir, X.levenshtein_norm(F.col("a"), F.col("b")))


def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir, X.jaro_winkler(F.col("a"), F.col("b")))


def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir, X.dice(F.col("a"), F.col("b")))


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each distinct name among all others: equal without case 1, the only one that contains it or is contained 0.95, else
    0.6 Jaro-Winkler + 0.4 Dice; from 0.9 a match, from 0.6 partial. Suggestions: up to three names, of 0.5 or more where the match is partial."""
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).where("name is not null").distinct()
    return fuzzy(names.select(F.col("name").alias("query")), names)


def dict_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest dictionary name (four letters or more) in each document, probed by its first word; ties by name."""
    names = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}')" for n in NAMES) + " AS n(name)").where("length(trim(name)) >= 4")
    names = names.select("name", F.lower("name").alias("low"), F.split(F.lower("name"), r"[\s\-_.]")[0].alias("word"))
    docs = load(spark, sf_dir, "documents")
    # words alone meet the names; texts come back for the documents that have candidates
    hits = docs.select("doc_id", F.explode(X.words(F.col("text"))).alias("word")).join(sized(names), "word").drop("word").distinct()
    probes = hits.join(docs.select("doc_id", F.lower("text").alias("text")), "doc_id")
    at = F.instr("text", F.col("low"))
    edge = lambda c: (c == "") | c.rlike(EDGE)
    before, after = F.when(at > 1, F.substring("text", at - 1, F.lit(1))).otherwise(""), F.substring("text", at + F.length("low"), F.lit(1))
    found = probes.where((at > 0) & edge(before) & edge(after))
    best = found.groupBy("doc_id").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("m"))
    return best.select("doc_id", F.col("m.name").alias("name"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and the questions among them."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return rows, rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("q"))


def _vectors(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    return rows.drop(columns="embedding"), B.matrix(rows["embedding"])


def _nearest(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k rows nearest to each question by cosine, ties to the smaller vec_id."""

    def some(q: pd.DataFrame, r: pd.DataFrame, vectors: np.ndarray) -> pd.DataFrame:
        like = B.cosines(B.matrix(q["q"]), vectors)
        a, b = B.best(like, r["vec_id"].to_numpy(), q["query_id"].to_numpy(), k)
        cell = lambda side, name, at: side[name].to_numpy()[at]
        return pd.DataFrame({"query_id": cell(q, "query_id", a), "query_label": cell(q, "query_label", a), "vec_id": cell(r, "vec_id", b), "label": cell(r, "label", b), "score": like[a, b]})

    def score(q: pd.DataFrame, block: tuple[pd.DataFrame, np.ndarray]) -> pd.DataFrame:
        return pd.concat([some(q.iloc[at], *block) for at in B.slices(len(q), len(block[0]))])

    rows, questions = _sides(spark, sf_dir)
    found = B.against(rows, questions, "vec_id", "query_id", score, "query_id long, query_label int, vec_id long, label int, score double", prepare=_vectors)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query_id", "rank", "vec_id", "score")


def knn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that most of a question's five nearest have; ties to the smaller label."""
    votes = _nearest(spark, sf_dir).groupBy("query_id", "query_label", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("query_id", "query_label").agg(F.max(F.struct("votes", (-F.col("label")).alias("l"))).alias("m"))
    return best.select("query_id", (-F.col("m.l")).cast("long").alias("predicted"), (F.col("query_label") == -F.col("m.l")).alias("right"))


def greedy_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision (mean best score of the questions), recall (of the rows), their harmonic mean and the risk tier, for each label's rows."""

    def by_label(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        r, vectors = _vectors(rows.sort_values("label", kind="stable"))  # rows without a label stand last
        labelled = r["label"].count()
        return r.iloc[:labelled], vectors[:labelled]

    def kept(side: str, labels: np.ndarray, ids: np.ndarray, best: np.ndarray) -> pd.DataFrame:
        found = best > -2
        return pd.DataFrame({"side": side, "label": labels[found].astype("int32"), "id": ids[found].astype("int64"), "best": best[found]})

    def score(q: pd.DataFrame, block: tuple[pd.DataFrame, np.ndarray]) -> Iterator[pd.DataFrame]:
        r, vectors = block
        ids, label, own, asked = r["vec_id"].to_numpy(), r["label"].to_numpy(), q["query_id"].to_numpy(), B.matrix(q["q"])
        labels, begins = np.unique(label, return_index=True)
        of_rows = np.full(len(r), -2.0)
        for at in B.slices(len(q), len(r)) if len(r) else ():
            like = B.cosines(asked[at], vectors)
            like[own[at][:, None] == ids[None, :]] = -2
            of_rows = np.maximum(of_rows, like.max(axis=0))
            of_queries = np.maximum.reduceat(like, begins, axis=1)
            yield kept("p", np.tile(labels, len(like)), np.repeat(own[at], len(labels)), of_queries.ravel())
        yield kept("r", label, ids, of_rows)

    rows, questions = _sides(spark, sf_dir)
    found = B.against(rows, questions, "vec_id", "query_id", score, "side string, label int, id long, best double", prepare=by_label)
    s = found.groupBy("side", "label", "id").agg(F.max("best").alias("best"))
    sides = s.groupBy("label").pivot("side", ["p", "r"]).agg(F.avg("best")).where("p is not null and r is not null")
    out = sides.select("label", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(X.harmonic(F.col("p"), F.col("r")), 3).alias("f1"))
    return out.withColumn("risk", F.when(F.col("precision") >= 0.78, "low").when(F.col("precision") >= 0.55, "medium").otherwise("high"))


def overlap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms that a document shares with the benchmark item of its number modulo the number of items."""
    items = load(spark, sf_dir, "benchmark")
    n = items.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))  # one row
    docs = load(spark, sf_dir, "documents").join(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), X.terms(F.col("text")).alias("a"))
    joined = docs.join(sized(items.select("item_id", X.terms(F.col("text")).alias("b")), 10_000), "item_id").withColumn("both", F.size(F.array_intersect("a", "b")))
    share = lambda c: F.when(F.size(c) > 0, F.col("both") / F.size(c)).otherwise(0.0)
    return joined.select("doc_id", F.round(share("a"), 3).alias("precision"), F.round(share("b"), 3).alias("recall"), F.round(X.harmonic(share("a"), share("b")), 3).alias("f1"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 400).cast("int").alias("p"))
    return load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and Cohen's kappa of a rule on length against the quality labels; 0 where chance agreement is 1."""
    c = _predicted(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == F.col("p")).cast("int")).alias("hit"), F.sum("y").alias("y"), F.sum("p").alias("p"))
    po, pe = F.col("hit") / F.col("n"), (F.col("y") * F.col("p") + (F.col("n") - F.col("y")) * (F.col("n") - F.col("p"))) / (F.col("n") * F.col("n"))
    return c.select("n", F.round(po, 4).alias("accuracy"), F.when(pe == 1, 0.0).otherwise(F.round((po - pe) / (1 - pe), 4)).alias("kappa"))


def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent training label (doc_id mod 10 under 8; ties to the smaller) and its accuracy on the rest."""
    rows = _predicted(spark, sf_dir).withColumn("train", F.col("doc_id") % 10 < 8)
    counts = rows.groupBy("y").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))
    best = counts.agg(F.max(F.struct("train", (-F.col("y")).alias("l"), "test")).alias("m"), F.sum("test").alias("test"))
    return best.select((-F.col("m.l")).cast("long").alias("label"), F.round(F.col("m.test") / F.col("test"), 4).alias("accuracy"))


QUERIES = {f.__name__: f for f in (levenshtein_norm, jaro_winkler, dice, fuzzy_best, dict_longest, cosine_topk, knn_label, greedy_f1, overlap_f1, kappa, majority_baseline)}
_PAIRS = "SELECT x.p_partkey AS id, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1"
_GRAMS = lambda a: f"list_transform(range(1, length(replace({a}, ' ', ''))), lambda i: substr(replace({a}, ' ', ''), i::INT, 2))"
_DICE = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct({_GRAMS(a)}), lambda g: least(len(list_filter({_GRAMS(a)}, lambda z: z = g)), len(list_filter({_GRAMS(b)}, lambda z: z = g))))), 0) / (len({_GRAMS(a)}) + len({_GRAMS(b)})) END"
#: Of a subquery with lower-case x and y: each letter of x takes the first equal letter of y in reach that is free.
_REACH = "greatest(greatest(length(x), length(y)) // 2 - 1, 0)"
_LOW, _SPOT = f"greatest(1, n.i - {_REACH})", f"instr(substr(s.rest, greatest(1, n.i - {_REACH}), n.i + {_REACH} - greatest(1, n.i - {_REACH}) + 1), substr(x, n.i, 1))"
_TAKEN = f"""list_reduce(list_prepend({{'i': 0::BIGINT, 'rest': y, 'got': ''}}, list_transform(range(1, length(x) + 1), lambda i: {{'i': i::BIGINT, 'rest': '', 'got': ''}})),
  lambda s, n: CASE WHEN {_SPOT} > 0 THEN {{'i': n.i, 'rest': substr(s.rest, 1, {_LOW} + {_SPOT} - 2) || chr(1) || substr(s.rest, {_LOW} + {_SPOT}), 'got': s.got || substr(x, n.i, 1)}} ELSE {{'i': n.i, 'rest': s.rest, 'got': s.got}} END)"""
_JARO = lambda pairs: f"""(SELECT *, j + 0.1 * coalesce(list_min(list_filter(range(0, 5), lambda k: k = least(4, length(x), length(y)) OR substr(x, k + 1, 1) <> substr(y, k + 1, 1))), 0) * (1 - j) AS jw FROM (
  SELECT *, CASE WHEN x = y THEN 1.0::DOUBLE WHEN got = '' THEN 0 ELSE (length(got) / length(x) + length(got) / length(y) + (length(got) - len(list_filter(range(1, length(got) + 1), lambda k: substr(got, k, 1) <> substr(other, k, 1))) / 2) / length(got)) / 3 END AS j FROM (
  SELECT *, r.got AS got, array_to_string(list_transform(list_filter(range(1, length(y) + 1), lambda k: substr(r.rest, k, 1) = chr(1)), lambda k: substr(y, k, 1)), '') AS other FROM (SELECT *, {_TAKEN} AS r FROM ({pairs})))))"""  # noqa: E731
_SCORES = f"""SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % {EVERY} = 0 AND e.vec_id <> q.vec_id"""
_NEAREST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_SCORES})) WHERE rank <= 5"
_TERMS = lambda t: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9\\s]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda x: length(x) > 2))"
_PREDICTED = "SELECT doc_id, quality AS y, (n_chars >= 400)::INT AS p FROM labels JOIN documents USING (doc_id)"
_EDGE = EDGE.replace("'", "''")
ORACLE = {
    "levenshtein_norm": f"SELECT id, round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 4) AS score FROM ({_PAIRS})",
    "dice": f"SELECT id, round({_DICE('a', 'b')}, 4) AS score FROM ({_PAIRS})",
    "jaro_winkler": f"SELECT id, round(jw, 4) AS score FROM {_JARO(f'SELECT id, lower(a) AS x, lower(b) AS y FROM ({_PAIRS})')}",
    "fuzzy_best": f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL), p AS (SELECT a.name AS query, b.name AS name, lower(a.name) AS x, lower(b.name) AS y FROM n a JOIN n b ON a.name <> b.name),
      s AS MATERIALIZED (SELECT query, name, CASE WHEN x = y THEN 1 ELSE round(0.6 * jw + 0.4 * {_DICE('x', 'y')}, 4) END AS score, contains(x, y) OR contains(y, x) AS held FROM {_JARO('FROM p')}),
      t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, name) <= 3), h AS (SELECT query, count(*) AS n, min(name) AS one FROM s WHERE held GROUP BY query),
      b AS (SELECT query, arg_min(name, (-score, name)) AS first, max(score) AS top FROM t GROUP BY query), f AS (SELECT query, CASE WHEN top < 1 AND n = 1 THEN one ELSE first END AS best, CASE WHEN top < 1 AND n = 1 THEN 0.95 ELSE top END AS score FROM b LEFT JOIN h USING (query))
      SELECT query, CASE WHEN f.score >= 0.6 THEN best END AS best, f.score, CASE WHEN f.score >= 0.9 THEN 'match' WHEN f.score >= 0.6 THEN 'partial' ELSE 'none' END AS match,
        CASE WHEN f.score >= 0.9 THEN '' ELSE coalesce(string_agg(name || ':' || printf('%.2f', t.score), ';' ORDER BY t.score DESC, name) FILTER (f.score < 0.6 OR t.score >= 0.5), '') END AS suggestions FROM f JOIN t USING (query) GROUP BY query, f.best, f.score""",
    "dict_longest": f"""WITH n AS (SELECT name, lower(name) AS low FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) AS v(name) WHERE length(trim(name)) >= 4),
      f AS (SELECT doc_id, name, lower(text) AS t, low, instr(lower(text), low) AS spot FROM documents, n WHERE list_contains(regexp_extract_all(lower(text), '{X.WORD}'), regexp_extract(low, '^[^-\\s_.]+')))
      SELECT doc_id, name FROM f WHERE spot > 0 AND (spot = 1 OR regexp_matches(substr(t, spot - 1, 1), '{_EDGE}')) AND (spot + length(low) > length(t) OR regexp_matches(substr(t, spot + length(low), 1), '{_EDGE}'))
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) = 1""",
    "cosine_topk": f"SELECT query_id, rank, vec_id, score FROM ({_NEAREST})",
    "knn_label": f"""SELECT query_id, label::BIGINT AS predicted, label = query_label AS right FROM (SELECT query_id, query_label, label, count(*) AS v FROM ({_NEAREST}) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, label) = 1""",
    "greedy_f1": f"""WITH s AS ({_SCORES}), p AS (SELECT label, avg(b) AS p FROM (SELECT label, query_id, max(score) AS b FROM s GROUP BY ALL) GROUP BY label),
      r AS (SELECT label, avg(b) AS r FROM (SELECT label, vec_id, max(score) AS b FROM s GROUP BY ALL) GROUP BY label)
      SELECT label, round(p, 3) AS precision, round(r, 3) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 3) ELSE 0 END AS f1,
        CASE WHEN round(p, 3) >= 0.78 THEN 'low' WHEN round(p, 3) >= 0.55 THEN 'medium' ELSE 'high' END AS risk FROM p JOIN r USING (label)""",
    "overlap_f1": f"""WITH t AS (SELECT doc_id, {_TERMS('d.text')} AS a, {_TERMS('b.text')} AS b FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
      s AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS p, CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END AS r FROM t)
      SELECT doc_id, round(p, 3) AS precision, round(r, 3) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 3) ELSE 0 END AS f1 FROM s""",
    "kappa": f"""SELECT n, round(po, 4) AS accuracy, CASE WHEN pe = 1 THEN 0 ELSE round((po - pe) / (1 - pe), 4) END AS kappa FROM (
      SELECT count(*) AS n, avg((y = p)::INT) AS po, (sum(y) * sum(p) + (count(*) - sum(y)) * (count(*) - sum(p))) / (count(*) * count(*)) AS pe FROM ({_PREDICTED}))""",
    "majority_baseline": f"""WITH r AS ({_PREDICTED}), m AS (SELECT y FROM r WHERE doc_id % 10 < 8 GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
      SELECT m.y::BIGINT AS label, round(avg((r.y = m.y)::INT), 4) AS accuracy FROM r, m WHERE doc_id % 10 >= 8 GROUP BY m.y""",
}
