"""Reports over what other plans find: leads by mentions, relevant posts, lists of labels, sources of mentions, answers that have entries, prompts of posts, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import answers as A
from sigmill.operators import entities as E
from sigmill.operators import labels as L
from sigmill.operators import review as D
from sigmill.plans import answers as PA
from sigmill.plans import labels as PL
from sigmill.plans import questions as PQ
from sigmill.plans import review as PR
from sigmill.sources.tables import load

#: Rows of the report of leads; patterns and findings of a repository's memory.
LEADS, PATTERNS, FINDINGS = 50, 10, 20


def leads_by_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest leads, those with more posts (an order's lines, as text; some can't be read) first among equals."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("posts"))
    rows = PL._lead(spark, sf_dir).join(lines, "key", "left").withColumn("posts", F.when(F.col("key") % 5 == 0, "many").otherwise(F.col("posts")))
    return L.by_lead(rows, "lead_days", "posts", "key").select("key", "lead_days", "posts").limit(LEADS)


def relevant_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three conversations that are most about usability, and about defects; among equals those with more turns."""
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    rows = PA.post_relevance(spark, sf_dir).unpivot("conv_id", ["usability", "defects"], "about", "relevance").join(turns, "conv_id")
    rank = F.row_number().over(W.partitionBy("about").orderBy(F.desc("relevance"), F.desc("turns"), "conv_id")).cast("long")
    return rows.withColumn("rank", rank).where("rank <= 3")


def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each breaking and each security label, null for those without one."""
    out = None
    for kind in ("breaking", "security"):
        one = PL._labelled(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), F.explode_outer("labels").alias("label"))
        out = one if out is None else out.unionAll(one)
    return out.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("documents"))


def mention_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of how many mentions each source is one."""
    return PL.mention_rollup(spark, sf_dir).select(F.explode(F.split("sources", ";")).alias("source")).where("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("mentions"))


def aligned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for their urgent orders: those without one get no answer."""
    asked = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"))
    entries = load(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("question"))
    return A.aligned(asked, entries, "question")


def post_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question as a post with flags; those without an entity have none."""
    rows = PQ._parsed(spark, sf_dir).where(F.col("primary").isNotNull())
    prompt = E.post_prompt(F.col("primary.name"), F.col("versions"), F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 2 == 0))
    return rows.select("doc_id", prompt.alias("prompt"))


def recurring_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories whose performance patterns (purchases stand for them) come back, and what that foretells."""
    return D.recurring(PR._keyed(PR.findings(spark, sf_dir)), "purchase")


def memory_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent patterns of each repository."""
    counts = PR._keyed(PR.findings(spark, sf_dir)).groupBy("repo", "agent", "pattern_key").agg(F.count(F.lit(1)).alias("occurrences"))
    rank = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("occurrences"), "pattern_key")).cast("long")
    return counts.withColumn("rank", rank).where(F.col("rank") <= PATTERNS)


def memory_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest findings of each repository in each file."""
    rank = F.row_number().over(W.partitionBy("repo", "file").orderBy(F.desc("id"))).cast("long")
    return PR.findings(spark, sf_dir).select("repo", "file", "id", "severity").withColumn("rank", rank).where(F.col("rank") <= FINDINGS)


QUERIES = {f.__name__: f for f in (leads_by_posts, relevant_posts, label_lists, mention_sources, aligned_answers, post_prompts, recurring_patterns, memory_patterns, memory_findings)}
ORACLE = {
    "leads_by_posts": f"""SELECT key, lead_days, posts FROM (SELECT l.key, lead_days, CASE WHEN l.key % 5 = 0 THEN 'many' ELSE c.n::VARCHAR END AS posts FROM ({PL._LEADS}) l LEFT JOIN (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1) c USING (key))
      ORDER BY coalesce(lead_days, -1e9) DESC, coalesce(try_cast(posts AS BIGINT), 0) DESC, key LIMIT {LEADS}""",
    "relevant_posts": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY about ORDER BY relevance DESC, turns DESC, conv_id) AS rank FROM (SELECT conv_id, 'usability' AS about, usability AS relevance FROM ({PA.ORACLE['post_relevance']})
      UNION ALL SELECT conv_id, 'defects', defects FROM ({PA.ORACLE['post_relevance']})) JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) USING (conv_id)) WHERE rank <= 3""",
    "label_lists": f"""SELECT kind, category AS label, count(*) AS documents FROM (SELECT doc_id, unnest(['breaking', 'security']) AS kind FROM documents) d LEFT JOIN ({PL._FOUND}) f ON f.doc_id = d.doc_id AND f.taxonomy = kind GROUP BY 1, 2""",
    "mention_sources": f"SELECT source, count(DISTINCT mention) AS mentions FROM ({PL._MENTIONS}) WHERE source <> '' GROUP BY 1",
    "aligned_answers": """SELECT c_custkey AS question, count(o_orderkey) AS entries, CASE WHEN count(o_orderkey) > 0 THEN 'confident' ELSE 'abstain' END AS decision FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""",
    "post_prompts": f"""{PQ._FIRST}, v AS {PQ._VERSIONS} SELECT doc_id, CASE WHEN len(versions) > 0 THEN 'What''s new in ' || p.name || ' ' || versions[1] || '?' WHEN doc_id % 5 = 0 THEN 'What are the latest security updates for ' || p.name || '?'
      WHEN doc_id % 7 > 0 AND doc_id % 2 = 0 THEN 'What''s the latest update for ' || p.name || '?' ELSE 'Tell me about ' || p.name || ' releases' END AS prompt FROM v JOIN primary_ p USING (doc_id) WHERE p.name IS NOT NULL""",
    "recurring_patterns": f"""SELECT repo, 'performance_regression' AS type, 0.7::DOUBLE AS confidence, count(*) AS amount, 'medium' AS severity FROM (SELECT repo, pattern_key FROM ({PR._KEYED}) WHERE agent = 'purchase' GROUP BY ALL HAVING count(*) >= 2) GROUP BY repo""",
    "memory_patterns": f"SELECT * FROM (SELECT repo, agent, pattern_key, count(*) AS occurrences, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, pattern_key) AS rank FROM ({PR._KEYED}) GROUP BY repo, agent, pattern_key) WHERE rank <= {PATTERNS}",
    "memory_findings": f"SELECT * FROM (SELECT repo, file, id, severity, row_number() OVER (PARTITION BY repo, file ORDER BY id DESC) AS rank FROM ({PR._FINDINGS})) WHERE rank <= {FINDINGS}",
}
