"""Diffs, findings and their history: ``events`` stand for findings (user a repository, event type a rule), documents' lines for added lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import review as D
from sigmill.sources.tables import load

# Words of titles, some of which hold others.
PARTS = ("import", "Imports of module", "unimported", "timeout", "no timeouts", "loops", "nested-loops", "", "long function", "functional")
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
#: Lines of a document stand for a diff of two files and a deleted one: every third line is added, removed or context.
_HEADS = ("diff --git a/app.py b/app.py", "--- a/app.py", "+++ b/app.py"), ("diff --git a/gone.py b/gone.py", "--- a/gone.py", "+++ /dev/null"), ("diff --git a/util.js b/util.js", "--- a/util.js", "+++ b/util.js")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr, pos, line): a diff for each document, its lines dealt to three files."""
    lines = F.split("text", "\n")
    sign = lambda x, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (i % 3 + 1).cast("int")), x)
    third = F.ceil(F.size(lines) / 3).cast("int")
    part = lambda k: F.concat(F.array(*map(F.lit, _HEADS[k])), F.slice(F.transform(lines, sign), third * k + 1, third))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("pr"), F.posexplode(F.concat(part(0), part(1), part(2))).alias("pos", "line"))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parsed(_diffs(spark, sf_dir)).select("pr", "pos", "file", "kind", F.length("text").alias("width"))


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parsed(_diffs(spark, sf_dir)).groupBy("pr", "file").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "context")])


def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, changed lines, languages and warnings of each pull request."""
    return D.totals(D.parsed(_diffs(spark, sf_dir)))


def diff_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines of each file that are long or end in white space, or hold what they shouldn't."""
    return D.line_rules(D.parsed(_diffs(spark, sf_dir)))


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each changed file as it is after the change, by its length and hash."""
    return D.reconstructed(D.parsed(_diffs(spark, sf_dir))).select("pr", "file", F.length("source").alias("width"), F.sha2("source", 256).alias("digest"))


def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines with their number among those of their file."""
    return D.added(D.parsed(_diffs(spark, sf_dir))).select("pr", "file", "line_no", F.length("text").alias("width"))


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/f"), F.col("event_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".TS", ".md", "", ".xyz", ".tar.json")]), (F.col("event_id") % 6 + 1).cast("int")))
    return load(spark, sf_dir, "events").groupBy(D.language(path).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a script for each part: comments out, known keywords only, named by keyword and place."""
    source = F.concat(F.lit("select 1; -- note\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("insert into t values ("), F.col("p_size").cast("string"), F.lit(");; "))).otherwise("-- gone\n; "), F.lit("vacuum; with x as (select 2)\n-- inner\nselect * from x"))
    return D.statements(load(spark, sf_dir, "part").select("p_partkey", source.alias("source")), "source")


def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that are too long, or hold what a rule names."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    long, tok, trail = F.length("line") > 120, F.col("line").contains("token ="), F.col("line").endswith(" ")
    out = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(long).alias("long"), F.count_if(tok).alias("secret"), F.count_if(trail).alias("ends_blank"))
    return out.where("long + secret + ends_blank > 0")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", F.when(F.col("value") >= 100, "critical").otherwise("high")).when(F.col("event_type") == "purchase", "medium").when(F.col("event_type") == "signup", "low").otherwise("info")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("repo"), (F.col("event_id") % 50).alias("pr"), F.col("event_type").alias("agent"), severity.alias("severity"),
        F.concat(F.lit("Rule `"), F.col("event_type"), F.lit("` on line "), F.get_json_object("props", "$.k")).alias("title"), F.concat(F.lit("file"), (F.col("event_id") % 9).cast("string")).alias("file"),
    )


def _keyed(df: DataFrame) -> DataFrame:
    """pattern_key: a digest of repository, agent and title, in which names in backticks and numbers are replaced."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("title"), "`[^`]*`", "`X`"), r"[0-9]+", "N"), r"\s+", " ")
    return df.withColumn("pattern_key", F.substring(F.sha2(F.concat_ws("::", F.col("repo").cast("string"), "agent", plain), 256), 1, 16))


def finding_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("agent", "severity").agg(F.count(F.lit(1)).alias("found"))


def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity of each pull request; LOW below medium."""
    rank = F.max(F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in RANK.items()], F.lit(0)))
    worst = findings(spark, sf_dir).groupBy("repo", "pr").agg(rank.alias("r"))
    return worst.select("repo", "pr", F.when(F.col("r") == 4, "CRITICAL").when(F.col("r") == 3, "HIGH").when(F.col("r") == 2, "MEDIUM").otherwise("LOW").alias("risk"))


def pattern_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(findings(spark, sf_dir)).select("id", "pattern_key")


def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each pattern, its first and last pull request in order of id, and its first title."""
    return _keyed(findings(spark, sf_dir)).groupBy("pattern_key").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min_by("pr", "id").alias("first_pr"), F.max_by("pr", "id").alias("last_pr"), F.min_by(F.substring("title", 1, 200), "id").alias("example")
    )


def pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed of all judged findings (ids divisible by 3 confirmed, by 5 false); 0.5 without any."""
    c, f = F.count_if(F.col("id") % 3 == 0), F.count_if((F.col("id") % 5 == 0) & (F.col("id") % 3 != 0))
    counts = _keyed(findings(spark, sf_dir)).groupBy("pattern_key").agg(c.alias("c"), f.alias("f"))
    return counts.select("pattern_key", F.coalesce(F.round(F.try_divide("c", F.col("c") + F.col("f")), 4), F.lit(0.5)).alias("confidence"))


def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("repo").agg(F.count_distinct("pr").alias("prs"), F.count(F.lit(1)).alias("found"))


def error_prone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five files with most critical or high findings of each repository; ties by file."""
    counts = findings(spark, sf_dir).where(F.col("severity").isin("critical", "high")).groupBy("repo", "file").agg(F.count(F.lit(1)).alias("found"))
    rank = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("found"), "file")).cast("long")
    return counts.withColumn("rank", rank).where("rank <= 5")


def similar_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each finding, how many earlier ones of its pattern there are, five at most, and the confidence that it recurs (null below two)."""
    rows = _keyed(findings(spark, sf_dir)).select("id", "pattern_key")
    # the five smallest ids of a pattern say it all, whatever the pattern's size
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("pattern_key").orderBy("id"))).where("n <= 5").groupBy("pattern_key").agg(F.collect_list("id").alias("ids"))
    out = rows.join(first, "pattern_key").select("id", F.size(F.filter("ids", lambda x: x < F.col("id"))).cast("long").alias("earlier"))
    return out.withColumn("confidence", D.recurrence(F.col("earlier")))


def related_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each finding, how many earlier ones of its repository have a title that holds one of its long words, five at most, and the confidence that it recurs.
    A number in words, by its event, makes some titles' words parts of others'."""
    named = F.element_at(F.array(*map(F.lit, PARTS)), (F.col("id") % len(PARTS) + 1).cast("int"))
    rows = findings(spark, sf_dir).withColumn("title", F.concat(F.regexp_replace("title", "Rule|line", ""), F.lit(" "), named))
    return D.related(rows).select("id", "earlier", "confidence")


def tool_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the rules on tools' codes, from tools' output lines: events stand for issues."""
    n = F.col("event_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (n % len(x) + 1).cast("int"))
    rows = load(spark, sf_dir, "events").select(
        n.alias("id"), pick("ruff", "mypy", "bandit", "radon").alias("tool"), pick("F821", "E902", "B006", "F401", "E501", "W291", "N802").alias("code"), pick("error", "warning", "note").alias("level"),
        pick("HIGH", "MEDIUM", "LOW").alias("rank"), (n % 25).alias("complexity"), F.concat(F.lit("repo/src/m"), (n % 9).cast("string"), F.lit(".py")).alias("file"), (n % 40).alias("pr"),
    )
    return D.tool_rules(rows).select("id", "agent", "severity")


def in_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in changed files: an issue's path ends with a changed one, or its pull request names no files."""
    n = F.col("event_id")
    issues = load(spark, sf_dir, "events").select(n.alias("id"), (n % 40).alias("pr"), F.concat(F.lit("work\\repo/src/m"), (n % 9).cast("string"), F.lit(".py")).alias("file"))
    changed = spark.range(40).where("id % 4 > 0").select(F.col("id").alias("pr"), F.concat(F.lit("src/m"), (F.col("id") % 9).cast("string"), F.lit(".py")).alias("path"))
    return D.in_change(issues, changed).select("id", "pr")


def profile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of functions (line items) that leak, are slow, crash or are heavy, by language."""
    return _runs(spark, sf_dir).groupBy("language").agg(*[F.count_if(c).alias(c) for c in ("leak", "slow", "crash", "heavy")])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max("l_shipdate").alias("d"))
    shaped = rows.select(
        (F.col("l_orderkey") % 997).alias("pr"), F.when(F.col("l_linenumber") % 2 == 0, "Python").otherwise("Go").alias("language"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"),
        (F.col("q") * 6).cast("long").alias("object_delta"), (F.col("q") * 12).alias("mem_delta_kb"), (F.col("p") / 90).alias("cpu_time_ms"), F.when(F.col("q") == 1, "ValueError: x").alias("exception"), "l_orderkey", "l_linenumber",
    )
    return D.profile(shaped)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each pull request merged: counts, time, languages in order of first use, first error."""
    order = F.struct("l_orderkey", "l_linenumber")
    return D.merged(_runs(spark, sf_dir), "pr", order)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the findings and runs of a pull request foretell."""
    crit = findings(spark, sf_dir).groupBy((F.col("id") % 997).alias("pr")).agg(F.count_if(F.col("severity") == "critical").alias("critical"))
    return D.predictions(_runs(spark, sf_dir), crit)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed and false outcomes carried to every pattern in a prediction's evidence (JSON), and the patterns' confidence."""
    keyed = _keyed(findings(spark, sf_dir))
    made = keyed.groupBy("repo", "pr").agg(F.to_json(F.array_sort(F.collect_set("pattern_key"))).alias("evidence"), F.min("id").alias("id"))
    outcome = F.when(F.col("id") % 3 == 0, "confirmed").when(F.col("id") % 3 == 1, "false_positive")
    return D.feedback(keyed.select("repo", "pattern_key").distinct(), made.select("repo", "evidence", outcome.alias("outcome")))


def api_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public functions and classes that a change removes or gives another signature."""
    lines = load(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("pr"), F.lit("a.py").alias("file"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_partkey") % 3 == 0, "removed").when(F.col("p_partkey") % 3 == 1, "added").otherwise("context").alias("kind"),
        F.concat(F.when(F.col("p_partkey") % 7 == 0, "class ").otherwise("  async def "), F.when(F.col("p_partkey") % 11 == 0, "_").otherwise(""), F.regexp_replace("p_name", "[^a-z]", "_"), F.lit("(a, "), F.col("p_size").cast("string"), F.lit("):")).alias("text"))
    return D.api_changes(lines)


def crowded_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions without a blank line since the one before."""
    n = F.col("p_partkey")
    text = F.when(n % 7 == 0, "").when(n % 7 == 3, "    return 1").when(n % 5 == 0, "class A:").otherwise(F.concat(F.lit("  def f"), n.cast("string"), F.lit("():")))
    lines = load(spark, sf_dir, "part").select((n % 20).alias("pr"), F.lit("m.py").alias("file"), n.alias("pos"), F.when(n % 3 == 0, "removed").when(n % 3 == 1, "added").otherwise("context").alias("kind"), text.alias("text"))
    return D.crowded_defs(lines)


def public_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty new public functions and classes of each pull request."""
    n = F.col("p_partkey")
    lines = load(spark, sf_dir, "part").select((n % 20).alias("pr"), F.concat(F.lit("m"), (n % 3).cast("string"), F.lit(".py")).alias("file"), n.alias("pos"), F.lit("added").alias("kind"),
        F.concat(F.when(n % 5 == 0, "class ").otherwise("def "), F.when(n % 4 == 0, "_").otherwise(""), F.lit("x"), (n % 60).cast("string"), F.lit("(self):")).alias("text"))
    return D.symbols(lines).select("pr", "file", "name", "what", "rank")


def sig_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of an old and a new half of the parts: removed, or of another signature (brand); the last definition of a name holds."""
    part = load(spark, sf_dir, "part").withColumn("new", F.col("p_partkey") % 2 == 1)
    sides = part.groupBy("p_name").agg(
        F.max_by(F.when(~F.col("new"), F.col("p_brand")), F.when(~F.col("new"), F.col("p_partkey"))).alias("old"), F.max_by(F.when(F.col("new"), F.col("p_brand")), F.when(F.col("new"), F.col("p_partkey"))).alias("now")
    )
    change = F.when(F.col("now").isNull(), "removed").when(F.col("old") != F.col("now"), "signature")
    return sides.where(F.col("old").isNotNull()).select(F.col("p_name").alias("name"), change.alias("change"), F.when(F.col("now").isNull(), "critical").otherwise("high").alias("severity")).where("change IS NOT NULL")


QUERIES = {f.__name__: f for f in (diff_lines, diff_stats, diff_totals, diff_warnings, new_files, added_lines, file_languages, sql_statements, related_past, tool_findings, in_change, profile_flags, run_report, predictions, feedback, api_changes, crowded_defs, public_symbols, line_rules, finding_severity, risk_level, pattern_key, pattern_stats, pattern_confidence, repo_summary, error_prone, similar_past, sig_changes)}
_FINDINGS = """SELECT event_id AS id, user_id AS repo, event_id % 50 AS pr, event_type AS agent, 'file' || (event_id % 9) AS file,
  CASE WHEN event_type = 'error' THEN CASE WHEN value >= 100 THEN 'critical' ELSE 'high' END WHEN event_type = 'purchase' THEN 'medium' WHEN event_type = 'signup' THEN 'low' ELSE 'info' END AS severity,
  'Rule `' || event_type || '` on line ' || json_extract_string(props, '$.k') AS title FROM events"""
_TITLED = f"SELECT id, repo, regexp_replace(title, 'Rule|line', '', 'g') || ' ' || [{', '.join(f"'{x}'" for x in PARTS)}][id % {len(PARTS)} + 1] AS title FROM ({_FINDINGS})"
_KEYED = f"""SELECT *, substr(sha256(repo || '::' || agent || '::' || regexp_replace(regexp_replace(regexp_replace(lower(title), '`[^`]*`', '`X`', 'g'), '[0-9]+', 'N', 'g'), '\\s+', ' ', 'g')), 1, 16) AS pattern_key FROM ({_FINDINGS})"""
_HEAD_LISTS = ["[" + ", ".join(f"'{x}'" for x in h) + "]" for h in _HEADS]
_THIRDS = " || ".join(f"{h} || l[t * {k} + 1 : t * {k + 1}]" for k, h in enumerate(_HEAD_LISTS))
_LINES = f"""(SELECT pr, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT pr, {_THIRDS} AS x FROM (SELECT doc_id AS pr, list_transform(string_split(text, chr(10)), lambda y, i: ['+', '-', ' '][(i - 1) % 3 + 1] || y) AS l, ceil(len(string_split(text, chr(10))) / 3)::BIGINT AS t FROM documents)))"""
_PARSED = f"""(SELECT pr, pos, file, CASE line[1] WHEN '+' THEN 'added' WHEN '-' THEN 'removed' ELSE 'context' END AS kind, substr(line, 2) AS text FROM (
  SELECT pr, pos, line, last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) WHEN starts_with(line, 'diff --git') OR starts_with(line, '+++ ') THEN '' END IGNORE NULLS) OVER (PARTITION BY pr ORDER BY pos) AS file FROM {_LINES})
  WHERE file <> '' AND line[1] IN ('+', '-', ' ') AND NOT starts_with(line, '+++ ') AND NOT starts_with(line, '--- '))"""
_EVENT = lambda *x: "[" + ", ".join(f"'{y}'" for y in x) + f"][event_id % {len(x)} + 1]"
_RUNS = """(SELECT l_orderkey % 997 AS pr, CASE WHEN l_linenumber % 2 = 0 THEN 'Python' ELSE 'Go' END AS language, max(l_quantity) AS q, max(l_extendedprice) AS p, l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_FLAGS = f"""(SELECT *, CASE WHEN language = 'Python' THEN (q * 6)::BIGINT > 200 ELSE q * 12 > 512 END AS leak, p / 90 > 500 AS slow, q = 1 AS crash, q * 12 > 50000 AS heavy FROM {_RUNS})"""
_API = """(SELECT p_partkey % 50 AS pr, p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN 'removed' ELSE 'now' END AS side, p_partkey % 3 = 1 AS added, CASE WHEN p_partkey % 7 = 0 THEN 'class' ELSE 'def' END AS what,
  CASE WHEN p_partkey % 11 = 0 THEN '_' ELSE '' END || regexp_replace(p_name, '[^a-z]', '_', 'g') AS name, 'a, ' || p_size AS sig FROM part)"""
ORACLE = {
    "diff_lines": f"SELECT pr, pos, file, kind, length(text) AS width FROM {_PARSED}",
    "diff_totals": f"""SELECT pr, count(DISTINCT file) AS files, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, string_agg(DISTINCT CASE WHEN file LIKE '%.py' THEN 'Python' ELSE 'JavaScript' END, ';' ORDER BY CASE WHEN file LIKE '%.py' THEN 'Python' ELSE 'JavaScript' END) AS languages FROM {_PARSED} GROUP BY pr""",
    "diff_warnings": f"""SELECT * FROM (SELECT pr, file, count(*) FILTER (length(text) > 88) AS wide, count(*) FILTER (length(text) > 120) AS long, count(*) FILTER (regexp_matches(text, '\\s$')) AS ends_blank, count(*) FILTER (contains(text, 'eval(')) AS evals, count(*) FILTER (contains(text, 'print(')) AS prints
      FROM {_PARSED} WHERE kind = 'added' GROUP BY ALL) WHERE wide + long + ends_blank + evals + prints > 0""",
    "new_files": f"SELECT pr, file, length(s) AS width, sha256(s) AS digest FROM (SELECT pr, file, string_agg(text, chr(10) ORDER BY pos) AS s FROM {_PARSED} WHERE kind <> 'removed' GROUP BY ALL)",
    "added_lines": f"SELECT pr, file, row_number() OVER (PARTITION BY pr, file ORDER BY pos) AS line_no, length(text) AS width FROM {_PARSED} WHERE kind = 'added'",
    "file_languages": "SELECT ['Python', 'TypeScript', 'Markdown', 'Unknown', 'Unknown', 'JSON'][event_id % 6 + 1] AS language, count(*) AS files FROM events GROUP BY 1",
    "sql_statements": """SELECT p_partkey, name, sql, line FROM (SELECT p_partkey, 'select_1' AS name, 'select 1' AS sql, 1::BIGINT AS line FROM part UNION ALL SELECT p_partkey, 'insert_2', 'insert into t values (' || p_size || ')', 2 FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'with_4' ELSE 'with_4' END, 'with x as (select 2) select * from x', 4 FROM part)""",
    "related_past": f"""WITH f AS MATERIALIZED ({_TITLED}), w AS (SELECT DISTINCT repo, lower(title) AS t, unnest(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: length(w) > 4)) AS word FROM f),
      d AS (SELECT DISTINCT repo, lower(title) AS t FROM f), h AS MATERIALIZED (SELECT DISTINCT w.repo, w.t, d.t AS other FROM w JOIN d ON d.repo = w.repo AND contains(d.t, w.word)),
      e AS (SELECT a.id, count(DISTINCT b.id) AS n FROM f a JOIN h ON h.repo = a.repo AND h.t = lower(a.title) JOIN f b ON b.repo = h.repo AND lower(b.title) = h.other AND b.id < a.id GROUP BY a.id)
      SELECT f.id, least(coalesce(n, 0), 5) AS earlier, CASE WHEN n >= 2 THEN round(least(0.5 + 0.1 * least(n, 5), 0.95)::DOUBLE, 2) END AS confidence FROM f LEFT JOIN e USING (id)""",
    "tool_findings": f"""WITH i AS (SELECT event_id AS id, {_EVENT('ruff', 'mypy', 'bandit', 'radon')} AS tool, {_EVENT('F821', 'E902', 'B006', 'F401', 'E501', 'W291', 'N802')} AS code, {_EVENT('error', 'warning', 'note')} AS level, {_EVENT('HIGH', 'MEDIUM', 'LOW')} AS rank, event_id % 25 AS c FROM events)
      SELECT id, 'bugs' AS agent, CASE rank WHEN 'HIGH' THEN 'high' ELSE 'medium' END AS severity FROM i WHERE tool = 'bandit' AND rank <> 'LOW' UNION ALL SELECT id, 'bugs', 'high' FROM i WHERE tool = 'ruff' AND code[1] = 'B'
      UNION ALL SELECT id, 'quality', CASE WHEN code[:2] IN ('F8', 'E9') THEN 'high' WHEN code[:2] = 'F4' OR code[1] = 'B' THEN 'medium' ELSE 'low' END FROM i WHERE tool = 'ruff' UNION ALL SELECT id, 'quality', 'high' FROM i WHERE tool = 'mypy' AND level = 'error'
      UNION ALL SELECT id, 'performance', CASE WHEN c >= 15 THEN 'high' ELSE 'medium' END FROM i WHERE tool = 'radon' AND c >= 10 UNION ALL SELECT id, 'style', 'low' FROM i WHERE tool = 'ruff' AND code[:2] IN ('E1', 'E2', 'E3', 'E4', 'E5', 'W1', 'W2', 'W3', 'W5', 'W6')""",
    "in_change": "SELECT event_id AS id, event_id % 40 AS pr FROM events WHERE (event_id % 40) % 4 = 0 OR (event_id % 40) % 9 = event_id % 9",
    "profile_flags": f"SELECT language, count(*) FILTER (leak) AS leak, count(*) FILTER (slow) AS slow, count(*) FILTER (crash) AS crash, count(*) FILTER (heavy) AS heavy FROM {_FLAGS} GROUP BY 1",
    "run_report": f"""SELECT pr, count(*) AS functions, count(*) FILTER (leak) AS leak_suspects, count(*) FILTER (slow) AS slow_functions, count(*) FILTER (crash) AS crash_functions, round(sum(p / 90), 3) AS total_ms,
      CASE WHEN count(DISTINCT language) = 2 THEN CASE WHEN min(l_orderkey * 100 + l_linenumber) = min(l_orderkey * 100 + l_linenumber) FILTER (language = 'Go') THEN 'Go;Python' ELSE 'Python;Go' END ELSE min(language) END AS languages,
      CASE WHEN bool_or(crash) THEN 'ValueError: x' END AS error FROM {_FLAGS} GROUP BY pr""",
    "predictions": f"""WITH r AS (SELECT pr, count(*) FILTER (crash) AS crashes, count(*) FILTER (leak) AS leaks, sum((q * 6)::BIGINT) FILTER (leak) AS objects FROM {_FLAGS} GROUP BY pr), c AS (SELECT id % 997 AS pr, count(*) FILTER (severity = 'critical') AS n FROM ({_FINDINGS}) GROUP BY 1)
      SELECT pr, 'crash' AS type, 0.95::DOUBLE AS confidence, crashes AS amount FROM r WHERE crashes > 0 UNION ALL SELECT pr, 'memory_leak', 0.9, objects FROM r WHERE leaks > 0 UNION ALL SELECT pr, 'breaking', 0.99, n FROM c WHERE n > 0""",
    "feedback": f"""WITH k AS (SELECT repo, pr, pattern_key, id FROM ({_KEYED})), m AS (SELECT repo, pr, min(id) AS id FROM k GROUP BY ALL), o AS (SELECT DISTINCT repo, pr, pattern_key, m.id % 3 AS r FROM k JOIN m USING (repo, pr)),
      s AS (SELECT repo, pattern_key, count(*) FILTER (r = 0) AS confirmed, count(*) FILTER (r = 1) AS false_positives FROM o GROUP BY ALL) SELECT repo, pattern_key, confirmed, false_positives, coalesce(round(confirmed / nullif(confirmed + false_positives, 0), 4), 0.5) AS confidence FROM s""",
    "api_changes": f"""WITH a AS {_API}, s AS (SELECT pr, what, name, arg_max(sig, pos) FILTER (side = 'removed') AS old, arg_max(sig, pos) FILTER (side = 'now') AS now, bool_or(side = 'removed') AS gone, bool_or(added) AS added FROM a GROUP BY ALL)
      SELECT pr, 'a.py' AS file, name, CASE WHEN what = 'class' THEN 'class removed' WHEN now IS NULL THEN 'function removed' ELSE 'signature changed' END AS change, CASE WHEN what = 'def' AND now IS NOT NULL THEN 'high' ELSE 'critical' END AS severity
      FROM s WHERE gone AND (what = 'class' AND NOT added OR what = 'def' AND name[1] <> '_' AND (now IS NULL OR now <> old))""",
    "crowded_defs": """WITH l AS (SELECT p_partkey % 20 AS pr, p_partkey AS pos, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 = 3 THEN 1 ELSE 2 END AS k FROM part WHERE p_partkey % 3 <> 0),
      b AS (SELECT *, sum((k = 0)::INT) OVER (PARTITION BY pr ORDER BY pos) AS g FROM l) SELECT pr, 'm.py' AS file, pos FROM (SELECT *, row_number() OVER (PARTITION BY pr, g ORDER BY pos) AS n FROM b WHERE k = 2) WHERE n > 1""",
    "public_symbols": """WITH s AS (SELECT p_partkey % 20 AS pr, 'm' || p_partkey % 3 || '.py' AS file, CASE WHEN p_partkey % 4 = 0 THEN '_' ELSE '' END || 'x' || p_partkey % 60 AS name, CASE WHEN p_partkey % 5 = 0 THEN 'class' ELSE 'def' END AS what, p_partkey AS pos FROM part),
      f AS (SELECT pr, file, name, arg_min(what, pos) AS what, min(pos) AS pos FROM s WHERE what = 'class' OR name[1] <> '_' GROUP BY ALL) SELECT pr, file, name, what, rank FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY file, pos) AS rank FROM f) WHERE rank <= 20""",
    "diff_stats": f"SELECT pr, file, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'context') AS context FROM {_PARSED} GROUP BY pr, file",
    "line_rules": """SELECT * FROM (SELECT doc_id, count(*) AS lines, count(*) FILTER (length(line) > 120) AS long, count(*) FILTER (contains(line, 'token =')) AS secret, count(*) FILTER (line LIKE '% ') AS ends_blank
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id) WHERE long + secret + ends_blank > 0""",
    "finding_severity": f"SELECT agent, severity, count(*) AS found FROM ({_FINDINGS}) GROUP BY 1, 2",
    "risk_level": f"""SELECT repo, pr, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk
      FROM ({_FINDINGS}) GROUP BY repo, pr""",
    "pattern_key": f"SELECT id, pattern_key FROM ({_KEYED})",
    "pattern_stats": f"SELECT pattern_key, count(*) AS occurrences, arg_min(pr, id) AS first_pr, arg_max(pr, id) AS last_pr, arg_min(substr(title, 1, 200), id) AS example FROM ({_KEYED}) GROUP BY 1",
    "pattern_confidence": f"""SELECT pattern_key, coalesce(round(c / nullif(c + f, 0), 4), 0.5) AS confidence FROM (SELECT pattern_key, count(*) FILTER (id % 3 = 0) AS c,
      count(*) FILTER (id % 5 = 0 AND id % 3 <> 0) AS f FROM ({_KEYED}) GROUP BY 1)""",
    "repo_summary": f"SELECT repo, count(DISTINCT pr) AS prs, count(*) AS found FROM ({_FINDINGS}) GROUP BY repo",
    "error_prone": f"""SELECT * FROM (SELECT repo, file, count(*) AS found, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, file) AS rank FROM ({_FINDINGS})
      WHERE severity IN ('critical', 'high') GROUP BY repo, file) WHERE rank <= 5""",
    "similar_past": f"""SELECT id, earlier, CASE WHEN earlier >= 2 THEN round(least(0.5 + 0.1 * earlier, 0.95)::DOUBLE, 2) END AS confidence FROM (
      SELECT id, least(row_number() OVER (PARTITION BY pattern_key ORDER BY id) - 1, 5) AS earlier FROM ({_KEYED}))""",
    "sig_changes": """SELECT name, CASE WHEN now IS NULL THEN 'removed' ELSE 'signature' END AS change, CASE WHEN now IS NULL THEN 'critical' ELSE 'high' END AS severity FROM (
      SELECT p_name AS name, arg_max(p_brand, p_partkey) FILTER (p_partkey % 2 = 0) AS old, arg_max(p_brand, p_partkey) FILTER (p_partkey % 2 = 1) AS now FROM part GROUP BY p_name)
      WHERE old IS NOT NULL AND (now IS NULL OR old <> now)""",
}
