"""Review of changes: diffs, rules on lines, tools' codes and runs, predictions from them, and what feedback says.

Frames in, frames out: diff rows are (pr, pos, line), parsed ones (pr, pos, file, kind, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import sequence as Q
from sigmill.operators import substring as S

# Languages of file endings.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JSX", ".tsx": "TSX", ".java": "Java", ".go": "Go", ".rb": "Ruby", ".rs": "Rust", ".cpp": "C++", ".c": "C", ".cs": "C#", ".php": "PHP",
    ".swift": "Swift", ".kt": "Kotlin", ".sh": "Shell", ".bash": "Shell", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON", ".toml": "TOML", ".md": "Markdown", ".html": "HTML", ".css": "CSS", ".sql": "SQL",
}
# Words that begin a statement which is kept.
STATEMENTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "WITH", "EXPLAIN")
# Beginnings of style codes.
STYLE = ("E1", "E2", "E3", "E4", "E5", "W1", "W2", "W3", "W5", "W6")
# Lines of tools' output: type checks, unused names, test results.
TYPE_LINE = r"^(.+?):(\d+):\s*(error|warning|note):\s*(.+?)(?:\s*\[(.+?)\])?$"
UNUSED_LINE = r"^(.+?):(\d+):\s+unused\s+(\w+)\s+'(.+?)'\s+\((\d+)%"
RESULTS = {"passed": r"(\d+) passed", "failed": r"(\d+) failed", "errors": r"(\d+) error"}
DEF, CLASS = r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)", r"^\s*class\s+(\w+)"

FINDING = ("id", "pr", "agent", "severity", "file")
#: Detectors by name: each takes tool rows and gives findings.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def detector(name: str) -> Callable:
    """Registers a detector: a function from tool rows to rows with a severity, whose other columns follow."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        DETECTORS[name] = lambda rows: f(rows).withColumn("agent", F.lit(name))
        return f

    return register


def parsed(lines: DataFrame, slices: int | None = None) -> DataFrame:
    """(pr, pos, file, kind, text) of unified diff lines (pr, pos, line). Lines of a deleted file belong to no file and are left out. The current file is carried from slice
    to slice of the lines, so a very long diff is no single task's work."""
    line = F.col("line")
    head = F.when(line.startswith("+++ b/"), F.substr(line, F.lit(7))).when(line.startswith("diff --git") | line.startswith("+++ "), "")
    carried = Q.carried(Q.sliced(lines, ["pos"], slices), ["pr"], ["pos"], head, "file")
    kind = F.when(line.startswith("+"), "added").when(line.startswith("-"), "removed").when(line.startswith(" "), "context")
    kept = carried.where((F.col("file") != "") & ~line.startswith("+++ ") & ~line.startswith("--- ")).withColumn("kind", kind)
    return kept.where("kind IS NOT NULL").select("pr", "pos", "file", "kind", F.substr(line, F.lit(2)).alias("text"))


def language(path: Column) -> Column:
    """The language of a file by its ending in lower case; Unknown for others."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending), F.lit("Unknown"))


def totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("pr").agg(
        F.count_distinct("file").alias("files"), F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"),
        F.array_join(F.array_sort(F.collect_set(language(F.col("file")))), ";").alias("languages"),
    )


def line_rules(diff: DataFrame) -> DataFrame:
    """Added lines of a file over 88 and 120 characters, with white space at the end, with eval( or print(; files without any are left out."""
    t = F.col("text")
    rules = {"wide": F.length(t) > 88, "long": F.length(t) > 120, "ends_blank": t.rlike(r"\s$"), "evals": t.contains("eval("), "prints": t.contains("print(")}
    out = diff.where("kind = 'added'").groupBy("pr", "file").agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return out.where(sum((F.col(k) for k in rules), F.lit(0)) > 0)


def crowded_defs(diff: DataFrame) -> DataFrame:
    """(pr, file, pos): definitions in the new file with another one before them and no blank line between."""
    of = W.partitionBy("pr", "file").orderBy("pos")
    x = F.trim("text")
    rows = diff.where("kind <> 'removed'").withColumn("_blanks", F.sum((x == "").cast("int")).over(of))
    defs = rows.where(x.startswith("def ") | x.startswith("class "))
    return defs.withColumn("_n", F.row_number().over(W.partitionBy("pr", "file", "_blanks").orderBy("pos"))).where("_n > 1").select("pr", "file", "pos")


def added(diff: DataFrame) -> DataFrame:
    return diff.where("kind = 'added'").withColumn("line_no", F.row_number().over(W.partitionBy("pr", "file").orderBy("pos")).cast("long"))


def reconstructed(diff: DataFrame) -> DataFrame:
    """(pr, file, source): the added and context lines of each file in order."""
    rows = diff.where("kind <> 'removed'").groupBy("pr", "file").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return rows.select("pr", "file", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("source"))


def statements(sources: DataFrame, source: str) -> DataFrame:
    """The statements of each script: (name, sql, line), line being the statement's number; comment lines go, unknown keywords too."""
    parts = F.filter(F.transform(F.split(source, ";"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    rows = sources.select(*[c for c in sources.columns if c != source], F.posexplode(parts).alias("k", "part"))
    kept = F.filter(F.split("part", r"\r?\n"), lambda x: ~F.trim(x).startswith("--"))
    rows = rows.withColumn("sql", F.regexp_replace(F.array_join(kept, " "), r"^\s+|\s+$", "")).drop("part")
    word = F.regexp_extract(F.upper("sql"), r"^(\S+)", 1)
    out = rows.where(word.isin(*STATEMENTS)).withColumn("line", (F.col("k") + 1).cast("long"))
    return out.withColumn("name", F.concat(F.lower(word), F.lit("_"), F.col("line").cast("string"))).drop("k")


def recurrence(earlier: Column) -> Column:
    """How sure it is that a pattern recurs, by its earlier findings; null below two."""
    return F.when(earlier >= 2, F.round(F.least(0.5 + 0.1 * earlier, F.lit(0.95)), 2))


def long_words(title: Column) -> Column:
    """The distinct words of five letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 4))


#: Parts that each word's pairs are copied to, so that the rows of a frequent word aren't one task's.
PARTS = 16


def related(findings: DataFrame, most: int = 5) -> DataFrame:
    """``findings`` (id, repo, title) with the number of earlier ones of the repository whose title holds a long word of theirs, ``most`` at most, and how sure a recurrence is.

    A long word has no blanks, so a title holds it only within a long word of its own: which words hold which is found once for all repositories, and what a title asks for is the
    set of its long words. A word's first ids say enough: with ``most`` of them before a finding the number is reached, with fewer they are all there are. A set's rows carry the
    first ids of all its words, so no finding meets another, and no side holds more than a row for each finding and word. No side grows slower than the findings, so none is broadcast."""
    asks = F.array_join(F.array_sort(long_words(F.col("title"))), " ")
    rows = findings.select("id", "repo", asks.alias("_asks")).where("repo is not null and _asks <> ''")
    each = F.explode(F.split("_asks", " "))
    known = rows.select(each.alias("word")).distinct()
    held = S.holding(known.select(F.col("word").alias("needle")), known.select(F.col("word").alias("text")), [])
    # the first ids of a set, then of a word, then of all words that hold it, then of a set's words
    at = lambda df, keys: df.withColumn("_n", F.dense_rank().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= most)
    some = lambda ids: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))), 1, most)
    of_set = at(rows, ["repo", "_asks"]).select("repo", "_asks", "id")
    of_word = at(of_set.select("repo", each.alias("text"), "id"), ["repo", "text"]).groupBy("repo", "text").agg(F.collect_set("id").alias("_ids"))
    dealt = of_word.withColumn("_part", F.pmod(F.xxhash64("repo"), F.lit(PARTS)))
    copied = held.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    of_needle = dealt.join(copied.hint("merge"), ["text", "_part"]).groupBy("repo", "needle").agg(some("_ids").alias("_ids"))
    words = of_set.select("repo", "_asks").distinct().select("repo", "_asks", each.alias("needle"))
    first = words.join(of_needle.hint("merge"), ["repo", "needle"]).groupBy("repo", "_asks").agg(some("_ids").alias("_ids"))
    first = first.select(F.col("repo").alias("_repo"), F.col("_asks").alias("_set"), "_ids")
    out = findings.join(first.hint("merge"), (F.col("repo") == F.col("_repo")) & (asks == F.col("_set")), "left")
    earlier = F.coalesce(F.size(F.filter("_ids", lambda x: x < F.col("id"))), F.lit(0)).cast("long")
    out = out.withColumn("earlier", F.when(F.col("_ids").isNull(), F.lit(0)).otherwise(earlier).cast("long")).drop("_ids", "_repo", "_set")
    return out.withColumn("confidence", recurrence(F.col("earlier")))


@detector("bugs")
def bugs(rows: DataFrame) -> DataFrame:
    severity = F.when(F.col("tool") == "bandit", F.when(F.col("rank") == "HIGH", "high").when(F.col("rank") == "MEDIUM", "medium")).when((F.col("tool") == "ruff") & F.col("code").startswith("B"), "high")
    return rows.withColumn("severity", severity)


@detector("quality")
def quality(rows: DataFrame) -> DataFrame:
    code = F.col("code")
    ruff = F.when(code.rlike("^(F8|E9)"), "high").when(code.rlike("^(F4|B)"), "medium").otherwise("low")
    return rows.withColumn("severity", F.when(F.col("tool") == "ruff", ruff).when((F.col("tool") == "mypy") & (F.col("level") == "error"), "high"))


@detector("performance")
def performance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", F.when((F.col("tool") == "radon") & (F.col("complexity") >= 10), F.when(F.col("complexity") >= 15, "high").otherwise("medium")))


@detector("style")
def style(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", F.when((F.col("tool") == "ruff") & F.substring("code", 1, 2).isin(*STYLE), "low"))


def tool_rules(rows: DataFrame) -> DataFrame:
    """The findings of all detectors over tool rows (tool, code, level, rank, complexity and others)."""
    out = None
    for detect in DETECTORS.values():
        found = detect(rows).where("severity is not null")
        out = found if out is None else out.unionByName(found)
    return out


def in_change(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """The ``issues`` (pr, file) whose path ends with one that their pull request changes (pr, path), and those of pull requests that name none."""
    plain = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    paths = changed.groupBy("pr").agg(F.collect_set(plain("path")).alias("_paths"))
    held = issues.join(paths, "pr", "left")
    return held.where(F.col("_paths").isNull() | F.exists("_paths", lambda p: plain("file").endswith(p))).drop("_paths")


def profile(runs: DataFrame) -> DataFrame:
    """``runs`` with flags: leak, slow, crash, heavy."""
    leak = F.when(F.col("language") == "Python", F.col("object_delta") > 200).otherwise(F.col("mem_delta_kb") > 512)
    return runs.withColumns({"leak": leak, "slow": F.col("cpu_time_ms") > 500, "crash": F.col("exception").isNotNull(), "heavy": F.col("mem_delta_kb") > 50_000})


def merged(runs: DataFrame, key: str, order: Column) -> DataFrame:
    """One report of all runs of a key: counts, total time, languages in order of first use, first error."""
    first = runs.groupBy(key, "language").agg(F.min(order).alias("o"))
    used = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "language"))), lambda x: x["language"]), ";").alias("languages"))
    out = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("functions"), F.count_if("leak").alias("leak_suspects"), F.count_if("slow").alias("slow_functions"), F.count_if("crash").alias("crash_functions"),
        F.round(F.sum("cpu_time_ms"), 3).alias("total_ms"), F.min(F.when(F.col("crash"), F.struct(order.alias("o"), "exception")))["exception"].alias("error"),
    )
    return out.join(used, key)


def predictions(runs: DataFrame, critical: DataFrame) -> DataFrame:
    """(pr, type, confidence, amount): crashes and leaks that runs (pr, crash, leak, object_delta) show, and breaking findings (pr, critical)."""
    sums = runs.groupBy("pr").agg(F.count_if("crash").alias("crashes"), F.count_if("leak").alias("leaks"), F.sum(F.when(F.col("leak"), F.col("object_delta"))).alias("objects"))
    of = lambda df, cond, kind, sure, amount: df.where(cond).select("pr", F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), F.col(amount).cast("long").alias("amount"))
    return of(sums, "crashes > 0", "crash", 0.95, "crashes").unionAll(of(sums, "leaks > 0", "memory_leak", 0.9, "objects")).unionAll(of(critical, "critical > 0", "breaking", 0.99, "critical"))


def recurring(keyed: DataFrame, agent: str, least: int = 2) -> DataFrame:
    """(repo, type, confidence, amount, severity): repositories with patterns of an agent that were found ``least`` times or more, and how many."""
    patterns = keyed.where(F.col("agent") == agent).groupBy("repo", "pattern_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return patterns.groupBy("repo").agg(F.lit("performance_regression").alias("type"), F.lit(0.7).alias("confidence"), F.count(F.lit(1)).alias("amount"), F.lit("medium").alias("severity"))


def feedback(patterns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each pattern (repo, pattern_key) with the outcomes (repo, evidence as a JSON list of keys, outcome) that name it, and its confidence; 0.5 without any."""
    each = outcomes.select("repo", F.explode(F.array_distinct(F.from_json("evidence", "array<string>"))).alias("pattern_key"), "outcome")
    counts = each.groupBy("repo", "pattern_key").agg(F.count_if(F.col("outcome") == "confirmed").alias("confirmed"), F.count_if(F.col("outcome") == "false_positive").alias("false_positives"))
    out = patterns.join(counts, ["repo", "pattern_key"], "left").fillna(0, ["confirmed", "false_positives"])
    return out.withColumn("confidence", F.coalesce(F.round(F.try_divide("confirmed", F.col("confirmed") + F.col("false_positives")), 4), F.lit(0.5)))


def api_changes(diff: DataFrame) -> DataFrame:
    """(pr, file, name, change, severity): public functions removed or with another signature, classes removed. Context lines count as new; the last definition of a name holds."""
    removed = F.col("kind") == "removed"
    text = F.col("text")
    last = lambda cond: F.max(F.when(cond, F.struct("pos", "sig")))["sig"]
    functions = diff.where(text.rlike(DEF)).select("pr", "file", "pos", "kind", F.regexp_extract(text, DEF, 1).alias("name"), F.trim(F.regexp_extract(text, DEF, 2)).alias("sig"))
    sides = functions.where(~F.col("name").startswith("_")).groupBy("pr", "file", "name").agg(last(removed).alias("old"), last(~removed).alias("now")).where("old is not null")
    change = F.when(F.col("now").isNull(), "function removed").when(F.col("old") != F.col("now"), "signature changed")
    classes = diff.where(text.rlike(CLASS)).select("pr", "file", "kind", F.regexp_extract(text, CLASS, 1).alias("name"))
    gone = classes.groupBy("pr", "file", "name").agg(F.max(removed).alias("gone"), F.max(F.col("kind") == "added").alias("back")).where("gone and not back")
    return (
        sides.select("pr", "file", "name", change.alias("change"), F.when(F.col("now").isNull(), "critical").otherwise("high").alias("severity")).where("change is not null")
        .unionAll(gone.select("pr", "file", "name", F.lit("class removed"), F.lit("critical")))
    )


def symbols(diff: DataFrame, most: int = 20) -> DataFrame:
    """(pr, file, name, what, rank): the first ``most`` added public functions and classes of each pull request, by file and place, each name of a file once."""
    text = F.col("text")
    is_def = text.rlike(DEF) & ~F.regexp_extract(text, DEF, 1).startswith("_")
    found = diff.where((F.col("kind") == "added") & (is_def | text.rlike(CLASS)))
    named = found.select("pr", "file", "pos", F.when(is_def, F.regexp_extract(text, DEF, 1)).otherwise(F.regexp_extract(text, CLASS, 1)).alias("name"), F.when(is_def, "def").otherwise("class").alias("what"))
    once = named.groupBy("pr", "file", "name").agg(F.min(F.struct("pos", "what")).alias("m")).select("pr", "file", "name", "m.pos", "m.what")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("pr").orderBy("file", "pos")).cast("long")).where(F.col("rank") <= most).drop("pos")


def type_lines(lines: DataFrame) -> DataFrame:
    """(file, line, level, message, code) of a type checker's output lines (line)."""
    x = F.col("line")
    at = lambda k: F.regexp_extract(x, TYPE_LINE, k)
    return lines.where(x.rlike(TYPE_LINE)).select(at(1).alias("file"), at(2).cast("int").alias("line_no"), at(3).alias("level"), at(4).alias("message"), at(5).alias("code"))


def unused_lines(lines: DataFrame) -> DataFrame:
    """(file, line, what, name, confidence) of lines about unused names."""
    x = F.col("line")
    at = lambda k: F.regexp_extract(x, UNUSED_LINE, k)
    return lines.where(x.rlike(UNUSED_LINE)).select(at(1).alias("file"), at(2).cast("int").alias("line_no"), at(3).alias("what"), at(4).alias("name"), at(5).cast("int").alias("confidence"))


def test_results(output: Column) -> list[Column]:
    """Counts of a test run's summary, 0 where it names none."""
    return [F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(output, p, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)).alias(k) for k, p in RESULTS.items()]


#: Schemas of tools' JSON output.
LINT = "array<struct<filename: string, location: struct<row: int, column: int>, code: string, message: string>>"
SECURITY = "struct<results: array<struct<filename: string, line_number: int, issue_severity: string, issue_confidence: string, test_id: string, test_name: string, issue_text: string>>>"
COMPLEXITY = "map<string, array<struct<name: string, lineno: int, complexity: int, rank: string>>>"


def lint_rows(output: DataFrame, raw: str) -> DataFrame:
    return output.select(F.explode(F.from_json(raw, LINT)).alias("x")).select(F.col("x.filename").alias("file"), F.col("x.location.row").alias("line_no"), F.col("x.location.column").alias("col"), "x.code", "x.message")


def security_rows(output: DataFrame, raw: str) -> DataFrame:
    rows = output.select(F.explode(F.from_json(raw, SECURITY)["results"]).alias("x"))
    return rows.select(F.col("x.filename").alias("file"), F.col("x.line_number").alias("line_no"), F.col("x.issue_severity").alias("rank"), F.col("x.issue_confidence").alias("confidence"), F.col("x.test_id").alias("code"), F.col("x.issue_text").alias("message"))


def complexity_rows(output: DataFrame, raw: str) -> DataFrame:
    rows = output.select(F.explode(F.from_json(raw, COMPLEXITY)).alias("file", "f")).select("file", F.explode("f").alias("x"))
    return rows.select("file", F.col("x.name").alias("function"), F.col("x.lineno").alias("line_no"), "x.complexity", "x.rank")
