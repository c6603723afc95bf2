"""Readers of tools' output and the rules that no table of the test data shows."""

from sigmill.operators import review as D


def test_output_lines(spark):
    lines = spark.createDataFrame([("a/b.py:12: error: Bad thing [arg-type]",), ("a.py:3: note: see",), ("rubbish",), ("m.py:7: unused function 'go' (90% confidence)",)], "line string")
    assert [tuple(r) for r in D.type_lines(lines).collect()] == [("a/b.py", 12, "error", "Bad thing", "arg-type"), ("a.py", 3, "note", "see", "")]
    assert [tuple(r) for r in D.unused_lines(lines).collect()] == [("m.py", 7, "function", "go", 90)]


def test_json_output(spark):
    raw = lambda x: spark.createDataFrame([(x,), (None,), ("broken",)], "raw string")
    lint = '[{"filename": "a.py", "location": {"row": 3, "column": 4}, "code": "F821", "message": "m"}]'
    assert [tuple(r) for r in D.lint_rows(raw(lint), "raw").collect()] == [("a.py", 3, 4, "F821", "m")]
    security = '{"results": [{"filename": "a.py", "line_number": 9, "issue_severity": "HIGH", "issue_confidence": "LOW", "test_id": "B1", "test_name": "t", "issue_text": "x"}]}'
    assert [tuple(r) for r in D.security_rows(raw(security), "raw").collect()] == [("a.py", 9, "HIGH", "LOW", "B1", "x")]
    assert [tuple(r) for r in D.complexity_rows(raw('{"a.py": [{"name": "f", "lineno": 1, "complexity": 12, "rank": "C"}]}'), "raw").collect()] == [("a.py", "f", 1, 12, "C")]


def test_run_summary(spark):
    rows = spark.createDataFrame([("3 passed, 1 failed in 2s",), ("2 errors",), (None,)], "o string").select(*D.test_results(__import__("pyspark").sql.functions.col("o"))).collect()
    assert [tuple(r) for r in rows] == [(3, 1, 0), (0, 0, 2), (0, 0, 0)]


def test_deleted_files_and_odd_lines(spark):
    diff = ["diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "+new", "diff --git a/y.py b/y.py", "--- a/y.py", "+++ /dev/null", "-gone", "diff --git a/z.py b/z.py", "+++ b/z.py", "-- old", "+" + "w" * 20000, "\\ No newline"]
    got = D.parsed(spark.createDataFrame([(1, k, x) for k, x in enumerate(diff)], "pr int, pos int, line string")).collect()
    assert [(r.file, r.kind, len(r.text)) for r in got] == [("x.py", "added", 3), ("z.py", "removed", 5), ("z.py", "added", 20000)]


def test_changes_that_name_no_file_keep_every_issue(spark):
    issues = spark.createDataFrame([(1, 1, "repo\\src\\a.py"), (2, 1, "b.py"), (3, 2, "c.py")], "id int, pr int, file string")
    changed = spark.createDataFrame([(1, "src/a.py")], "pr int, path string")
    assert sorted(r.id for r in D.in_change(issues, changed).collect()) == [1, 3]


def test_feedback_without_outcomes(spark):
    patterns = spark.createDataFrame([(1, "k"), (1, "l")], "repo int, pattern_key string")
    outcomes = spark.createDataFrame([(1, '["k"]', "confirmed"), (1, '["k", "k"]', "false_positive"), (1, None, "confirmed")], "repo int, evidence string, outcome string")
    got = {r.pattern_key: (r.confirmed, r.false_positives, r.confidence) for r in D.feedback(patterns, outcomes).collect()}
    assert got == {"k": (1, 1, 0.5), "l": (0, 0, 0.5)}
