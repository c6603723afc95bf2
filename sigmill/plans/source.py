"""Checks over source text: documents' lines stand for statements, chosen by a line's length and place, indented by its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import source as S
from sigmill.sources.tables import load

# The statements that lines stand for; {n} is the line's length, {k} a small number out of it.
STATEMENTS = (
    "def f{n}(a):", "def _g{k}(a) -> int:", "class C{n}(B):", "if v{k} > {n}:", "for x in v{k}:", "while v{k}:", "with v{k} as y:  # {n}", "try:", "except:", "elif v{k}:", "else:", "import v{k}.w",
    "from m.v{k} import *", "from p import v{k} as q{k}, r{n}", "requests.get(v{k}, 0)", "z = \"v{k} # {n}\" + f'{v{k}}' * 2.50",
)
#: Lines after which a file's indentation begins again, and the deepest one.
ISLAND, LEVELS = 97, 7


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, source): a file for each document, a line for each of its lines."""

    def line(x, i):
        n, at = F.length(x), i % ISLAND
        kind = F.when(at == 0, F.when(n % 2 == 0, 0).otherwise(2)).otherwise((n + i) % len(STATEMENTS))
        level = F.when(at == 0, 0).otherwise(1 + i % LEVELS)
        text = F.element_at(F.array(*map(F.lit, STATEMENTS)), (kind + 1).cast("int"))
        filled = F.replace(F.replace(text, F.lit("{n}"), n.cast("string")), F.lit("{k}"), (n % 13).cast("string"))
        return F.concat(F.repeat(F.lit("    "), level.cast("int")), filled)

    file = F.concat(F.when(F.col("doc_id") % 3 == 0, "view/a").otherwise("lib/a"), F.col("doc_id").cast("string"), F.lit(".py"))
    return load(spark, sf_dir, "documents").select(file.alias("file"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("source"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statements(S.lines(_files(spark, sf_dir)))


def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks are around each block within its function."""
    return S.blocks(_statements(spark, sf_dir)).where("chain is not null").select("file", "line", "kind", F.col("chain").cast("long").alias("depth"))


def long_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.blocks(_statements(spark, sf_dir)).where(f"kind = 'def' and last - line > {S.LONGEST}")
    return found.select("file", "line", "name", (F.col("last") - F.col("line")).alias("length"))


def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unused_imports(_statements(spark, sf_dir))


def star_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.imports(_statements(spark, sf_dir)).where("star").select("file", "line", "module")


def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all checks."""
    return S.findings(_files(spark, sf_dir))


QUERIES = {f.__name__: f for f in (nesting_depth, long_functions, unused_imports, star_imports, source_findings)}
_Q = lambda x: "'" + x.replace("'", "''") + "'"
_IN = lambda x: "(" + ", ".join(map(_Q, x)) + ")"
_LINE = f"""repeat('    ', CASE WHEN i % {ISLAND} = 0 THEN 0 ELSE 1 + i % {LEVELS} END) || replace(replace([{', '.join(map(_Q, STATEMENTS))}][(CASE WHEN i % {ISLAND} = 0 THEN CASE WHEN length(x) % 2 = 0 THEN 0 ELSE 2 END ELSE (length(x) + i) % {len(STATEMENTS)} END) + 1], '{{n}}', length(x)::VARCHAR), '{{k}}', (length(x) % 13)::VARCHAR)"""
#: A block closes at the first later statement that isn't deeper; a block's parent is the latest that is still open.
_S = f"""WITH RECURSIVE l AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'view/a' ELSE 'lib/a' END || doc_id || '.py' AS file, i + 1 AS line, {_LINE} AS text
   FROM (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents))),
 c AS (SELECT file, line, text, rtrim(regexp_replace(text, {_Q(S.QUOTED)}, ' \\1\\2 ', 'g')) AS t FROM l),
 s AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(code, {_Q(S.DEF)}) THEN 'def' WHEN regexp_matches(code, {_Q(S.CLASS)}) THEN 'class' WHEN regexp_matches(code, {_Q(S.KEYWORD)}) THEN regexp_extract(code, {_Q(S.KEYWORD)}, 1) WHEN ends_with(code, ':') THEN 'block' ELSE 'plain' END AS kind,
   coalesce(nullif(regexp_extract(code, {_Q(S.DEF)}, 1), ''), nullif(regexp_extract(code, {_Q(S.CLASS)}, 1), '')) AS name FROM (SELECT file, line, trim(t) AS code, length(text) - length(ltrim(text)) AS indent FROM c WHERE trim(t) <> '')),
 o AS MATERIALIZED (SELECT e.file, e.line, e.kind, e.name, min(j.line) AS shut FROM s e LEFT JOIN s j ON j.file = e.file AND j.line > e.line AND (j.indent < e.indent OR j.indent = e.indent AND (j.kind NOT IN {_IN(S.JOINS)} OR e.kind = 'except'))
   WHERE e.kind IN {_IN(('def', 'class', 'except', 'block', *S.BLOCKS))} GROUP BY ALL),
 p AS MATERIALIZED (SELECT x.file, x.line, x.kind, max(e.line) AS up FROM o x LEFT JOIN o e ON e.file = x.file AND e.line < x.line AND (e.shut IS NULL OR e.shut > x.line) WHERE x.kind IN {_IN(S.BLOCKS)} GROUP BY ALL),
 d AS (SELECT p.file, p.line, p.kind, 0::BIGINT AS depth FROM p JOIN o ON o.file = p.file AND o.line = p.up AND o.kind = 'def' UNION ALL SELECT p.file, p.line, p.kind, depth + 1 FROM p JOIN d ON d.file = p.file AND d.line = p.up),
 b AS MATERIALIZED (SELECT o.file, o.line, o.kind, o.name, max(s.line) AS last, count(*) FILTER (s.kind = 'def' AND s.line > o.line) AS defs, count(*) FILTER (s.kind IN {_IN(S.LOOPS)} AND s.line > o.line) AS loops FROM o JOIN s ON s.file = o.file AND s.line >= o.line AND (shut IS NULL OR s.line < shut) GROUP BY ALL),
 i AS MATERIALIZED (SELECT file, line, module, CASE WHEN star THEN NULL WHEN a <> '' THEN a WHEN plain THEN split_part(n, '.', 1) ELSE n END AS name, star FROM (
   SELECT file, line, true AS plain, regexp_extract(x, {_Q(S.NAMED)}, 1) AS module, regexp_extract(x, {_Q(S.NAMED)}, 1) AS n, regexp_extract(x, {_Q(S.NAMED)}, 2) AS a, false AS star FROM (SELECT file, line, unnest(string_split(regexp_extract(code, {_Q(S.IMPORT)}, 1), ',')) AS x FROM s WHERE regexp_matches(code, {_Q(S.IMPORT)}))
   UNION ALL SELECT file, line, false, module, regexp_extract(x, {_Q(S.NAMED)}, 1), regexp_extract(x, {_Q(S.NAMED)}, 2), trim(x) = '*' FROM (SELECT file, line, regexp_extract(code, {_Q(S.FROM)}, 1) AS module, unnest(string_split(regexp_extract(code, {_Q(S.FROM)}, 2), ',')) AS x FROM s WHERE regexp_matches(code, {_Q(S.FROM)})))),
 t AS MATERIALIZED (SELECT file, line, kind, unnest(regexp_extract_all(regexp_replace(regexp_replace(code, {_Q(S.DEF)}, ' '), {_Q(S.CLASS)}, ' '), {_Q(S.TOKEN)})) AS x, code FROM s),
 u AS (SELECT i.file, min(i.line) AS line, i.name FROM i WHERE NOT star AND NOT EXISTS (SELECT 1 FROM t WHERE t.file = i.file AND split_part(x, '.', 1) = i.name AND NOT regexp_matches(code, {_Q(S.IMPORT)}) AND NOT regexp_matches(code, {_Q(S.FROM)})) GROUP BY i.file, i.name),
 m AS (SELECT file, line, x FROM (SELECT file, line, unnest(regexp_extract_all(code, {_Q(S.TOKEN)})) AS x FROM s) WHERE regexp_matches(x, '^[0-9]+(\\.[0-9]+)?$') AND x::DOUBLE NOT IN ({', '.join(map(str, S.PLAIN_NUMBERS))})),
 k AS (SELECT file, min(line) AS line, count(*) AS n FROM m GROUP BY file)"""
_RULES = f"""SELECT file, line, 'long function' AS rule, 'medium' AS severity, name, last - line AS amount FROM b WHERE kind = 'def' AND last - line > {S.LONGEST}
 UNION ALL SELECT file, line, 'deep nesting', 'medium', kind, depth FROM d WHERE depth >= {S.DEEPEST} UNION ALL SELECT file, line, 'nested loop', 'medium', NULL, loops FROM b WHERE kind IN {_IN(S.LOOPS)} AND loops > 0
 UNION ALL SELECT file, line, 'crowded class', 'medium', name, defs FROM b WHERE kind = 'class' AND defs > {S.METHODS} UNION ALL SELECT file, line, 'unused import', 'low', name, NULL FROM u
 UNION ALL SELECT file, line, 'repeated import', 'low', code, NULL FROM (SELECT *, row_number() OVER (PARTITION BY file, code ORDER BY line) AS n FROM s WHERE regexp_matches(code, {_Q(S.IMPORT)}) OR regexp_matches(code, {_Q(S.FROM)})) WHERE n > 1
 UNION ALL SELECT file, line, 'star import', 'high', module, NULL FROM i WHERE star
 UNION ALL SELECT DISTINCT file, line, 'infrastructure in presentation', 'high', module, NULL::BIGINT FROM i WHERE ({' OR '.join(f"contains(file, '{x}')" for x in S.PRESENTATION)}) AND ({' OR '.join(f"contains(module, '{x}') OR coalesce(contains(name, '{x}'), false)" for x in S.INFRASTRUCTURE)})
 UNION ALL SELECT file, line, 'bare except', 'high', NULL, NULL FROM s WHERE regexp_matches(code, '^except\\s*:') UNION ALL SELECT file, line, 'blocking sleep', 'high', NULL, NULL FROM s WHERE regexp_matches(code, '\\btime\\.sleep\\(')
 UNION ALL SELECT file, line, 'no timeout', 'high', regexp_extract(code, 'requests\\.([a-z]+)\\(', 1), NULL FROM s WHERE regexp_matches(code, '\\brequests\\.({'|'.join(S.REQUESTS)})\\(') AND NOT regexp_matches(code, '\\btimeout\\s*=')
 UNION ALL SELECT file, line, 'no return type', 'low', name, NULL FROM s WHERE kind = 'def' AND name[1] <> '_' AND NOT contains(code, '->')
 UNION ALL SELECT file, line, 'many numbers', 'low', NULL, n FROM k WHERE n > {S.NUMBERS} UNION ALL SELECT m.file, m.line, 'number without name', 'low', x, NULL FROM m JOIN k ON k.file = m.file WHERE n <= {S.NUMBERS}"""
ORACLE = {
    "nesting_depth": f"{_S} SELECT file, line, kind, depth FROM d",
    "long_functions": f"{_S} SELECT file, line, name, last - line AS length FROM b WHERE kind = 'def' AND last - line > {S.LONGEST}",
    "unused_imports": f"{_S} SELECT file, line, name FROM u",
    "star_imports": f"{_S} SELECT file, line, module FROM i WHERE star",
    "source_findings": f"{_S} {_RULES}",
}
