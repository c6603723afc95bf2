"""Checks over source text: a stack machine over lines, imports against used names.

A file (file, source) becomes lines, lines become statements: strings and comments go, a line inside brackets, inside a string of three
quotes or after a backslash goes on with the statement before it. Statements without indentation cut a file into islands, and within an island an array of
open blocks, the stack, runs over the statements: a block closes at the first statement that isn't deeper. All state that crosses lines is a running
sum of a window or the stack of one island, so a file's islands are handled apart from each other.

The checks read indentation, not syntax trees. Where the two differ: names inside formatted strings count as used whether or not they stand in braces; strings of three
single and of three double quotes aren't told apart; several statements on a line count as one.
Null sources have no lines; a file's name may be null too. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Numbers that need no name, libraries that presentation shouldn't import, places of presentation, calls that need a timeout, limits.
PLAIN_NUMBERS = (0, 1, 2, 100)
INFRASTRUCTURE = ("requests", "pymongo", "sqlite3", "sqlalchemy", "psycopg")
PRESENTATION = ("cli", "presentation", "view", "controller", "routes")
REQUESTS = ("get", "post", "put", "delete", "patch")
LONGEST, DEEPEST, METHODS, NUMBERS = 50, 4, 12, 3
#: Letters of source that a task gets, at most about.
LETTERS = 4_000_000

#: Formatted strings keep their text, other strings and comments go.
QUOTED = r"""[fF][rR]?"([^"\\]*(?:\\.[^"\\]*)*)"|[fF][rR]?'([^'\\]*(?:\\.[^'\\]*)*)'|[rRbBuU]{0,2}"[^"\\]*(?:\\.[^"\\]*)*"|[rRbBuU]{0,2}'[^'\\]*(?:\\.[^'\\]*)*'|#.*"""
CLOSED, OPENED, ENDED = r'""".*?"""', r'""".*$', r'^.*?"""'
DEF, CLASS = r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z_0-9]*)", r"^class\s+([A-Za-z_][A-Za-z_0-9]*)"
KEYWORD = r"^(if|elif|else|for|while|with|try|except|finally)(?:[\s:(\[{]|$)"
IMPORT, FROM = r"^import\s+(.+)$", r"^from\s+(\S+)\s+import\s+(.+)$"
NAMED = r"^\s*([A-Za-z_][A-Za-z_0-9.]*)(?:\s+as\s+([A-Za-z_][A-Za-z_0-9]*))?\s*$"
TOKEN = r"[A-Za-z_0-9.]+"
#: Blocks whose depth counts; those that go on with a block of the same depth; loops.
BLOCKS, JOINS, LOOPS = ("if", "elif", "for", "while", "with", "try"), ("elif", "else", "except", "finally"), ("for", "while")

_OPEN = "struct<line: bigint, indent: int, kind: string, name: string, chain: int, defs: bigint, loops: bigint>"
_DONE = "struct<line: bigint, last: bigint, kind: string, name: string, chain: int, defs: bigint, loops: bigint>"


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of files (file, source), counted from 1."""
    return files.select("file", F.posexplode(F.split("source", r"\r?\n")).alias("line", "text")).select("file", (F.col("line") + 1).cast("long").alias("line"), "text")


def dealt(files: DataFrame, letters: int = LETTERS) -> DataFrame:
    """``files`` dealt by file over tasks of about ``letters`` letters, so that a task's memory doesn't grow with the input: lines compress so well that adaptive execution makes few
    tasks of them. All that is worked out by file stays where its file is."""
    size = files.select(F.sum(F.length("source"))).first()[0] or 0
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-size // letters)), "file")


def _count(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def statements(of_lines: DataFrame) -> DataFrame:
    """(file, line, last, indent, code, kind, name): each statement with its first and last line."""
    order = W.partitionBy("file").orderBy("line")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = of_lines.withColumn("text", F.replace(F.replace("text", F.lit("'''"), F.lit('"""')), F.lit("\t"), F.lit("        ")))
    rows = rows.withColumn("quotes", _count(F.col("text"), '"""')).withColumn("inside", so_far(F.col("quotes")) % 2 == 1)
    bare = F.when(F.col("inside") & (F.col("quotes") == 0), "").when(F.col("inside"), F.regexp_replace("text", ENDED, "")).otherwise(F.col("text"))
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, CLOSED, ""), OPENED, ""), QUOTED, " $1$2 ")
    rows = rows.withColumn("code", F.rtrim(code)).withColumn("indent", (F.length("text") - F.length(F.ltrim("text"))).cast("int"))
    opens = sum((_count(F.col("code"), x) for x in "([{"), F.lit(0)) - sum((_count(F.col("code"), x) for x in ")]}"), F.lit(0))
    rows = rows.withColumn("opens", opens).withColumn("within", so_far(F.col("opens")) > 0).withColumn("goes_on", F.coalesce(F.lag(F.col("code").endswith("\\")).over(order), F.lit(False)))
    solid = F.col("inside") | (F.col("code") != "") | (F.trim("text").startswith('"""'))
    starts = ~F.col("inside") & ~F.col("within") & ~F.col("goes_on") & solid
    rows = rows.withColumn("solid", solid).withColumn("statement", F.sum(starts.cast("long")).over(order)).where("solid and statement > 0")
    parts = F.array_sort(F.collect_list(F.struct("line", F.trim(F.rtrim(F.col("code")), F.lit("\\ ")).alias("code"))))
    one = rows.groupBy("file", "statement").agg(F.min("line").alias("line"), F.max("line").alias("last"), F.min_by("indent", "line").alias("indent"), F.array_join(F.transform(parts, lambda x: x["code"]), " ").alias("code"))
    one = one.withColumn("code", F.trim("code"))
    c = F.col("code")
    is_def, is_class, word = c.rlike(DEF), c.rlike(CLASS), F.regexp_extract("code", KEYWORD, 1)
    kind = F.when(is_def, "def").when(is_class, "class").when(word != "", word).when(c.endswith(":"), "block").otherwise("plain")
    name = F.when(is_def, F.regexp_extract("code", DEF, 1)).when(is_class, F.regexp_extract("code", CLASS, 1))
    return one.select("file", "line", "last", "indent", "code", kind.alias("kind"), name.alias("name"))


def blocks(of_statements: DataFrame) -> DataFrame:
    """(file, line, last, kind, name, chain, defs, loops): each block with its last line, how many blocks are around it within its function (null
    without a function, or with something else between), and how many functions and loops are in it."""
    order = W.partitionBy("file").orderBy("line")
    is_in = lambda *x: F.col("kind").isin(*x)
    top = (F.col("indent") == 0) & ~is_in(*JOINS)
    rows = of_statements.select("*", F.sum(top.cast("long")).over(order).alias("island"), F.sum(is_in("def").cast("long")).over(order).alias("defs"), F.sum(is_in(*LOOPS).cast("long")).over(order).alias("loops"), F.lag("last").over(order).alias("before"))
    each = F.array_sort(F.collect_list(F.struct("line", "indent", "kind", "name", "defs", "loops", "before")))
    islands = rows.groupBy("file", "island").agg(each.alias("x"), F.max("last").alias("last"), F.max("defs").alias("defs"), F.max("loops").alias("loops"))

    def stays(e: Column, x: Column) -> Column:
        return (e["indent"] < x["indent"]) | (x["kind"].isin(*JOINS) & (e["indent"] == x["indent"]) & (e["kind"] != "except"))

    def done(e: Column, last: Column, defs: Column, loops: Column) -> Column:
        return F.struct(e["line"].alias("line"), last.alias("last"), e["kind"].alias("kind"), e["name"].alias("name"), e["chain"].alias("chain"), (defs - e["defs"]).alias("defs"), (loops - e["loops"]).alias("loops"))

    def step(state: Column, x: Column) -> Column:
        kept = F.filter(state["stack"], lambda e: stays(e, x))
        gone = F.filter(state["stack"], lambda e: ~stays(e, x))
        own = lambda kinds: x["kind"].isin(*kinds).cast("long")
        closed = F.transform(gone, lambda e: done(e, x["before"], x["defs"] - own(["def"]), x["loops"] - own(LOOPS)))
        above = F.try_element_at(kept, F.lit(-1))
        chain = F.when(x["kind"].isin(*BLOCKS), F.when(above["kind"] == "def", 0).when(above["kind"].isin(*BLOCKS), above["chain"] + 1))
        entry = F.struct(x["line"].alias("line"), x["indent"].alias("indent"), x["kind"].alias("kind"), x["name"].alias("name"), chain.cast("int").alias("chain"), x["defs"].alias("defs"), x["loops"].alias("loops"))
        opens = x["kind"].isin("def", "class", "except", "block", *BLOCKS)
        return F.struct(F.when(opens, F.concat(kept, F.array(entry))).otherwise(kept).alias("stack"), F.concat(state["done"], closed).alias("done"))

    start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), F.array().cast(f"array<{_DONE}>").alias("done"))
    left = F.aggregate("x", start, step)
    ran = islands.select("file", "last", "defs", "loops", left.alias("s"))
    rest = F.transform("s.stack", lambda e: done(e, F.col("last"), F.col("defs"), F.col("loops")))
    return ran.select("file", F.explode(F.concat("s.done", rest)).alias("b")).select("file", "b.*").where(~F.col("kind").isin("except", "block"))


def imports(of_statements: DataFrame) -> DataFrame:
    """(file, line, module, name, star): what each import binds; name is null for a star."""
    code = F.regexp_replace("code", r"[()]", " ")
    rows = of_statements.select("file", "line", code.alias("code"))
    plain = rows.where(F.col("code").rlike(IMPORT)).select("file", "line", F.explode(F.split(F.regexp_extract("code", IMPORT, 1), ",")).alias("x"))
    plain = plain.where(F.col("x").rlike(NAMED)).select("file", "line", F.regexp_extract("x", NAMED, 1).alias("module"), F.regexp_extract("x", NAMED, 2).alias("a"))
    plain = plain.select("file", "line", "module", F.when(F.col("a") != "", F.col("a")).otherwise(F.split("module", r"\.")[0]).alias("name"), F.lit(False).alias("star"))
    some = rows.where(F.col("code").rlike(FROM)).select("file", "line", F.regexp_extract("code", FROM, 1).alias("module"), F.explode(F.split(F.regexp_extract("code", FROM, 2), ",")).alias("x"))
    star = F.trim("x") == "*"
    some = some.where(star | F.col("x").rlike(NAMED)).select("file", "line", "module", F.regexp_extract("x", NAMED, 1).alias("n"), F.regexp_extract("x", NAMED, 2).alias("a"), star.alias("star"))
    return plain.unionAll(some.select("file", "line", "module", F.when(F.col("star"), None).when(F.col("a") != "", F.col("a")).otherwise(F.col("n")).alias("name"), "star"))


def used(of_statements: DataFrame) -> DataFrame:
    """(file, name): the distinct names that statements other than imports use; of a dotted name the first part."""
    code = F.regexp_replace(F.regexp_replace("code", DEF, " "), CLASS, " ")
    rows = of_statements.where(~F.col("code").rlike(IMPORT) & ~F.col("code").rlike(FROM)).select("file", F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0)))).alias("x"))
    return rows.select("file", F.split("x", r"\.")[0].alias("name")).where(F.col("name").rlike("^[A-Za-z_]")).distinct()


def unused_imports(of_statements: DataFrame) -> DataFrame:
    """(file, line, name): names that are imported and not used in the file, at the first line that imports them."""
    bound = imports(of_statements).where("not star").groupBy("file", "name").agg(F.min("line").alias("line"))
    names = used(of_statements).select(F.col("file").alias("_file"), F.col("name").alias("_name"))
    return bound.join(names, F.col("file").eqNullSafe(F.col("_file")) & (F.col("name") == F.col("_name")), "left_anti").select("file", "line", "name")


def findings(files: DataFrame) -> DataFrame:
    """(file, line, rule, severity, name, amount) of files (file, source), by all checks. Rules on a statement, and rules on a block, are read in one pass each."""
    each = statements(lines(dealt(files)))
    bound = imports(each)
    c, file, name, kind = F.col("code"), F.col("file"), F.col("name"), F.col("kind")
    order = W.partitionBy("file").orderBy("line")

    def rule(title: str, severity: str, what: Column | None = None, amount: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(title).alias("rule"), F.lit(severity).alias("severity"), (none if what is None else what).cast("string").alias("name"), (none if amount is None else amount).cast("long").alias("amount"))

    def held(df: DataFrame, rules: list[tuple[Column, Column]], more: Column | None = None) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(cond, what) for cond, what in rules]))
        return df.select("file", "line", F.explode(found if more is None else F.concat(found, more)).alias("x")).select("file", "line", "x.*")

    length = F.col("last") - F.col("line")
    request = rf"\brequests\.({'|'.join(REQUESTS)})\("
    numbers = F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda x: x.rlike(r"^[0-9]+(\.[0-9]+)?$") & ~x.try_cast("double").isin(*map(float, PLAIN_NUMBERS)))
    counted = each.withColumn("numbers", numbers).withColumn("all", F.sum(F.size("numbers")).over(W.partitionBy("file"))).withColumn("so_far", F.sum(F.size("numbers")).over(order))
    of_statements = held(
        counted,
        [
            (c.rlike(r"^except\s*:"), rule("bare except", "high")),
            (c.rlike(r"\btime\.sleep\("), rule("blocking sleep", "high")),
            (c.rlike(request) & ~c.rlike(r"\btimeout\s*="), rule("no timeout", "high", F.regexp_extract("code", request, 1))),
            ((kind == "def") & ~name.startswith("_") & ~c.contains("->"), rule("no return type", "low", name)),
            (F.trim(F.regexp_extract("code", FROM, 2)) == "*", rule("star import", "high", F.regexp_extract("code", FROM, 1))),
            # the first statement with numbers speaks for its file
            ((F.col("all") > NUMBERS) & (F.size("numbers") > 0) & (F.col("so_far") == F.size("numbers")), rule("many numbers", "low", None, F.col("all"))),
        ],
        F.when(F.col("all") <= NUMBERS, F.transform("numbers", lambda x: rule("number without name", "low", x))).otherwise(F.array()),
    )
    of_blocks = held(
        blocks(each),
        [
            ((kind == "def") & (length > LONGEST), rule("long function", "medium", name, length)),
            (F.col("chain") >= DEEPEST, rule("deep nesting", "medium", kind, F.col("chain"))),
            (kind.isin(*LOOPS) & (F.col("loops") > 0), rule("nested loop", "medium", None, F.col("loops"))),
            ((kind == "class") & (F.col("defs") > METHODS), rule("crowded class", "medium", name, F.col("defs"))),
        ],
    )
    layer = reduce(Column.__or__, [file.contains(x) for x in PRESENTATION]) & reduce(Column.__or__, [F.col("module").contains(x) | F.coalesce(name.contains(x), F.lit(False)) for x in INFRASTRUCTURE])
    always = lambda df, what: held(df, [(F.lit(True), what)])
    repeated = each.where(c.rlike(IMPORT) | c.rlike(FROM)).withColumn("n", F.row_number().over(W.partitionBy("file", "code").orderBy("line"))).where("n > 1")
    found = [
        of_statements, of_blocks, always(unused_imports(each), rule("unused import", "low", name)), always(repeated, rule("repeated import", "low", c)),
        always(bound.where(layer).select("file", "line", "module").distinct(), rule("infrastructure in presentation", "high", F.col("module"))),
    ]
    return reduce(DataFrame.unionAll, found)
