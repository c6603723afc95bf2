"""Source checks against Python's own syntax trees, over this repository's files and written cases."""

import ast
from pathlib import Path

import pytest

from sigmill.operators import source as S

ROOT = Path(__file__).resolve().parent.parent
BLOCK = (ast.If, ast.For, ast.While, ast.With, ast.Try)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
CASES = {
    "deep.py": "def f(a):\n    if a:\n        for x in a:\n            while x:\n                with x as y:\n                    try:\n                        if y:\n                            pass\n                    except:\n                        if a:\n                            pass\n                    finally:\n                        for z in y: pass\n    elif a > 2:\n        if a: pass\n    else:\n        for q in a:\n            pass\n",
    "odd.py": "import os, sys as system\nfrom a.b import (\n    c,\n    d as e,\n)\nfrom q import *\nimport os, sys as system\n\n\nclass A:\n    '''text\nif not code:\n    def no(self):\n    '''\n\n    async def m(self, x=(1,\n  2)):\n        s = 'def x(): # no'\n        return f'{c} {s}' + \"it's\"  # e\n\n    def _n(self) -> int:\n        total = 1 + \\\n  2\n        for i in s:\n            for j in s:\n                total += 7\n        else:\n            while 0: pass\n        return total\n\n    match = 3\n",
    "view/x.py": "import requests\nimport time\nfrom sqlalchemy import orm\ntime.sleep(3)\nrequests.get(u, timeout=3)\nrequests.post(\n    u,\n    5,\n)\nx = 3.5 + 9 + 77\ntry:\n    pass\nexcept :\n    pass\n",
    "tabs.py": "def f():\n\tif a:\n\t\tfor b in a:\n\t\t\tpass\n\n\n# end\ndef g():\n    pass\n",
    "empty.py": "",
    "many.py": "class Big:\n" + "".join(f"    def m{k}(self):\n        return {k}\n" for k in range(14)) + "def long():\n" + "    x = 1\n" * 60 + "y = 2\n",
}


def sources():
    own = {str(p.relative_to(ROOT)): p.read_text() for p in sorted((ROOT / "sigmill").rglob("*.py")) if "llm" not in p.parts}
    return {**own, **CASES}


def chains(node, depth):
    for child in ast.iter_child_nodes(node):
        if isinstance(child, BLOCK):
            yield child.lineno, depth
            yield from chains(child, depth + 1)


@pytest.fixture(scope="module")
def each(spark):
    rows = spark.createDataFrame([*sources().items(), ("null.py", None)], "file string, source string")
    return S.statements(S.lines(rows)).cache()


def test_blocks_against_syntax_trees(each):
    got = S.blocks(each).collect()
    for file, text in sources().items():
        tree = ast.parse(text)
        own = [r for r in got if r.file == file]
        assert {(r.line, r.name, r.last) for r in own if r.kind == "def"} == {(n.lineno, n.name, n.end_lineno) for n in ast.walk(tree) if isinstance(n, DEFS)}, file
        assert {(r.line, r.chain) for r in own if r.chain is not None} == {x for n in ast.walk(tree) if isinstance(n, DEFS) for x in chains(n, 0)}, file
        inner = lambda n, kinds: sum(isinstance(x, kinds) for x in ast.walk(n)) - isinstance(n, kinds)
        assert {(r.line, r.loops) for r in own if r.kind in S.LOOPS} == {(n.lineno, inner(n, (ast.For, ast.While))) for n in ast.walk(tree) if isinstance(n, (ast.For, ast.While))}, file
        assert {(r.line, r.defs) for r in own if r.kind == "class"} == {(n.lineno, inner(n, DEFS)) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}, file


def test_imports_against_syntax_trees(each):
    got = S.imports(each).collect()
    for file, text in sources().items():
        want = set()
        for n in ast.walk(ast.parse(text)):
            if isinstance(n, ast.Import):
                want |= {(n.lineno, a.asname or a.name.split(".")[0]) for a in n.names}
            elif isinstance(n, ast.ImportFrom):
                want |= {(n.lineno, None if a.name == "*" else a.asname or a.name) for a in n.names}
        assert {(r.line, r.name) for r in got if r.file == file} == want, file


def test_unused_names(each):
    got = {(r.file, r.name) for r in S.unused_imports(each).collect()}
    for file, text in sources().items():
        tree = ast.parse(text)
        bound = {a.asname or a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names if a.name != "*"}
        names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
        assert {n for f, n in got if f == file} <= bound - names, file
    assert {x for x in got if x[0] in CASES} == {("odd.py", "os"), ("odd.py", "system"), ("odd.py", "e"), ("view/x.py", "orm")}


def test_findings(spark):
    rows = spark.createDataFrame([*CASES.items(), (None, "except:\n  pass"), ("null.py", None)], "file string, source string")
    got = {(r.file, r.line, r.rule, r.name, r.amount) for r in S.findings(rows).collect()}
    assert {x for x in got if x[2] in ("long function", "crowded class", "deep nesting", "bare except")} == {
        ("many.py", 30, "long function", "long", 60), ("many.py", 1, "crowded class", "Big", 14), ("deep.py", 6, "deep nesting", "try", 4), ("deep.py", 7, "deep nesting", "if", 5), ("deep.py", 13, "deep nesting", "for", 5),
        ("deep.py", 9, "bare except", None, None), ("view/x.py", 13, "bare except", None, None), (None, 1, "bare except", None, None),
    }
    assert {x[:4] for x in got if x[0] == "view/x.py" and x[2] != "bare except"} == {
        ("view/x.py", 1, "infrastructure in presentation", "requests"), ("view/x.py", 3, "infrastructure in presentation", "sqlalchemy"), ("view/x.py", 4, "blocking sleep", None), ("view/x.py", 6, "no timeout", "post"),
        ("view/x.py", 3, "unused import", "orm"), ("view/x.py", 4, "many numbers", None),
    }
    assert {x[1:] for x in got if x[0] == "odd.py"} == {
        (6, "star import", "q", None), (7, "repeated import", "import os, sys as system", None), (1, "unused import", "os", None), (1, "unused import", "system", None), (2, "unused import", "e", None), (16, "no return type", "m", None),
        (24, "nested loop", None, 2), (26, "number without name", "7", None), (31, "number without name", "3", None),
    }


def test_tasks_are_bounded(spark):
    files = spark.createDataFrame([(f"a{i}.py", "import os\n" * 100) for i in range(60)] + [("b.py", None)], "file string, source string")
    dealt = S.dealt(files, letters=3_000)
    assert dealt.count() == 61 and dealt.rdd.getNumPartitions() == 20
    assert S.findings(files).where("rule = 'repeated import'").count() == 60 * 99
    assert S.dealt(files.limit(0)).count() == 0
