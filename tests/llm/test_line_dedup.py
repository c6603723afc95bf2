import random
from collections import defaultdict
from itertools import combinations

import numpy as np

from sigmill.llm import line_dedup as ld

LINE = "one two three four five six seven eight nine"


def longest_rising(points):
    """The longest rising run, from a quadratic table; of equally long ones that with the smallest end."""
    order = lambda run: (len(run), -run[-1][1] if run else 0)
    runs = []
    for k, p in enumerate(points):
        runs.append(max([runs[j] for j in range(k) if points[j][1] < p[1]], key=order, default=[]) + [p])
    return max(runs, key=order, default=[])


def diff(a, b, i=0, j=0):
    """Patience diff by recursion over texts."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j)] + diff(a[1:], b[1:], i + 1, j + 1)
    if a[-1] == b[-1]:
        return diff(a[:-1], b[:-1], i, j) + [(i + len(a) - 1, j + len(b) - 1)]
    once = [(a.index(x), b.index(x)) for x in dict.fromkeys(a) if a.count(x) == 1 and b.count(x) == 1]
    run = longest_rising(sorted(once))
    if not run:
        return []
    out = diff(a[: run[0][0]], b[: run[0][1]], i, j)
    for (p, q), (r, s) in zip(run, run[1:] + [(len(a), len(b))]):
        out += diff(a[p:r], b[q:s], i + p, j + q)
    return out


def brute(rows):
    """Plain version over all pairs of documents in memory: blocks that patience diff aligns, and blocks that an earlier text holds anywhere."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    lines = {t: [x.strip(" ") for x in t.split("\n")] for _, t in docs}
    count = lambda x: len(x.split(" ")) if x else 0
    size = lambda t, i, j: sum(count(x) for x in lines[t][i:j])
    texts = sorted((i, t) for t, i in first.items())
    lost = defaultdict(set)
    for (_, s), (_, t) in combinations(texts, 2):
        block = []
        for at in diff(lines[t], lines[s]) + [None]:
            if at and block and at == (block[-1][0] + 1, block[-1][1] + 1):
                block.append(at)
                continue
            if sum(count(lines[t][k]) for k, _ in block) >= ld.LEAST_WORDS:
                lost[t] |= {k for k, _ in block}
            block = [at] if at else []
        for i in range(len(lines[t])):
            for p in range(len(lines[s])):
                n = 0
                while i + n < len(lines[t]) and p + n < len(lines[s]) and lines[t][i + n] == lines[s][p + n]:
                    n += 1
                # blank lines at a block's ends are none of it
                a, b = i, i + n
                while a < b and not lines[t][a]:
                    a += 1
                while a < b and not lines[t][b - 1]:
                    b -= 1
                if size(t, a, b) >= ld.LEAST_WORDS:
                    lost[t] |= set(range(a, b))
    for t, own in lines.items():
        solid = [k for k, x in enumerate(own) if x]
        around = lambda k: [max((j for j in solid if j < k), default=-1), min((j for j in solid if j > k), default=-1)]  # noqa: B023, E731
        lost[t] = {k for k in solid if k in lost[t]} | {k for k, x in enumerate(own) if not x and all(j in lost[t] for j in around(k))}
    out = {}
    for i, t in docs:
        whole = i > first[t] and sum(map(count, lines[t])) >= ld.LEAST_WORDS
        out[i] = "" if whole else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost[t])
    return out


def corpus():
    random.seed(2)
    pool = [" ".join(random.choices("abcdefghij", k=random.choice([2, 4, 9, 14]))) for _ in range(60)] + [""]
    rows = []
    for i in range(150):
        at = random.randrange(50)
        own = [" ".join(random.choices("klmnopqrs", k=9)) for _ in range(random.randrange(4))]
        shared = pool[at : at + random.randrange(10)]
        if random.random() < 0.3:
            random.shuffle(shared)
        rows.append((i, "\n".join(own[:1] + shared + own[1:] + random.choices(pool, k=random.randrange(3)))))
    return rows + [(150 + k, rows[4 * k][1]) for k in range(20)] + [(180 + k, rows[3][1] + f"\nown line {k}") for k in range(12)]


def test_against_brute_force(documents):
    rows = corpus()
    rows += [(200, None), (201, ""), (202, rows[3][1]), (None, rows[3][1]), (203, "z " * 60000 + "\n" + rows[5][1])]
    got = {r.doc_id: r.text for r in ld.deduplicated(documents(rows), keep_emptied=True).collect()}
    want = brute(rows)
    assert {i: got[i] for i in want} == want
    assert got[200] is None and got[201] == "" and got[None] == rows[3][1]
    kept = {r.doc_id for r in ld.deduplicated(documents(rows)).collect()}
    assert kept == {i for i, t in got.items() if t is None or t == "" == dict(rows).get(i) or t.strip()}


def test_short_lines_of_a_block_seen_elsewhere_before(documents):
    a, b, c = "red green blue black white", "cat dog cow hen pig", "oak elm ash fir yew"
    rows = [(1, a), (2, b), (3, c), (4, f"{a}\n{b}\n{c}"), (5, f"new words\n{a}\n{b}\n{c}")]
    assert {r.doc_id: r.text for r in ld.deduplicated(documents(rows)).collect()}[5] == "new words"


def test_a_copy_with_a_repeated_inner_line_goes(documents):
    text = "first line here\nsame words\nsame words\nlast line here"
    got = ld.deduplicated(documents([(1, text), (2, text), (3, text + "\nand more")])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, text), (3, "and more")]


def test_a_block_of_common_lines_goes(documents):
    a, b = "red green blue black white grey", "cat dog cow hen pig ant"
    rows = [(i, f"{a}\nown words of {i}") for i in range(20)] + [(20 + i, f"{b}\nother words of {i}") for i in range(20)]
    rows += [(100, f"first\n{a}\n{b}\nthen"), (101, f"{a}\n{b}\nlast"), (102, f"{a}\nbetween\n{b}"), (103, f"{a}\n\n{b}"), (104, f"x\n{a}\n\n{b}\ny")]
    got = {r.doc_id: r.text for r in ld.deduplicated(documents(rows)).collect()}
    assert got[100] == rows[40][1] and got[101] == "last" and got[102] == rows[42][1] and got[103] == rows[43][1] and got[104] == "x\ny"


def test_runs_cover_every_block():
    rng = random.Random(3)
    for _ in range(300):
        words = np.array([rng.choice([0, 0, 1, 2, 3, 5, 9]) for _ in range(rng.randrange(12))], dtype=np.int64)
        got = {tuple(x) for x in ld.runs(words).tolist()}
        every = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if words[i] and words[j - 1] and words[i:j].sum() >= ld.LEAST_WORDS}
        assert got == {(i, j) for i, j in every if words[i : j - 1].sum() < ld.LEAST_WORDS or words[i + 1 : j].sum() < ld.LEAST_WORDS}
        assert {k for i, j in every for k in range(i, j) if words[k]} == {k for i, j in got for k in range(i, j) if words[k]}


def test_moved_and_repeated_lines(documents):
    other = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    got = ld.deduplicated(documents([(1, f"{LINE}\n{other}"), (2, f"{other}\nkept\n{LINE}\n{LINE}")])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, f"{LINE}\n{other}"), (2, "kept")]


def test_repeated_rows_and_empty(documents):
    rows = [(1, LINE), (1, LINE), (2, LINE + "\nother"), (2, LINE + "\nother"), (3, LINE)]
    got = sorted((r.doc_id, r.text) for r in ld.deduplicated(documents(rows), keep_emptied=True).collect())
    assert got == [(1, LINE), (1, LINE), (2, "other"), (2, "other"), (3, "")]
    assert ld.deduplicated(documents([])).count() == 0
