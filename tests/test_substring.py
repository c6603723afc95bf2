"""The substring join against all pairs, and recurrence by it."""

import random

from sigmill.operators import review as D
from sigmill.operators import substring as S


def test_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcé ", k=n))
    needles = {(rng.randrange(3), word(rng.randrange(0, 7))) for _ in range(200)} | {(0, "no such"), (1, None), (None, "abc")}
    texts = {(rng.randrange(3), word(rng.randrange(0, 30))) for _ in range(150)} | {(1, None), (None, "abcabc")}
    n, t = (spark.createDataFrame(list(x), f"k int, {c} string") for x, c in ((needles, "needle"), (texts, "text")))
    got = [tuple(r) for r in S.holding(n, t, ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, a, b) for k, a in needles for j, b in texts if k is not None and k == j and a and b and a in b}


def test_candidates_are_few(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=7)) for _ in range(2000)]
    texts = [" ".join(rng.sample(words, 5)) for _ in range(3000)]
    n, t = spark.createDataFrame([(1, w) for w in words], "k int, needle string"), spark.createDataFrame([(1, x) for x in set(texts)], "k int, text string")
    tried, held = S.candidates(n, t, ["k"]).count(), S.holding(n, t, ["k"]).count()
    assert held == sum(w in x for x in set(texts) for w in set(words)) and tried < 0.01 * len(words) * len(texts)


def test_recurrence_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["import", "imports", "unimported", "loop", "loops", "timeout", "time", "é" * 6, "Import", "a%b_cd"]
    rows = [(i, rng.choice([1, 1, 1, 2]), " ".join(rng.choices(words, k=rng.randrange(0, 4)))) for i in range(300)] + [(300, 1, None), (301, None, "import timeout"), (302, 9, "loops")]
    rows += [(303 + k, 1, rows[k][2]) for k in range(5)]
    got = {r.id: (r.earlier, r.confidence) for r in D.related(spark.createDataFrame(rows, "id int, repo int, title string")).collect()}
    assert len(got) == len(rows)
    for i, repo, title in rows:
        long = [w for w in (title or "").lower().split() if len(w) > 4]
        k = min(5, sum(repo is not None and r == repo and j < i and any(w in (t or "").lower() for w in long) for j, r, t in rows))
        assert got[i] == (k, round(min(0.5 + 0.1 * k, 0.95), 2) if k >= 2 else None), i


def test_no_side_of_recurrence_is_broadcast(spark):
    rows = spark.createDataFrame([(i, i % 3, f"timeout {i % 7} unimported") for i in range(60)], "id int, repo int, title string")
    found = D.related(rows)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_titles_are_not_cut_into_grams(spark, monkeypatch):
    # words of titles meet once for all repositories: what is cut into grams doesn't grow with repositories or titles
    rows = spark.createDataFrame([(i, i % 40, f"Timeout number {i} unimported" if i % 2 else f"timeouts at {i} import") for i in range(400)], "id int, repo int, title string")
    cut, whole = [], S._postings
    monkeypatch.setattr(S, "_postings", lambda texts, keys, short: (cut.append(texts), whole(texts, keys, short))[1])
    got = {r.id: r.earlier for r in D.related(rows).collect()}
    assert got == {i: min(5, i // 40) for i in range(400)}
    assert cut and max(t.count() for t in cut) <= 5
