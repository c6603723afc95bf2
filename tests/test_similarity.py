"""String similarity against brute-force versions and hand-computed cases."""

import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmill import plans
from sigmill.functions import text as X

DATA = "/root/testdata/sf0.001"


def jaro(a, b):
    reach, used = max(max(len(a), len(b)) // 2 - 1, 0), set()
    left = []
    for i, c in enumerate(a):
        at = next((j for j in range(len(b)) if abs(i - j) <= reach and j not in used and b[j] == c), None)
        if at is not None:
            used.add(at)
            left.append(c)
    if not left:
        return float(a == b)
    m, t = len(left), sum(x != b[j] for x, j in zip(left, sorted(used))) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def winkler(a, b):
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y or k == 4), min(len(a), len(b), 4))
    return jaro(a, b) + 0.1 * same * (1 - jaro(a, b))


def dice(a, b):
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a.replace(" ", ""), b.replace(" ", "")))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def names():
    return duckdb.sql(f"SELECT p_partkey, p_name FROM '{DATA}/part.parquet' ORDER BY 1").fetchall()


def test_cases():
    a, b = "abcdzzzz", "abcyyyyyyyyyy"
    assert X.jaro(a, b) + 0.3 * (1 - X.jaro(a, b)) == pytest.approx(0.674679, abs=1e-6)
    assert X.jaro("", "") == 1 and X.jaro("", "a") == 0 and X.jaro("martha", "marhta") == pytest.approx(17 / 18)


def test_jaro_winkler_against_brute_force(spark):
    rows = names()
    want = {k: winkler(a, rows[n + 1][1]) for n, (k, a) in enumerate(rows[:-1])}
    got = {r.id: r.score for r in plans.queries()["jaro_winkler"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 6e-5 for k in want)


def fuzzy_brute(queries, listed):
    out = {}
    for a in queries:
        low = a.lower()
        scores = sorted((-(1.0 if low == b.lower() else round(0.6 * winkler(low, b.lower()) + 0.4 * dice(low, b.lower()), 4)), b) for b in listed if b != a)
        inside = [b for _, b in scores if low in b.lower() or b.lower() in low]
        score, best = -scores[0][0], scores[0][1]
        if score < 1 and len(inside) == 1:
            score, best = 0.95, inside[0]
        near = [b for s, b in scores[:3] if score < 0.6 or -s >= 0.5] if score < 0.9 else []
        out[a] = (best if score >= 0.6 else None, score, "match" if score >= 0.9 else "partial" if score >= 0.6 else "none", near)
    return out


@pytest.mark.parametrize("blocks", [(20_000, 2_000), (7, 5)])
def test_fuzzy_best_against_brute_force(spark, monkeypatch, blocks):
    from sigmill.operators import fuzzy as Z

    monkeypatch.setattr(Z, "ROWS", blocks[0])
    monkeypatch.setattr(Z, "QUERIES", blocks[1])
    every = sorted({n for _, n in names()})
    got = plans.queries()["fuzzy_best"](spark, DATA).collect()
    shown = {r["query"]: (r.best, r.score, r.match, [x.rsplit(":", 1)[0] for x in r.suggestions.split(";") if x]) for r in got}
    want = fuzzy_brute(every, every)
    assert shown.keys() == want.keys()
    for k in want:
        assert shown[k][0] == want[k][0] and abs(shown[k][1] - want[k][1]) < 6e-5 and shown[k][2:] == want[k][2:], k


def test_fuzzy_tiers(spark):
    from sigmill.operators.fuzzy import fuzzy

    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {r["query"]: r for r in fuzzy(frame(["UBUNTU", "ubuntu linux", "zzz", "martha"], "query"), frame(["ubuntu", "debian", "marhta"], "name")).collect()}
    assert (got["UBUNTU"].best, got["UBUNTU"].score) == ("ubuntu", 1.0) and (got["ubuntu linux"].best, got["ubuntu linux"].score) == ("ubuntu", 0.95)
    assert got["zzz"].match == "none" and got["zzz"].best is None and len(got["zzz"].suggestions.split(";")) == 3
    assert fuzzy(frame([], "query"), frame(["a"], "name")).count() == 0


def strings(n, seed=1, letters="abcde \u00e9"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randrange(0, 14))) for _ in range(n)]


def test_batches_equal_single_pairs():
    a, b = strings(400, 1) + ["x" * 300, ""], strings(400, 2) + ["x" * 299 + "y", ""]
    assert X.jaro_all(a, b).tolist() == pytest.approx([jaro(x, y) if x != y else 1.0 for x, y in zip(a, b)], abs=1e-12)
    grams = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    want = []
    for x, y in zip(a, b):
        p, q = grams(x.replace(" ", "")), grams(y.replace(" ", ""))
        want.append(1.0 if x == y else 2 * (p & q).total() / (p.total() + q.total()) if p or q else 0.0)
    assert X.dice_all(pd.Series(a), pd.Series(b)).tolist() == pytest.approx(want)


def test_fuzzy_on_odd_strings_against_all_pairs(spark, monkeypatch):
    from sigmill.operators import fuzzy as Z

    every = sorted({*strings(150, 3), "", "A", "a", "AB", "ab", "a b"})
    monkeypatch.setattr(Z, "ROWS", 40)
    got = Z.nearest(spark.createDataFrame([(q,) for q in every + [None]], "query string"), spark.createDataFrame([(q,) for q in every + [None]], "name string")).collect()
    for q in every:
        low = q.lower()
        score = lambda n: 1.0 if low == n else float(Z.scores(pd.Series([low]), pd.Series([n]))[0])  # noqa: B023, E731
        want = sorted((-score(n.lower()), n) for n in every if n != q)[:3]
        assert [(-r.score, r.name) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want, q


def test_fuzzy_over_many_names_scores_few_pairs(spark):
    from sigmill.operators import fuzzy as Z

    rng = random.Random(4)
    parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=range(26, 0, -1), k=rng.randrange(4, 9))) for _ in range(260)]
    listed = sorted({f"{rng.choice(parts)} {rng.choice(parts)}" for _ in range(10_600)})[:10_000]
    asked = [n[:3] + n[4:] for n in rng.sample(listed, 30)] + ["qqqq", "zyx wvu"]
    queries, names = spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(n,) for n in listed], "name string")
    low = lambda df, c, d: df.select(c, F.lower(c).alias(d))
    pairs, rest = Z.candidates(low(queries, "query", "low"), low(names, "name", "other"))
    assert pairs.count() < 0.02 * len(asked) * len(listed) and rest.count() <= 4
    got = {}
    for r in Z.nearest(queries, names).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.name, r.score))
    for q in asked:
        scores = Z.scores(pd.Series([q] * len(listed)), pd.Series(listed)).tolist()
        assert got[q] == [(n, -s) for s, n in sorted((-s, n) for s, n in zip(scores, listed) if n != q)[:3]], q


def test_nulls_and_empty_strings(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", None), ("", ""), ("ab", "ab")], "a string, b string")
    got = df.select(X.jaro_winkler(F.col("a"), F.col("b")).alias("j"), X.dice(F.col("a"), F.col("b")).alias("d"), X.levenshtein_norm(F.col("a"), F.col("b")).alias("l")).collect()
    assert got[0].j is None and got[0].l is None and (got[1].d, got[1].l) == (1.0, 1.0) and (got[2].d, got[2].l) == (1.0, 1.0)
