"""Numbers, carried values and medians over slices against plain versions, and a hot key over many tasks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sigmill.operators import review as D
from sigmill.operators import selection as M
from sigmill.operators import sequence as Q
from sigmill.operators import trajectory as T


def rows(n=600, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, f"2024-01-{rng.randrange(1, 29):02d}", "x"]), i, rng.choice([None, None, f"v{i}"])) for i in range(n)]


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_numbers_and_carried_values(spark, slices):
    data = rows()
    df = Q.sliced(spark.createDataFrame(data, "k string, ts string, ord long, value string").repartition(5), ["ts", "ord"], slices)
    up = {r.ord: r for r in Q.carried(Q.numbered(df, ["k"], ["ts", "ord"]), ["k"], ["ts", "ord"], F.col("value"), "upto").collect()}
    before = {r.ord: r.last for r in Q.carried(df, ["k"], ["ts", "ord"], F.col("value"), "last", before=True).collect()}
    assert len(up) == len(before) == len(data) and (slices == 1 or max(r._slice for r in up.values()) == slices - 1)
    for key in {r[0] for r in data}:
        own, last = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or "", r[2])), None
        for k, (_, _, i, value) in enumerate(own):
            assert before[i] == last
            last = value or last
            assert (up[i].seq, up[i].n, up[i].upto) == (k, len(own), last)


def test_trajectories_and_diffs_dont_depend_on_slices(spark):
    rng = random.Random(5)
    scored = spark.createDataFrame([(rng.choice([1, 1, 1, 2]), rng.choice(["author", "community"]), rng.choice([None, f"{rng.randrange(50):03d}"]), i, rng.choice([None, *[rng.random()] * 9])) for i in range(400)], "post int, side string, ts string, ord long, score double")
    shown = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert shown(T.stats(scored, 1)) == shown(T.stats(scored, 9))
    assert shown(T.sequenced(scored.fillna(0), 1).select("ord", "seq", "n")) == shown(T.sequenced(scored.fillna(0), 6).select("ord", "seq", "n"))
    lines = [(1, k, rng.choice(["+++ b/x.py", "+++ /dev/null", "diff --git a/y b/y", "+a", "-b", " c", " d", "+e"])) for k in range(500)] + [(2, 0, "+++ b/z.js"), (2, 1, "+z")]
    diff = spark.createDataFrame(lines, "pr int, pos int, line string")
    assert shown(D.parsed(diff, 1)) == shown(D.parsed(diff, 8))


def test_one_key_is_many_tasks_work(spark):
    df = Q.sliced(spark.range(40_000).selectExpr("1 AS k", "id AS pos", "CASE WHEN id % 9000 = 0 THEN id END AS head"), ["pos"], 8)
    sizes = {r._slice: r["count"] for r in df.groupBy("_slice").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 2 * 40_000 / 8
    got = Q.carried(df, ["k"], ["pos"], F.col("head"), "last").agg(F.sum("last")).first()[0]
    assert got == sum(k // 9000 * 9000 for k in range(40_000))


@pytest.mark.parametrize(("parts", "few"), [(4, 1), (16, 5), (1024, 10_000)])
def test_medians(spark, parts, few):
    rng = random.Random(2)
    data = [(k, v) for k, n in (("a", 501), ("b", 400), ("c", 1), ("d", 2)) for v in [rng.choice([rng.gauss(0, 1), 0.25, -3.0, 1e9]) for _ in range(n)]] + [("e", None), (None, 1.0), ("f", 2.0), ("f", 2.0)]
    got = {r.k: r.median for r in M.medians(spark.createDataFrame(data, "k string, v double").repartition(3), "k", "v", parts, few).collect()}
    want = {k: statistics.median([v for j, v in data if j == k and v is not None]) for k in "abcdf"}
    assert got == pytest.approx(want)
    assert M.medians(spark.createDataFrame([], "k int, v double"), "k", "v").count() == 0
