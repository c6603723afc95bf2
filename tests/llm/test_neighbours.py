import numpy as np

from sigmill.llm import neighbours as nb


def brute(ids, x, every, k):
    out = {}
    norm = np.sqrt((x * x).sum(axis=1))
    for a in range(len(ids)):
        if ids[a] % every == 0:
            s = (x[a] * x).sum(axis=1) / (norm[a] * norm)
            order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[b], ids[b]))[:k]
            out[ids[a]] = [(ids[b], s[b]) for b in order]
    return out


def frame(spark, ids, x, odd=()):
    return spark.createDataFrame([(i, [float(c) for c in v], 1, "x") for i, v in zip(ids, x)] + list(odd), "vec_id long, embedding array<float>, label int, class string")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 16))
    x = (centers[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 16))).astype("f4").astype(float)
    x[1000:1400] = x[50]  # a hot vector, of which some are queries
    ids = list(range(3000))
    odd = [(9000, None, 1, "x"), (9050, [0.0] * 16, 1, "x"), (9100, [1.0, None] + [0.0] * 14, 1, "x"), (9150, [float("nan")] * 16, 1, "x"), (9200, [float("inf")] + [1.0] * 15, 1, "x"), (9250, [1.0], 1, "x"), (None, [1.0] * 16, 1, "x"), (9300, [], 1, "x")]
    got = nb.search(frame(spark, ids, x, odd), 50, 5).collect()
    want = brute(ids, x, 50, 5)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == want.keys() and all(len(v) == 5 for v in by.values())
    hit = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want))
    assert hit >= 0.9
    assert by[1000] == [(50, by[1000][0][1])] + [(i, by[1000][0][1]) for i in (1001, 1002, 1003, 1004)]
    norm = np.sqrt((x * x).sum(axis=1))
    for q, found in by.items():
        for i, s in found:
            assert abs(s - (x[q] * x[i]).sum() / norm[q] / norm[i]) < 1e-12


def test_small_tables(spark):
    assert nb.search(frame(spark, [], []), 50, 5).count() == 0
    assert nb.search(frame(spark, [0], [[1, 2]]), 50, 5).count() == 0
    three = nb.search(frame(spark, [0, 1, 1, 2], [[1, 2], [1, 2], [1, 2], [2, 1]]), 50, 5).collect()
    assert [(r["rank"], r.vec_id) for r in three] == [(1, 1), (2, 2)]


def test_equal_scores_of_unequal_vectors(spark):
    """Vectors of one direction and lengths that are powers of two: every cosine is the same number."""
    x = np.array([[3.0 * 2.0 ** (k % 7), 4.0 * 2.0 ** (k % 7)] for k in range(60)])
    got = nb.search(frame(spark, list(range(60)), x), 50, 5).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(0, k) for k in range(1, 6)] + [(50, k) for k in range(5)]
    many = [[2.0 ** (k % 40), 2.0 ** (k % 40)] for k in range(300)]
    got = nb.search(frame(spark, list(range(300)), many), 100, 5).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, k) for k in range(1, 6)} | {(q, k) for q in (100, 200) for k in range(5)}


def test_recall_over_hundreds_of_lists(spark, monkeypatch):
    monkeypatch.setattr(nb, "LIST_ROWS", 20)
    monkeypatch.setattr(nb, "CHUNK", 7)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((200, 24))[rng.integers(0, 200, 8000)] + 0.7 * rng.standard_normal((8000, 24))).astype("f4").astype(float)
    got = nb.search(frame(spark, list(range(8000)), x), 50, 5).collect()
    want = brute(list(range(8000)), x, 50, 5)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == 5 * len(want)
    assert sum((q, i) in found for q, near in want.items() for i, _ in near) >= 0.9 * 5 * len(want)
