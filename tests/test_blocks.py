"""Searches in blocks: what is sent and held at once, groups that share a task, and nearest texts of odd shapes against all pairs."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from sigmill import plans
from sigmill.operators import blocks as B
from sigmill.operators import neighbours as N

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("rows", "queries"), [(41_000, 10_250), (410_000, 102_500)])
def test_few_copies_of_texts_are_sent(rows, queries):
    many, asked = B.grid(rows, queries, N.ROWS, N.QUERIES, 12)
    assert many * asked >= 12 and rows * asked + queries * many <= 4 * rows


@pytest.mark.parametrize("rows", [205_000, 410_000, 820_000])
def test_no_core_waits_for_the_last_pairs(rows):
    many, asked = B.grid(rows, rows // 4, N.ROWS, N.QUERIES, 12)
    assert many * asked / 12 / -(-many * asked // 12) > 0.8 and rows / many <= N.ROWS


def test_texts_of_other_lengths_are_left_out(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(N, "FIRST", 50)
    scored, take = [], N.Queries._take
    monkeypatch.setattr(N.Queries, "_take", lambda self, i, tile, distance, k: (scored.append(len(distance)), take(self, i, tile, distance, k)))
    texts = [np.array([rng.randrange(40) for _ in range(10 * 3**n)], dtype=np.int64) for n in range(6) for _ in range(50)]
    index = N.Index(pd.Series(texts))
    for n in range(0, 300, 30):
        scored.clear()
        at, distance = index.nearest(texts[n], np.arange(300), 5)
        assert (at[0], distance[0]) == (n, 0) and sum(scored) <= 150


def test_scores_at_once_are_bounded():
    for rows, queries in ((20_000, 2_000), (20_000, 10), (3, 2_000), (5_000_000, 3), (0, 4)):
        cut = list(B.slices(queries, rows))
        assert sorted(k for c in cut for k in range(queries)[c]) == list(range(queries))
        assert all(len(range(queries)[c]) == 1 or len(range(queries)[c]) * rows <= B.CELLS for c in cut)


@pytest.mark.parametrize("sizes", [(1, 1), (7, 3), (40, 40)])
def test_each_pair_meets_once(spark, sizes):
    def score(q, block):
        total, seen = block
        return pd.DataFrame([(a, b) for a in q["a"] for b in seen], columns=["a", "b"]) if total else pd.DataFrame({"a": [], "b": []})

    frame = lambda n, c: spark.createDataFrame([(i,) for i in range(n)], f"{c} long")
    for n, m in ((25, 9), (0, 4), (4, 0)):
        got = B.against(frame(n, "b"), frame(m, "a"), "b", "a", score, "a long, b long", *sizes, prepare=lambda r: (len(r), r["b"].tolist())).collect()
        assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(m) for b in range(n)]


def test_bounds_lose_no_neighbour(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(N, "FIRST", 2)
    monkeypatch.setattr(N, "AT_ONCE", 5)
    pool = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(3_000)]
    weights = [1 / (k + 1) for k in range(len(pool))]
    texts = [rng.choices(pool, weights, k=rng.choice([0, 1, 5, 80, 400])) for _ in range(500)]
    texts += [[pool[0]] * 70_000, [pool[0]] * 70_001 + [pool[5]], texts[7], texts[7], []]
    asked = texts[:40] + texts[-5:] + [[1, 2, 3], [pool[0]] * 70_000 + [pool[9]]]
    bags = [Counter(t) for t in texts]
    ids = np.array(rng.sample(range(10_000), len(texts)))
    shape = lambda many: pd.Series([np.array(t, dtype=np.int64) for t in many])
    for text, (at, distance) in zip(asked, N.Index(shape(texts)).all_nearest(shape(asked), ids, 5), strict=True):
        bag = Counter(text)
        far = [sum((bag[w] - b[w]) ** 2 for w in bag.keys() | b.keys()) for b in bags]
        want = sorted((d, int(i)) for d, i in zip(far, ids))[:5]
        assert [(round(d), int(ids[a])) for a, d in zip(at, distance)] == want
    assert [len(a) for a, _ in N.Index(shape([])).all_nearest(shape([[1]]), np.zeros(0, dtype=np.int64), 5)] == [0]


def step(spark, monkeypatch, name):
    """What a vector query hands to a task: the frames that a batch of questions finds in a block of rows, one after the other."""
    held, whole = [], B.against

    def kept(*args, **more):
        held.append((args[4], more.get("prepare")))
        return whole(*args, **more)

    monkeypatch.setattr(B, "against", kept)
    plans.queries()[name](spark, DATA)
    ((score, prepare),) = held

    def found(q, rows):
        out = score(q, rows if prepare is None else prepare(rows))
        yield from [out] if isinstance(out, pd.DataFrame) else out

    return found


def vectors(rows, queries, labels, length=8):
    rng = np.random.default_rng(5)
    r = pd.DataFrame({"vec_id": np.arange(rows), "label": rng.integers(0, labels, rows).astype("int32"), "embedding": list(rng.normal(size=(rows, length)).astype("float32"))})
    every = max(1, rows // queries)
    return r[::every].rename(columns={"vec_id": "query_id", "label": "query_label", "embedding": "q"}).reset_index(drop=True), r


def peak(spark, monkeypatch, name, labels):
    found, (q, r) = step(spark, monkeypatch, name), vectors(20_000, 2_000, labels)
    tracemalloc.start()
    try:
        assert sum(len(f) for f in found(q, r)) >= len(q)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_cosine_topk_holds_few_scores(spark, monkeypatch):
    assert peak(spark, monkeypatch, "cosine_topk", 10) < 150


@pytest.mark.parametrize("labels", [10, 20_000])
def test_knn_label_holds_few_scores(spark, monkeypatch, labels):
    assert peak(spark, monkeypatch, "knn_label", labels) < 150


@pytest.mark.parametrize("labels", [10, 5_000])
def test_greedy_f1_holds_few_scores(spark, monkeypatch, labels):
    assert peak(spark, monkeypatch, "greedy_f1", labels) < 150


def test_greedy_f1_finds_the_best_of_each_label(spark, monkeypatch):
    monkeypatch.setattr(B, "CELLS", 700)
    q, r = vectors(300, 30, 40)
    for labels in (r["label"], r["label"].astype(float).where(r["vec_id"] % 3 > 0), pd.Series([None] * len(r), dtype=float), pd.Series(range(len(r)), dtype="int32")):
        r["label"] = labels
        got = pd.concat(step(spark, monkeypatch, "greedy_f1")(q, r)).groupby(["side", "label", "id"])["best"].max().to_dict()
        a, b = B.matrix(q["q"]), B.matrix(r["embedding"])
        want: dict = {}
        for i, own in enumerate(q["query_id"]):
            for j, (row, label) in enumerate(zip(r["vec_id"], labels, strict=True)):
                if own != row and not pd.isna(label):
                    like = round(a[i] @ b[j] / np.sqrt((a[i] @ a[i]) * (b[j] @ b[j])), 5)
                    for key in (("p", int(label), own), ("r", int(label), row)):
                        want[key] = max(like, want.get(key, -2))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-5) for k in want)
