import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigmill.llm import exact_dedup as ed


def brute(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in of.items()}
    return Counter((i, best[t or ""], len(of[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def found(docs, counters):
    got = ed.decisions(docs, counters).withColumn("digest", F.lower(F.hex("digest"))).collect()
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got)


def cases():
    rng = random.Random(5)
    rows = [(i, f"text {rng.choice([1, 1, 1, 1, 2, 2, 2, 3, 3, *range(4, 90)])}") for i in range(600)]
    rows += [(700, None), (701, ""), (702, " "), (703, "É"), (704, "é"), (705, "É"), (706, "x" * 300_000), (707, "x" * 300_000), (3, "text 1"), (3, "text 1")]
    return rows + [(None, "text 1"), (None, "only without id"), (None, "only without id")]


@pytest.mark.parametrize("counters", [1, 3, 40, 1024])
def test_against_brute_force(documents, counters):
    rows = cases()
    assert found(documents(rows).repartition(5), counters) == brute(rows)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_rows_that_stay(spark, counters):
    rows = cases()
    docs = spark.createDataFrame([(i, t, 1, "a", 2, 3) for i, t in rows], "doc_id long, text string, Digest int, keep_id string, gone int, _gone int")
    got = ed.deduplicated(docs, counters)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter((i, t or "") for i, t in rows if i == {r[4]: r[1] for r in brute(rows)}[hashlib.sha256((t or "").encode()).hexdigest()])


def test_empty_and_single(documents):
    assert found(documents([]), 4) == Counter() and ed.deduplicated(documents([]), 4).count() == 0
    assert found(documents([(1, None)]), 4) == brute([(1, None)])


def test_frequent_digests_are_never_missed(spark):
    rng = random.Random(9)
    for counters in (1, 2, 5, 9):
        values = [rng.choices(range(60), weights=[1 / (k + 1) ** 1.3 for k in range(60)])[0] for _ in range(3000)]
        digests = spark.createDataFrame([(str(v).encode(),) for v in values], "digest binary").repartition(6)
        got = {int(r.digest): r.estimate for r in ed.frequent(digests, counters).collect()}
        true = Counter(values)
        assert len(got) <= counters and all(n <= true[v] for v, n in got.items())
        assert {v for v, n in true.items() if n * (counters + 1) > 2 * len(values)} <= got.keys()


def test_summary_takes_no_more_than_its_share():
    rng = random.Random(2)
    for counters in (1, 4, 30):
        kept, true = {}, Counter()
        for _ in range(50):
            part = Counter(rng.choices([b"a", b"b", *(str(k).encode() for k in range(200))], weights=[60, 20] + [1] * 200, k=100))
            true += part
            kept = ed.summary({k: kept.get(k, 0) + part.get(k, 0) for k in kept.keys() | part.keys()}, counters)
        assert len(kept) <= counters and all(true[k] - 5000 / (counters + 1) <= kept.get(k, 0) <= true[k] for k in true)
