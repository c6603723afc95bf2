import math
import random
import re
from collections import Counter

import pytest

from sigmill.llm import ranked_search as rs


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, top=20):
    of = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(of), sum(n for *_, n in of)
    df = Counter(w for _, c, _ in of for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in of:
            m = 75 + (25 * n * n_docs) // n_words
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, k in Counter(terms(text)).items() if w in c)
            scored.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:top], 1)]
    return Counter(out)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, doc_id int, score int")


def cases(n=400, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "日本", "ÉA"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "_", ", ", "\x00"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(1, 80))) for i in range(n)]
    docs += [(n + k, docs[k % 3][1]) for k in range(90)] + [(1000, None), (1001, ""), (1002, "..."), (1003, "w1 " * 90_000), (None, docs[2][1]), (None, None), (5, "w0 w1"), (5, "w0 w1")]
    items = [(k, text(rng.randrange(1, 30))) for k in range(25)] + [(90, None), (91, ""), (92, "nothing of this"), (93, "W7 w7 w7"), (94, docs[0][1]), (95, "w1 w1"), (95, "w1 w1"), (None, "w3")]
    return docs, items


@pytest.mark.parametrize(("first", "factor"), [(1, 2), (4, 4), (60, 3), (10_000, 16)])
def test_against_brute_force(spark, documents, first, factor):
    docs, items = cases()
    got = rs.searched(documents(docs).repartition(4), asked(spark, items), first=first, factor=factor).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == brute(docs, items)


def test_queries_fall_through_until_they_are_proven(spark, documents):
    docs, items = cases(1500, 8)
    got = rs.searched(documents(docs), asked(spark, items), top=3, first=16, factor=4).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == brute(docs, items, 3)
    assert len({r.tier for r in got}) >= 3 and all(len({r.tier for r in got if r.item_id == i}) == 1 for i in range(25))


def test_blocks_of_queries(spark, documents):
    docs, items = cases(120, 4)
    got = rs.searched(documents(docs), asked(spark, items), first=8, factor=4, block_bytes=600).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == brute(docs, items)


def test_shuffled_candidates(spark, documents, monkeypatch):
    monkeypatch.setattr(rs, "MOST_BROADCAST", 0)
    monkeypatch.setattr(rs, "CELLS", 50)
    docs, items = cases(300, 6)
    got = rs.searched(documents(docs), asked(spark, items), first=16, factor=4).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == brute(docs, items)


def test_small_tables(spark, documents):
    assert rs.searched(documents([]), asked(spark, [(1, "a")])).count() == 0
    assert rs.searched(documents([(1, None), (2, "")]), asked(spark, [(1, "a")])).count() == 0
    assert rs.searched(documents([(1, "a")]), asked(spark, [])).count() == 0
    assert [tuple(r) for r in rs.searched(documents([(1, "a b"), (2, "c")]), asked(spark, [(7, "A")])).select("item_id", "rank", "doc_id", "score").collect()] == list(brute([(1, "a b"), (2, "c")], [(7, "A")]))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = b" ".join(b"word%d" % (k % 7) for k in range(500)) + b"tail"
    whole = rs.counted(text)
    monkeypatch.setattr(rs, "CHUNK", 10)
    assert rs.counted(text) == whole == (500, whole[1]) and rs.counted(None) == rs.counted(b"") == (0, Counter())
