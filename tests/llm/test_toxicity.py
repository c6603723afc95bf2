import random
import zlib

import numpy as np

from sigmill.llm import toxicity as tx

random.seed(4)
WORDS = ["".join(random.choices("abcdefgh", k=5)) for _ in range(200)]
BAD = ["idiotic", "moronish", "scumbag", "loserly"]


def rows(n):
    out = []
    for i in range(n):
        toxic = i % 6 == 0
        words = random.choices(WORDS, k=40) + (random.choices(BAD, k=3) if toxic else [])
        random.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_label_model_finds_classes():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    votes = (rng.random((2000, 6)) < np.where(y[:, None] == 1, 0.6, 0.05)).astype(float)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])
    post = tx.label_model(votes, y)
    assert ((post > 0.5) == (y == 1)).mean() > 0.95


def test_held_out_rows_are_found(spark, documents):
    data = rows(900)
    docs = documents([(i, t) for i, t, _ in data] + [(5000, None), (5001, ""), (5002, "abc " * 30000), (None, BAD[0])])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels)
    got = {r.doc_id: r.toxic_score for r in tx.scored(docs, model).collect()}
    assert len(got) == 904
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert got[5000] == got[5001] < 0.3 and 0 <= got[5002] <= 1 and got[None] > 0.3


def test_words_of_copied_texts_are_no_lexicon(spark, documents):
    data = rows(900)
    own = ["".join(random.choices("stuvwxyz", k=8)) for _ in range(60)]
    ids = [i for i in range(2000, 2200) if zlib.crc32(str(i).encode()) % 4 != 2]
    copies = [(i, " ".join([*own[: i % 50], f"edit{i}", *own[i % 50 :], BAD[0]]), 1) for i in ids]
    clean = [(4000 + k, " ".join(random.choices(WORDS, k=30) + own[5 * k : 5 * k + 5])) for k in range(12)]
    docs = documents([(i, t) for i, t, _ in data + copies] + clean)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data + copies], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels)
    assert not model.terms.keys() & set(own) and model.terms.keys() >= set(BAD)
    got = {r.doc_id: r.toxic_score for r in tx.scored(docs, model).collect()}
    assert max(got[i] for i, _ in clean) < 0.3 and all(got[i] >= 0.3 for i in ids)


def test_only_near_copies_with_one_label_are_left_out(spark, documents):
    rng = random.Random(7)
    shared = "one common passage that many rows of either label hold"
    own = [" ".join([*rng.choices(WORDS, k=40), shared, *rng.choices(WORDS, k=40)]) for _ in range(30)]
    base = rng.choices(WORDS, k=80)
    near = [" ".join([*base[:40], f"edit{k}", *base[40:]]) for k in range(3)]
    data = [(i, t, i % 2) for i, t in enumerate(own)] + [(100, near[0], 0), (101, near[1], 0), (102, near[2], 1), (103, "", 0), (104, None, 0), (105, "two words", 0)]
    data = [(i, t, y, "" if t is None else t) for i, t, y in data]
    training = spark.createDataFrame([(i, t, y) for i, _, y, t in data], "doc_id long, text string, toxic int")
    kept = {r.doc_id for r in tx._originals(tx._terms(training)).collect()}
    assert kept == {*range(30), 100, 102, 103, 105}


def test_patterns_are_fitted_where_no_term_is_mined(spark, documents):
    # marks stand where no letters are, so that no word is common to the toxic rows
    data = [(i, f"a{i} b{i}" + (" @#$%!!" if i < 5 else ""), int(i < 5)) for i in range(40)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    docs = documents([(ids[i], t) for i, t, _ in data])
    labels = spark.createDataFrame([(ids[i], 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels)
    assert model is not None and not model.terms
    got = {r.doc_id: r.toxic_score for r in tx.scored(docs, model).collect()}
    assert min(got[ids[i]] for i in range(5)) > max(got[ids[i]] for i in range(5, 40))


def test_small_tables(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.fit(documents([(1, "a")]), empty) is None
    assert tx.scored(documents([(1, "a"), (1, "a")]), None).count() == 2
    assert tx.scored(documents([]), None).count() == 0
