"""Sentiment rules against a plain version, classifiers on rows they haven't seen, agreement by hand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sigmill import plans
from sigmill.operators import classify as C
from sigmill.operators import sentiment as S

DATA = "/root/testdata/sf0.001"
LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "awful": -2.0, "fine": 0.8}


def plain(text):
    words = [w for w in (re.sub(r"^\W+|\W+$", "", x) for x in text.split()) if len(w) > 1]
    if not words:
        return 0.0
    low = [w.lower().replace("'", "") for w in words]
    caps = [w.isupper() for w in words]
    mixed = any(caps) and not all(caps)
    total = 0.0
    for i, w in enumerate(low):
        v = LEXICON.get(w, 0.0)
        if not v or w in S.BOOSTERS + S.DAMPENERS:
            continue
        sign = math.copysign(1, v)
        v += sign * S.CAPS if mixed and caps[i] else 0
        turned = False
        for back, damp in zip((1, 2, 3), S.DAMPED):
            if i < back:
                break
            word = low[i - back]
            step = S.BOOST if word in S.BOOSTERS else -S.BOOST if word in S.DAMPENERS else 0
            if step and mixed and caps[i - back]:
                step += math.copysign(S.CAPS, step)
            v += sign * step * damp
            turned |= word in S.NEGATIONS
        v *= S.NEGATED if turned else 1
        if "but" in low:
            at = low.index("but")
            v *= 0.5 if i < at else 1.5 if i > at else 1
        total += v
    asked = text.count("?")
    extra = min(text.count("!"), 4) * 0.292 + (0.96 if asked > 3 else asked * 0.18 if asked > 1 else 0)
    total += extra if total > 0 else -extra if total < 0 else 0
    return round(max(-1.0, min(1.0, total / math.sqrt(total * total + 15))), 4)


def test_polarity_against_a_plain_version(spark):
    random.seed(5)
    pool = [*LEXICON, "VERY", "very", "slightly", "not", "don't", "but", "movie", "BAD", "GOOD", "the", "a", "great!", "(awful)", "fine?"]
    texts = [" ".join(random.choices(pool, k=random.randrange(9))) + random.choice(["", "!!", "???", "????"]) for _ in range(400)] + ["", None, "  "]
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert sorted(S.polarity(frame, "k", "t", lexicon, most=2).collect()) == sorted(S.polarity(frame, "k", "t", lexicon).collect())
    got = {r.k: r for r in S.polarity(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", lexicon).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert abs(got[k].compound - plain(t or "")) < 2e-4, t
        assert abs(got[k].neg + got[k].neu + got[k].pos - 1) < 2e-3
    assert (got[len(texts) - 1].neu, got[len(texts) - 1].label) == (1.0, "Neutral")


@pytest.mark.parametrize("name", ["naive_bayes", "linear_svm", "logistic_regression", "random_forest", "boosting"])
def test_classifiers_learn_what_words_tell(spark, name):
    random.seed(1)
    own = {"a": ["alpha", "alpine", "alto"], "b": ["beta", "bravo", "bass"], "c": ["gamma", "giga", "gong"]}
    labels = list(own) if name not in ("boosting", "linear_svm") else ["a", "b"]
    rows = [(i, " ".join(random.choices(own[y], k=3) + random.choices(["the", "of", "and", "to"], k=6)), y) for i in range(300) for y in [labels[i % len(labels)]]]
    got = C.agreement(C.predicted(spark.createDataFrame(rows + [(900, None, "a"), (901, "x", None)], "id long, text string, y string"), "id", "y", name)).first()
    assert got.n > 30 and got.accuracy > 0.95 and got.kappa > 0.9


def counted(spark, many):
    random.seed(6)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(many):
        text = random.choices(words, [1 / (k + 1) for k in range(60)], k=random.randrange(5, 60))
        rows.append((i, " ".join(text), float((text.count("w0") > 6) ^ ("w5" in text) ^ (random.random() < 0.1))))
    return C.bag_of_words(columns=256).transform(spark.createDataFrame(rows, "id long, text string, _label double")).select("id", "_label", "features").persist()


def test_boosted_trees_are_those_of_sparks_library(spark):
    from pyspark.ml.classification import GBTClassifier

    from sigmill.operators import boosting

    rows = counted(spark, 600)
    want = GBTClassifier(labelCol="_label", maxIter=10, maxBins=16, seed=C.SEED).fit(rows)
    model = boosting.fit(rows, "features", F.when(F.col("_label") == 1, 1.0).otherwise(-1.0), list(range(256)))
    sure = {r.id: r.rawPrediction[1] for r in want.transform(rows).collect()}
    found = {r.id: r.sure for r in boosting.margins(rows, "features", ["id"], model, "sure").collect()}
    assert len(found) == 600 and sum(abs(found[i] - sure[i]) < 1e-6 for i in sure) > 570
    assert sum((found[i] > 0) != (sure[i] > 0) for i in sure) <= 3


def test_boosting_holds_the_words_of_a_text_only(spark):
    from sigmill.operators import boosting

    rows = counted(spark, 200)
    binned, bins = boosting._binned(rows, "features", F.when(F.col("_label") == 1, 1.0).otherwise(-1.0), list(range(256)))
    held = binned.select(F.sum(F.size("slots"))).first()[0]
    assert 0 < held <= sum(r.features.numNonzeros() for r in rows.collect()) and len(bins.columns) <= 60


def test_boosting_tells_more_labels_than_two(spark):
    random.seed(2)
    own = {"a": ["alpha", "alpine"], "b": ["beta", "bravo"], "c": ["gamma", "giga"]}
    rows = [(i, " ".join(random.choices(own[y], k=3) + random.choices(["the", "of"], k=6)), y) for i in range(150) for y in ["abc"[i % 3]]]
    got = C.agreement(C.predicted(spark.createDataFrame(rows, "id long, text string, y string"), "id", "y", "boosting")).first()
    assert got.n > 10 and got.accuracy > 0.95


def test_one_label_and_agreement(spark):
    rows = spark.createDataFrame([(i, "some words", "only") for i in range(60)], "id long, text string, y string")
    assert C.agreement(C.predicted(rows, "id", "y", "naive_bayes")).first().asDict() | {"n": 0} == {"n": 0, "accuracy": 1.0, "kappa": 0.0}
    made = spark.createDataFrame([("x", "x")] * 4 + [("x", "y")] + [("y", "y")] * 3 + [("y", "x")] * 2, "label string, guess string")
    assert tuple(C.agreement(made).first()) == (10, 0.7, 0.4)


@pytest.mark.parametrize("name", ["linear_svm", "logistic_regression", "random_forest", "boosting"])
def test_texts_are_read_once(spark, name):
    read = spark.sparkContext.accumulator(0)

    def text(i):
        read.add(1)
        return ("alpha beta " if i % 2 else "gamma delta ") + f"w{i % 5}x"

    rows = spark.range(200).select("id", F.udf(text, "string").asNondeterministic()("id").alias("text"), (F.col("id") % 2).alias("y"))
    assert C.agreement(C.predicted(rows, "id", "y", name)).first().accuracy == 1
    assert read.value == 200


def test_registered_queries(spark):
    queries = plans.queries()
    sizes = {r.training: r.documents for r in queries["split_sizes"](spark, DATA).collect()}
    assert 0.65 < sizes[True] / sum(sizes.values()) < 0.92
    assert queries["language_naive_bayes"](spark, DATA).first().accuracy > 0.8
    turns = queries["sentiment_scores"](spark, DATA).collect()
    assert turns and all(-1 <= r.compound <= 1 for r in turns)
