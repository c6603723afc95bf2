import hashlib
import math
import random
import re
import zlib
from collections import Counter

from sigmill.llm import importance as im


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def buckets(t):
    w = words(t)
    return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def brute(docs, target):
    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(big_s + 10_000) / (float(s[b] + 1) * float(big_t + 10_000))))
    rows = []
    for i, x in docs:
        of = buckets(x)
        weight = sum(map(gain, of)) // len(of) if of else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(words(x)) >= 20, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(of), weight))
    n = 25 * sum(r[0] for r in rows) // 100
    rows.sort(key=lambda r: (not r[0], -r[1], r[2] is None, r[2] or 0, r[3], r[4]))
    return Counter((i, k, w, score, at + 1 if at < n else None) for at, (_, score, i, k, w) in enumerate(rows))


def check(spark, documents, docs, target):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = im.resampled(documents(docs).repartition(3), asked).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, target)


def test_against_brute_force(spark, documents):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé日", k=3)) for _ in range(120)]
    text = lambda n: "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", "-", "\n", "1 ", "\x00", "_"]) for w in rng.choices(vocabulary, k=n))
    docs = [(i, text(rng.randrange(60))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "a " * 60_000), (303, "🎉 É É " * 30), (304, "x" * 200_000), (None, text(40)), (None, None)]
    docs += [docs[4], docs[4], (7, text(50)), (7, text(50)), (400, "123 456")]
    check(spark, documents, docs, [text(30) for _ in range(12)] + [None, ""])


def test_small_tables(spark, documents):
    check(spark, documents, [(i, "one word " * 12 + str(i)) for i in range(9)], [])
    check(spark, documents, [(1, None)], ["some words"])
    assert im.resampled(documents([]), documents([(1, "some words")])).count() == 0


def test_ranks_follow_each_other_over_ranges(spark):
    scored = spark.range(4000).selectExpr("id AS doc_id", "20L AS n_words", "39L AS n_features", "0L AS weight", "id % 5 AS score")
    got = sorted((r.rank, r.doc_id) for r in im.drawn(scored).where("rank is not null").collect())
    want = [i for s in (4, 3, 2, 1, 0) for i in range(4000) if i % 5 == s][:1000]
    assert got == list(enumerate(want, 1))


def test_only_dataframe_functions_run(spark, documents):
    docs = documents([(i, "some words here") for i in range(5)])
    plan = im.resampled(docs, docs)._jdf.queryExecution().toString() + im.scores(docs, im.gains(docs, docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
