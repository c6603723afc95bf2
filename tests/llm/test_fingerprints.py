import hashlib

from pyspark.sql import functions as F

from sigmill.llm import fingerprints as fp


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        e = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return out


def test_rows_against_brute_force(documents):
    rows = [(i, f"line {i} of text\n" * (i % 5) + "é日🎉" * (i % 7)) for i in range(60)] + [(70, None), (71, ""), (72, "same words here, and there")]
    rows += [(75, "same words here, and there"), (90, "x" * 50000), (None, "no id")]
    for buckets in (1, 3, 40):
        got = fp.edited_fingerprints(documents(rows), buckets).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(brute(rows), key=str)
        by = {r.doc_id: r for r in got}
        assert by[72].fingerprint == by[75].fingerprint != by[90].fingerprint and by[70].fingerprint == by[71].fingerprint
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert by[72].near_next == 1.0


def test_small_tables(documents):
    assert fp.edited_fingerprints(documents([]), 4).count() == 0
    one = fp.edited_fingerprints(documents([(5, "abcd")]), 4).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert fp.edited_fingerprints(documents([(5, "a b"), (5, "a b"), (5, "c")]), 4).count() == 3


def test_order_independent_and_incremental(documents):
    whole = "first line\nsecond line\nthird"
    df = documents([(1, whole), (2, "third\nfirst line\nsecond line"), (3, "first line\nsecond line"), (4, "third")])
    v = {r.doc_id: r.vector for r in fp.fingerprints(df, ["doc_id"]).collect()}
    assert v[1] == v[2] != v[3]
    s = fp.fingerprints(df, ["doc_id"]).groupBy().agg(*[F.max(F.when(F.col("doc_id") == i, F.col("vector"))).alias(f"v{i}") for i in (1, 3, 4)])
    r = s.select(fp.combine(F.col("v3"), F.col("v4")).alias("plus"), fp.combine(F.col("v1"), F.col("v4"), -1).alias("minus")).first()
    assert r.plus == v[1] and r.minus == v[3]


def test_likeness_follows_the_shared_share(documents):
    import random

    random.seed(3)
    words = lambda n: " ".join("".join(random.choices("abcdefghiklmnort", k=6)) for _ in range(n))
    got = fp.edited_fingerprints(documents([(i, words(600)) for i in range(6)]), 2).collect()
    assert all(0.3 < r.near_edited < 0.7 and r.near_next < 0.25 for r in got)


def test_very_many_paragraphs(spark):
    docs = spark.sql("SELECT id AS doc_id, repeat('x\n', CAST(1000000 + id * 100000 AS INT)) AS text FROM range(2)")
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs, 1).collect()}
    assert got[0].near_next > 0.999 and got[0].fingerprint != got[1].fingerprint
    v = fp.fingerprints(docs, ["doc_id"])
    r = v.agg(*[F.max(F.when(F.col("doc_id") == i, F.col("vector"))).alias(f"v{i}") for i in (0, 1)]).select(fp.combine(fp.F.col("v1"), F.col("v0"), -1).alias("rest")).first()
    assert r.rest[0] == 100_000 and all(0 <= x & (2**32 - 1) <= 100_000 and 0 <= x >> 32 <= 100_000 for x in r.rest[1 + fp.SUM_LANES :])
