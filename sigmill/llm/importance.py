"""Importance resampling towards a target distribution, over hashed n-gram features.

Words and their neighbours are exploded, each n-gram falls in one of BUCKETS buckets by its crc32, and grouped counts of raw and target
features give a gain a bucket. The gains, BUCKETS rows whatever the input, are broadcast; each document's gains are summed and
averaged, a Gumbel number from its doc_id is added, and the best share is drawn. For the ranks, rows are sorted in ranges and each
range's rows are numbered after those of the ranges before it, so no task holds more than its range.

Only DataFrame functions are used. What is sorted is written first, as sorting in ranges reads its input twice. Null texts have no words, and so do empty
ones; documents without features have weight 0. A null doc_id hashes as an empty one and comes last among equal scores. Repeated rows are documents
of their own, each with a rank; rows with the same doc_id and score rank by their features. An empty table gives an empty result; with an empty target
all gains come from the raw counts alone. Other columns are ignored. Texts are read whole; one text's words are in memory at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.shared import table, written

BUCKETS = 10_000
#: Documents with fewer words aren't drawn.
LEAST_WORDS = 20
#: Per cent of the others that are.
SHARE = 25
SEED = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _bucket(feature: Column) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(BUCKETS)).cast("int")


def features(words_of: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket) for each feature of a frame with ``words``: every word, and every word with the one after it; a null bucket where there is none."""
    pairs = words_of.select(*keys, F.explode_outer(F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))").alias("b"))).alias("x"))
    pairs = pairs.select(*keys, _bucket(F.col("x.a")).alias("one"), F.when(F.col("x.b").isNotNull(), _bucket(F.concat("x.a", F.lit(" "), "x.b"))).alias("two"))
    return pairs.select(*keys, F.explode(F.when(F.col("two").isNull(), F.array("one")).otherwise(F.array("one", "two"))).alias("bucket"))


def counts(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how many features of all texts fall in a bucket."""
    return features(texts.select(words(F.col("text")).alias("words"))).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket."""
    raw, wanted = written(counts(docs, "s")), written(counts(target, "t"))
    n_raw, n_wanted = (x.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")).first().n for x, c in ((raw, "s"), (wanted, "t")))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(raw), "bucket", "left").join(F.broadcast(wanted), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1.0) * F.lit(float(n_raw + BUCKETS)) / ((s + 1.0) * F.lit(float(n_wanted + BUCKETS)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def scores(docs: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    # the number only holds one row's features together on their way from one task: it needn't be the same in another attempt
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("words"))
    each = features(rows.withColumn("n_words", F.size("words").cast("long")), "row", "doc_id", "n_words")
    total = each.join(F.broadcast(gain), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    n = F.when(F.col("n_words") > 0, 2 * F.col("n_words") - 1).otherwise(0).cast("long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    total = total.withColumn("n_features", n).withColumn("noise", F.floor(-1000.0 * F.ln(-F.ln(share))).cast("long"))
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    return total.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_features", weight.alias("weight"), (weight + F.col("noise")).alias("score"))


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null unless the row is drawn."""
    scored = written(scored).withColumn("may", F.col("n_words") >= least_words)
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    # the number holds the range, counted from 0 in the order of the ranges, and the row's place in it
    placed = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before, ahead, may = 0, [], 0
    for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("may"), 1)).alias("may")).orderBy("range").collect():  # a row a range
        ahead.append((r.range, before))
        before, may = before + r.n, may + r.may
    offsets = placed.sparkSession.createDataFrame(ahead, "range long, ahead long")
    rank = F.col("place") + F.col("ahead") + 1
    chosen = F.col("may") & (rank <= F.lit(may * share // 100))
    return placed.join(F.broadcast(offsets), "range").select("doc_id", "n_features", "weight", "score", F.when(chosen, rank).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its weight towards the texts of ``target``, its score, and its rank if it is drawn."""
    return drawn(scores(docs, gains(docs, target)))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
QUERIES = {"op13_importance_resampling": op13_importance_resampling}
#: DuckDB has no crc32: it is worked out bit by bit from the feature's bytes, once for each distinct feature.
ORACLE = {
    "op13_importance_resampling": f"""
WITH steps AS (SELECT list(step ORDER BY i) AS of FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS step FROM range(256) t(i))),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
asked AS (SELECT row_number() OVER () AS row, {_WORDS} AS words FROM benchmark),
raw AS (SELECT row, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM docs),
wanted AS (SELECT row, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM asked),
bytes AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM raw UNION SELECT feature FROM wanted)),
hashed AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
  lambda c, x: xor(c >> 8, of[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, steps),
s AS (SELECT bucket, count(*) AS n FROM raw JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (feature) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) + {BUCKETS} AS raw, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) + {BUCKETS} AS wanted),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * totals.raw / ((coalesce(s.n, 0) + 1)::DOUBLE * totals.wanted)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weights AS (SELECT row, sum(gain)::BIGINT AS total FROM raw JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT doc_id, len(words) AS n_words, greatest(2 * len(words) - 1, 0)::BIGINT AS n_features, coalesce((total - ((total % (2 * len(words) - 1)) + 2 * len(words) - 1) % (2 * len(words) - 1)) // (2 * len(words) - 1), 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM docs LEFT JOIN weights USING (row)),
ranked AS (SELECT *, n_words >= {LEAST_WORDS} AS may, row_number() OVER (ORDER BY n_words >= {LEAST_WORDS} DESC, weight + noise DESC, doc_id NULLS LAST, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN may AND place <= {SHARE} * (SELECT count(*) FROM ranked WHERE may) // 100 THEN place END AS rank FROM ranked"""
}
