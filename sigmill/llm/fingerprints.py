"""Document fingerprints: a homomorphic multiset hash, built from SQL functions only.

A paragraph is a line; a long line is cut further at places chosen by its content (after a space that
follows one of CUTS), so that every document has many terms. Each paragraph hashes to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo a power of two:

* SUM_LANES lanes modulo 2**32 hold sums of 32-bit hashes: they tell different multisets apart;
* lanes modulo 2**32, two in a long, count the set bits of paragraph hashes by position (a text has fewer paragraphs): twice
  the count less the number of paragraphs is a random +1/-1 projection of the multiset, so the cosine of two
  documents' lanes estimates the likeness of their paragraphs.

Order doesn't matter, equal multisets have equal fingerprints, and ``combine`` adds (inserts) or subtracts
(deletes) paragraphs without the rest of the document.

Null text counts as empty, which is one empty paragraph. Every row gets a result, rows with equal doc_id
included; rows in order of (doc_id, hash of text), nulls first, have their "next document", and the last row's is
the first. A single row is its own next document. Other columns are ignored.

Plan: documents are dealt once, by buckets of doc_id; the lead over a bucket, the paragraphs' sums and the
comparison all use that one exchange. The first row of each bucket also goes to the bucket before it, so
that no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.shared import partitions, table

#: A long line is cut where a space follows one of these characters.
CUTS = "aegknrt.,;:!?|。，"
SPLIT = f"\\n|(?<=[{CUTS}]) +|(?<=[。！？，])"
SEEDS = (11, 23, 37)
LONGS = 32
SUM_LANES = 4
SPREAD = 1 | 1 << 32
WORD = (1 << 32) - 1
#: Rows of a bucket, about.
BUCKET_ROWS = 50_000


def _paragraphs(text: Column) -> Column:
    return F.split(text, SPLIT)


def _sums(unit: Column) -> list[Column]:
    """The aggregates that make a fingerprint: count, hash sums, packed bit counts."""
    hashes = [F.xxhash64(unit, F.lit(seed)) for seed in SEEDS]
    out = [F.count(F.lit(1)).alias("n")]
    for i in range(SUM_LANES):
        h = hashes[i // 2]
        out.append(F.sum(h.bitwiseAND(F.lit(WORD)) if i % 2 == 0 else F.shiftrightunsigned(h, 32)).alias(f"s{i}"))
    for i, h in enumerate(hashes):
        out += [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(SPREAD))).alias(f"b{i}_{k}") for k in range(LONGS)]
    return out


def _vector() -> Column:
    """One array: the number of paragraphs, the sums modulo 2**32, the packed counts."""
    lanes = [F.col("n")] + [F.col(f"s{i}").bitwiseAND(F.lit(WORD)) for i in range(SUM_LANES)]
    return F.array(*lanes, *[F.col(f"b{i}_{k}") for i in range(len(SEEDS)) for k in range(LONGS)])


def _shown(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lower(F.hex(x))), ".")


def _signed(vector: Column) -> Column:
    """The +1/-1 projections, as doubles."""
    packed = F.slice(vector, 2 + SUM_LANES, len(SEEDS) * LONGS)
    n = F.element_at(vector, 1)
    lanes = F.flatten(F.transform(packed, lambda x: F.array(x.bitwiseAND(F.lit(WORD)), F.shiftrightunsigned(x, 32))))
    return F.transform(lanes, lambda c: (c * 2 - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _likeness(a: Column, b: Column, same: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    cosine = F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint vector of the union (sign 1) of two multisets, or of the difference (-1)."""
    low, high = lambda x: x.bitwiseAND(F.lit(WORD)), lambda x: F.shiftrightunsigned(x, 32)
    one = lambda x, y: low(x + y if sign == 1 else x - y)
    # each lane of its own, so that none carries into the other
    return F.zip_with(a, b, lambda x, y: one(low(x), low(y)).bitwiseOR(F.shiftleft(one(high(x), high(y)), 32)))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, vector) for every distinct value of ``keys``: the sum over all its rows' paragraphs."""
    units = docs.select(*keys, F.explode(_paragraphs(F.coalesce(F.col(text), F.lit("")))).alias("unit"))
    return units.groupBy(*keys).agg(*_sums(F.col("unit"))).select(*keys, _vector().alias("vector"))


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """(b, ghost, doc_id, text): every row in the bucket of its doc_id, and each bucket's first row again behind the one before."""
    bounds = docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    cuts = F.array(*[F.lit(int(x)) for x in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))
    with_bucket = docs.withColumn("b", bucket.cast("int"))
    # at most one row a bucket: the number of buckets bounds what the driver holds and the rows that go twice
    heads = with_bucket.groupBy("b").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h"))).alias("m")).orderBy("b").collect()
    rows = [(heads[i].m.d, heads[i].m.h, heads[i - 1].b) for i in range(len(heads))]
    if not rows:
        return with_bucket.select("b", F.lit(0).alias("ghost"), "doc_id", "text")
    wanted = docs.sparkSession.createDataFrame(rows, "d long, h long, before int")
    ghosts = (
        docs.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(wanted), ["d", "h"])
        .select(F.col("before").alias("b"), F.lit(1).alias("ghost"), "doc_id", "text")
    )
    return with_bucket.select("b", F.lit(0).alias("ghost"), "doc_id", "text").unionAll(ghosts)


def edited_fingerprints(docs: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and how alike they and the next row's are."""
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("b").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        _bucketed(plain, buckets)
        .withColumn("h", F.xxhash64("text"))
        .withColumn("rn", F.row_number().over(order))
        .withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - floor(n_chars / 2))"), F.substring("next", F.lit(1), half)))
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    keys = ["b", "rn", "ghost", "doc_id", "n_chars", "edited_sha256"]
    sides = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x"))
    both = fingerprints(sides.select(*keys, "x.side", F.col("x.t").alias("t")), [*keys, "side"], "t")
    after = W.partitionBy("b").orderBy("rn", "side")
    own, changed, following = F.col("vector"), F.col("changed"), F.col("following")
    compared = (
        both.withColumn("changed", F.lead("vector", 1).over(after))
        .withColumn("following", F.coalesce(F.lead("vector", 2).over(after), own))
        .where("side = 0 and ghost = 0")
        .select("doc_id", "n_chars", "edited_sha256", "vector", "changed", "following", *[_signed(c).alias(k) for k, c in (("v", own), ("e", changed), ("f", following))])
    )
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", _shown(own).alias("fingerprint"), _shown(changed).alias("edited_fingerprint"),
        _likeness(F.col("v"), F.col("e"), own == changed).alias("near_edited"), _likeness(F.col("v"), F.col("f"), own == following).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edited_fingerprints(docs, max(2 * partitions(spark), docs.count() // BUCKET_ROWS))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE: dict[str, str] = {}
