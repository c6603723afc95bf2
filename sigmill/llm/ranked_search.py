"""Ranked lexical search over a tiered index.

Index: one pass over the texts writes, for every document, its terms and their counts among the terms that the queries hold. A posting's impact is
what its count and the document's length are worth, before the term's weight. A histogram of each term's impacts gives the cut of
each tier: tier 0 holds about FIRST postings a term, those of highest impact, each further tier FACTOR times as many, the last everything. A term's residual
bound is the highest impact that a tier lacks. Tiers are stored by document, so a task scores its documents by itself, and only
the best of each task are shuffled.

Search: in a tier, the sum of the postings found bounds a document's score from below; residual bounds of the other terms bound it from above. A query is proven when
a document that isn't in the tier at all stays below the lower bound of its best TOP; then the documents whose upper bound reaches that
get their exact scores from the whole lists, and the best are exact. Queries without this proof fall through to the next tier,
and from the last one to the whole lists, where there is nothing left to prove.

All scores are 64-bit integers. Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Null and empty texts have no terms: such documents are
found by nothing and don't count, such queries find nothing. Repeated rows are documents, or queries, of their own; equal scores go by doc_id, a null one last.
Documents with the same counts have the same score, so only the first TOP of each kind are followed. Empty tables give an empty result; other columns are ignored.
Queries are handled in blocks of BLOCK_BYTES of text, so that their terms fit in every task; an index serves one block.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.shared import give_back, slices, table, written

TOP = 20
#: Postings a term in tier 0, and how much larger each further tier is.
FIRST, FACTOR = 1024, 16
#: Bytes of query texts in a block.
BLOCK_BYTES = 32 << 20
#: Documents up to which those with an open upper bound are broadcast; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Cells (documents x queries) that a task scores at once; bytes of a text that are split at once.
CELLS, CHUNK = 1 << 20, 4 << 20
#: Pairs of a posting and a query that are added up at once, about.
PAIRS = 1 << 18
#: Impacts are below a million; steps of the histogram.
STEP, STEPS = 10_000, 100

_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
HITS = "item int, score long, doc_id long, row long"


def counted(text: bytes | None) -> tuple[int, Counter]:
    """The number of terms of a UTF-8 text, and how often each occurs."""
    text, found, at = (text or b"").translate(_TABLE), Counter(), 0
    n = 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        words = text[at : end if end >= 0 else len(text)].split()
        n += len(words)
        found.update(words)
        at = end if end >= 0 else len(text)
    return n, found


def _forward(vocabulary: dict[bytes, int]) -> Callable:
    """Documents with at least one term: their numbers of terms, and the counts of the vocabulary's terms by ascending term."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, text=2):
            rows, ns, keys, terms, times = [], [], [], [], []
            for i, text in enumerate(part.column(2).cast(pa.large_binary())):
                n, found = counted(text.as_py())
                if n:
                    own = sorted((vocabulary[w], k) for w, k in found.items() if w in vocabulary)
                    t, k = [x for x, _ in own], [x for _, x in own]
                    rows.append(i)
                    ns.append(n)
                    keys.append(hashlib.md5(repr((n, own)).encode(), usedforsecurity=False).digest())
                    terms.append(t)
                    times.append(k)
            taken = part.take(pa.array(rows, pa.int64()))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(terms, lists), pa.array(times, lists)], names=["row", "doc_id", "n", "key", "terms", "times"])

    return run


def impact(times: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The worth of ``times`` occurrences in a document of ``n`` terms, among ``docs`` documents of ``words`` terms."""
    return (1_000_000_000 * times) // (1000 * times + 12 * (75 + (25 * n * docs) // words))


def _postings(part: pa.RecordBatch, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the document in the batch, term, value) of each posting of a batch."""
    lists = part.column("terms")
    of = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return of, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), part.column(values).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Index:
    """Documents by their own counts (forward), the tiers, and what is known of each term: its weight, and by tier its residual bound."""

    forward: DataFrame
    tiers: DataFrame
    docs: int
    words: int
    weights: np.ndarray
    rest: np.ndarray


def _scored_postings(part: pa.RecordBatch, docs: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a batch with their impacts, which a tier holds and the whole lists don't."""
    if "impacts" in part.schema.names:
        return _postings(part, "impacts")
    of, terms, times = _postings(part, "times")
    return of, terms, impact(times, part.column("n").to_numpy()[of], docs, words)


def _tiers(cuts: np.ndarray, docs: int, words: int) -> Callable:
    """The postings of each tier, by document: those whose impact is at or above the term's cut."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, text=3, rows=1000):
            of, terms, worth = _scored_postings(part, docs, words)
            for tier, cut in enumerate(cuts):
                held = worth // STEP >= cut[terms]
                here, sizes = np.unique(of[held], return_counts=True)
                ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                taken = part.take(pa.array(here))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[held].astype(np.int32))) for x in (terms, worth)]
                yield pa.RecordBatch.from_arrays([taken.column("row"), taken.column("doc_id"), taken.column("key"), *lists, pa.array(np.full(len(here), tier, dtype=np.int32))], names=["row", "doc_id", "key", "terms", "impacts", "tier"])

    return run


def build(docs: DataFrame, vocabulary: dict[bytes, int], first: int = FIRST, factor: int = FACTOR) -> Index | None:
    """The index of ``docs`` (doc_id, text) for the terms of ``vocabulary``, which are numbered from 0; None if no document has a term."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    forward = written(rows.mapInArrow(_forward(vocabulary), "row long, doc_id long, n long, key binary, terms array<int>, times array<int>"))
    total = forward.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    if not total.docs:
        return None
    sizes = [first * factor**j for j in range(64) if first * factor**j < total.docs]
    each = forward.select("n", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("n", "x.terms", F.col("x.times").cast("long").alias("tf"))
    each = each.withColumn("impact", F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * (75 + (25 * n * {total.docs}L) div {total.words}L))"))
    steps = each.groupBy("terms", F.expr(f"cast(impact div {STEP} as int)").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"))
    above = steps.withColumn("upto", F.sum("n").over(W.partitionBy("terms").orderBy(F.col("step").desc())))  # STEPS rows a term at most
    cut = [F.coalesce(F.min(F.when(F.col("upto") <= size, F.col("step"))), F.lit(STEPS)).alias(f"cut{j}") for j, size in enumerate(sizes)]
    rest = [F.coalesce(F.max(F.when(F.col("upto") > size, F.col("top"))), F.lit(0)).alias(f"rest{j}") for j, size in enumerate(sizes)]
    known = above.groupBy("terms").agg(F.sum("n").alias("df"), *cut, *rest).toArrow()  # a row for each term of the queries
    of = known.column("terms").to_numpy()
    full = lambda name, other: _spread(known.column(name).to_numpy(), of, len(vocabulary), other)
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df + 1))) for df in full("df", 0).tolist()], dtype=np.int64)
    cuts = np.array([full(f"cut{j}", STEPS) for j in range(len(sizes))]).reshape(len(sizes), len(vocabulary))
    rests = np.array([full(f"rest{j}", 0) for j in range(len(sizes))]).reshape(len(sizes), len(vocabulary))
    tiers = written(forward.mapInArrow(_tiers(cuts, total.docs, total.words), "row long, doc_id long, key binary, terms array<int>, impacts array<int>, tier int"), "tier")
    return Index(forward, tiers, total.docs, total.words, weights, rests)


def _spread(values: np.ndarray, at: np.ndarray, size: int, other: int) -> np.ndarray:
    out = np.full(size, other, dtype=np.int64)
    out[at] = values
    return out


@dataclass
class Queries:
    """Some queries by term: ``who`` and ``gain`` (weight times occurrences) from starts[term] to starts[term + 1]."""

    names: np.ndarray
    starts: np.ndarray
    who: np.ndarray
    gain: np.ndarray

    @staticmethod
    def of(asked: list[tuple[int, dict[int, int]]], weights: np.ndarray) -> Queries:
        rows = sorted((t, i, k * int(weights[t])) for i, (_, terms) in enumerate(asked) for t, k in terms.items() if weights[t] > 0)
        terms, who, gain = (np.array([r[x] for r in rows], dtype=np.int64) for x in range(3))
        return Queries(np.array([name for name, _ in asked], dtype=np.int64), np.append(0, np.cumsum(np.bincount(terms, minlength=len(weights)))), who, gain)

    def sums(self, of: np.ndarray, terms: np.ndarray, worth: np.ndarray, rows: int) -> np.ndarray:
        """For ``rows`` documents and each query, the sum of gain times worth over the postings that they share."""
        out = np.zeros(rows * len(self.names), dtype=np.int64)
        asked = self.starts[terms + 1] > self.starts[terms]
        of, terms, worth = of[asked], terms[asked], worth[asked]
        every = np.append(0, np.cumsum(self.starts[terms + 1] - self.starts[terms]))
        cuts = np.unique(np.append(np.searchsorted(every, np.arange(0, every[-1], PAIRS)), len(terms)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begun, many = self.starts[terms[a:b]], np.diff(every[a : b + 1])
            at = np.arange(every[b] - every[a]) + np.repeat(begun - every[a:b] + every[a], many)
            np.add.at(out, np.repeat(of[a:b], many) * len(self.names) + self.who[at], self.gain[at] * np.repeat(worth[a:b], many))
        return out.reshape(rows, len(self.names))

    def bound(self, rest: np.ndarray) -> np.ndarray:
        """What a document that a tier doesn't hold can score at most, by query."""
        terms = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        out = np.zeros(len(self.names), dtype=np.int64)
        np.add.at(out, self.who, self.gain * rest[terms])
        return out


def _cut(parts: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
    """Batches of so many documents that the cells of all queries fit."""
    most = min(1000, max(1, CELLS // max(1, len(queries.names))))
    for part in parts:
        for at in range(0, part.num_rows, most):
            yield part.slice(at, most)
    give_back()


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, and which are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _hits(queries: Queries, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries.names[item].astype(np.int32)), pa.array(score), pa.array(doc, mask=null), pa.array(row)], names=["item", "score", "doc_id", "row"])


def _best(queries: Queries, least: np.ndarray, top: int, docs: int, words: int) -> Callable:
    """Each task's best documents of each query that score ``least`` or more, which is at least 1."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)]  # item, score, doc_id, null, row
        floor = least.copy()
        for part in _cut(parts, queries):
            sums = queries.sums(*_scored_postings(part, docs, words), part.num_rows)
            at, item = np.nonzero(sums >= floor)
            doc, null = _ids(part.column("doc_id"))
            new = (item, sums[at, item], doc[at], null[at], part.column("row").to_numpy()[at])
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            order = np.lexsort((kept[4], kept[2], kept[3], -kept[1], kept[0]))
            kept = [x[order] for x in kept]
            begun = np.flatnonzero(np.append(True, kept[0][1:] != kept[0][:-1])) if len(order) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(order)) - np.repeat(begun, np.diff(np.append(begun, len(order))))
            last = place == top - 1
            floor[kept[0][last]] = kept[1][last]
            kept = [x[place < top] for x in kept]
        yield _hits(queries, *kept)

    return run


def _open(queries: Queries, rest: np.ndarray, reached: np.ndarray, docs: int, words: int) -> Callable:
    """(item, row, doc_id, key) of the documents whose upper bound reaches what the best have."""
    bound = queries.bound(rest)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cut(parts, queries):
            of, terms, worth = _scored_postings(part, docs, words)
            sums = queries.sums(of, terms, worth, part.num_rows)
            most = sums + bound - queries.sums(of, terms, rest[terms], part.num_rows)
            at, item = np.nonzero((sums > 0) & (most >= reached))
            taken = part.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(queries.names[item].astype(np.int32)), taken.column("row"), taken.column("doc_id"), taken.column("key")], names=["item", "row", "doc_id", "key"])

    return run


def _exact(queries: Queries, docs: int, words: int) -> Callable:
    """The scores of documents for the queries named beside them."""
    place = np.zeros(int(queries.names.max()) + 1, dtype=np.int64)
    place[queries.names] = np.arange(len(queries.names))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cut(parts, queries):
            sums = queries.sums(*_scored_postings(part, docs, words), part.num_rows)
            wanted = part.column("items")
            at = np.repeat(np.arange(part.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            item = place[wanted.flatten().to_numpy(zero_copy_only=False)]
            doc, null = _ids(part.column("doc_id"))
            yield _hits(queries, item, sums[at, item], doc[at], null[at], part.column("row").to_numpy()[at])

    return run


def _first(hits: DataFrame, top: int) -> DataFrame:
    """The best documents of each query, with their ranks."""
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(index: Index, asked: list[tuple[int, dict[int, int]]], top: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score, tier) of the best documents of each query (number, occurrences by term); tier is the one whose proof held."""
    facts, found = (index.docs, index.words), []
    asked = [(name, terms) for name, terms in asked if any(index.weights[t] > 0 for t in terms)]
    known: dict[int, int] = {}
    for tier in range(len(index.rest) + 1):
        if not asked:
            break
        queries = Queries.of(asked, index.weights)
        whole = tier == len(index.rest)
        held = index.forward if whole else index.tiers.where(F.col("tier") == tier)
        rest = np.zeros(len(index.weights), dtype=np.int64) if whole else index.rest[tier]
        # what a query's best reached in the tier before bounds its results from below
        least = np.array([max(1, known.get(name, 0)) for name, _ in asked], dtype=np.int64)
        best = written(_first(held.mapInArrow(_best(queries, least, top, *facts), HITS), top))
        reached = {r.item: (r.n, r.score) for r in best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).collect()}  # a row a query
        known |= {name: score for name, (n, score) in reached.items() if n == top}
        bounds = dict(zip(queries.names.tolist(), queries.bound(rest).tolist(), strict=True))
        exact = [x for x in asked if not bounds[x[0]]]
        proven = [x for x in asked if bounds[x[0]] and reached.get(x[0], (0, 0))[0] == top and known[x[0]] > bounds[x[0]]]
        if exact:
            names = held.sparkSession.createDataFrame([(name,) for name, _ in exact], "item int")
            found.append(best.join(F.broadcast(names), "item", "left_semi").select("item", "score", "doc_id", "row", F.lit(tier).alias("tier")))
        if proven:
            queries = Queries.of(proven, index.weights)
            least = np.array([known[name] for name, _ in proven], dtype=np.int64)
            alike = W.partitionBy("item", "key").orderBy(F.col("doc_id").asc_nulls_last(), "row")
            candidates = held.mapInArrow(_open(queries, rest, least, *facts), "item int, row long, doc_id long, key binary")
            candidates = candidates.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= top)
            wanted = written(candidates.groupBy("row").agg(F.collect_set("item").alias("items")))
            joined = index.forward.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "row")
            hits = joined.mapInArrow(_exact(queries, *facts), HITS)
            found.append(_first(hits, top).select("item", "score", "doc_id", "row", F.lit(tier).alias("tier")))
        done = {name for name, _ in exact + proven}
        asked = [x for x in asked if x[0] not in done]
    if not found:
        return index.forward.sparkSession.createDataFrame([], "item int, rank int, doc_id long, score long, tier int")
    return _first(reduce(DataFrame.unionAll, found), top).select("item", "rank", "doc_id", "score", "tier")


def searched(docs: DataFrame, items: DataFrame, top: int = TOP, first: int = FIRST, factor: int = FACTOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score, tier) of the ``top`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks, out = max(1, math.ceil(size / block_bytes)), []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # a block's bytes bound what the driver holds
        asked = [(r.item_id, counted(r.text.encode())[1]) for r in part]
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*(x for _, x in asked))))}
        index = build(docs, vocabulary, first, factor) if vocabulary else None
        if index is not None:
            hits = search(index, [(k, {vocabulary[w]: n for w, n in x.items()}) for k, (_, x) in enumerate(asked)], top)
            names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(asked)], "item int, item_id long")
            out.append(hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", "tier"))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE = {
    "op11_ranked_search": f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
totals AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM docs WHERE len(terms) > 0),
counts AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * t.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals t GROUP BY term, t.n),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * counts.n * totals.n) // totals.l))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= {TOP}"""
}
