"""Exact Jaccard self-join of documents on word n-grams, as connected components.

1. Each text becomes a set of 64-bit shingle hashes; equal sets (same sum of mixed hashes, same size) form a
   node. Counts of shingles by hash cell, over all documents, order the shingles: rare cells first, so that
   what many documents share stands last.
2. Prefix filter: two sets at or above the threshold share one of their first n - ceil(t*n) + 1 shingles.
   Each such shingle is a bucket of nodes; its leader is the node whose buckets hold most (of near copies, the text they come from).
3. Every node is compared with the leader it meets most often: as many pairs as nodes. Nodes with one leader form
   a group of like texts, cut into blocks of about BLOCK nodes; those that link with it are connected already.
4. Token-group matrix: a block stores the union of its members' prefix shingles, with its range of sizes. A
   node is a query to the blocks that hold nodes it isn't connected with yet; the number of its prefix
   shingles in a block's union bounds its overlap with each member from above, and only blocks whose bound
   reaches the threshold are opened: first by bitmaps of BITS bits, whose differing bits bound the sets' difference from below, then
   with whole sets. The bounds are exact, so no link is lost. Of the links in a block, those that join two components are kept.
5. Components over the links, by label propagation with shortcuts.

Null and empty texts (no words) have no shingles, size 0 and link with nothing: their component is their own doc_id. Texts with
fewer words than n are one shingle. Rows with equal doc_id are documents of their own; component_id is the smallest
non-null doc_id of the linked rows; a text that only rows without doc_id hold links with nothing. Other columns are ignored. Two different sets are taken as equal if their 64-bit sums
agree: of 10**9 different sets, some three in a hundred such corpora hold a pair; of 10**10, three pairs are to be expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.shared import give_back, slices, table, written

#: Cells of the shingle counts: a fixed number, whatever the input.
CELLS = 1 << 16
#: Nodes in a block of a group.
BLOCK = 256
#: Ids up to which a set of needed documents is broadcast (8 bytes each); more are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: A node is compared with its leader if they meet in one of so many of its shingles; the others are left to the matrix.
PLAUSIBLE = 50
#: Words whose hashes a task keeps.
KEPT_WORDS = 100_000
#: Bits of a node's bitmap.
BITS = 1024
#: Shingles of the queries that are compared with a block at once.
CHUNK = 500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = h
        return h


_words = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams, one text after the other, and where each text's begin
    (one more number: the end). Words are parted by ASCII space, A-Z are lower-cased."""
    words = [(t or "").encode().lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.append(0, np.cumsum(lengths))
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=starts[-1])
    full = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        full = full * _A + h[k : len(h) - n + 1 + k] if len(full) else full
    full = _mixed(full + np.uint64(n))
    each = []
    for at, length in zip(starts[:-1].tolist(), lengths.tolist()):
        if length >= n:
            part = full[at : at + length - n + 1]
        elif length:
            part = np.zeros(1, dtype=np.uint64)
            for k in range(at, at + length):
                part = part * _A + h[k]
            part = _mixed(part + np.uint64(length))
        else:
            part = full[:0]
        part.sort()
        each.append(part)
    flat = np.concatenate([full[:0], *each])
    ends = np.append(0, np.cumsum([len(x) for x in each], dtype=np.int64))
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[ends[:-1][ends[:-1] < len(flat)]] = True
    return flat[keep], np.append(0, np.cumsum(keep))[ends]


def _nodes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A set's node: the sum of its mixed hashes."""
    return np.diff(np.append(np.uint64(0), np.cumsum(_mixed(flat), dtype=np.uint64))[at]).view(np.int64)


def _cell(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(48)).astype(np.int64)


def _bitmaps(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each set's bitmap: BITS bits as longs."""
    on = np.zeros((len(at) - 1, BITS), dtype=bool)
    on[np.repeat(np.arange(len(at) - 1), np.diff(at)), (flat >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64)] = True
    longs = np.packbits(on, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(longs) + 1, dtype=np.int32) * longs.shape[1]), pa.array(longs.ravel()))


def forget() -> None:
    _words.clear()
    give_back()


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches; the task's word hashes go when it ends."""
    yield from slices(parts)
    forget()


def _sizes(docs: DataFrame, n: int) -> DataFrame:
    """Rows of kind 0: (doc_id, node, size, bits); of kind 1: (cell, count) of each task's shingles."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "node", "size", "bits"]
        cells = np.zeros(CELLS, dtype=np.int64)
        for part in _batches(parts):
            flat, at = shingles(part.column(1).to_pylist(), n)
            cells += np.bincount(_cell(flat), minlength=CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at) - 1, dtype=np.int32)), part.column(0), pa.array(_nodes(flat, at)), pa.array(np.diff(at)), _bitmaps(flat, at)], names)
        some = np.flatnonzero(cells)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(some), pa.int32()), pa.array(some), pa.array([0] * len(some), pa.int64()), pa.array(cells[some]), pa.nulls(len(some), pa.list_(pa.int64()))], names)

    return docs.mapInArrow(batches, "kind int, id long, node long, size long, bits array<long>")


def _prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(token, node, size) of every shingle in a prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)  # of repeated sets, a task emits one
        rank = np.minimum(shared.value, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)
        for part in _batches(parts):
            flat, at = shingles(part.column(1).to_pylist(), n)
            # cell counts first, then the hashes themselves, as one number
            order = rank[_cell(flat)] | flat >> np.uint64(24)
            size, nodes = np.diff(at), _nodes(flat, at)
            new = np.zeros(len(nodes), dtype=bool)
            new[np.unique(nodes, return_index=True)[1]] = True
            new &= ~np.isin(nodes, seen)
            seen = np.append(seen, nodes[new])
            keep = np.where((size > 0) & new, size - (percent * size + 99) // 100 + 1, 0)
            chosen = [b + np.argpartition(order[b:e], k - 1)[:k] for b, e, k in zip(at[:-1].tolist(), at[1:].tolist(), keep.tolist()) if k]
            if chosen:
                columns = flat[np.concatenate(chosen)].view(np.int64), np.repeat(nodes, keep), np.repeat(size, keep)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "node", "size"])

    return docs.select("text").withColumn("doc_id", F.lit(0)).select("doc_id", "text").mapInArrow(batches, "token long, node long, size long")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted`` (doc_id, node), from one document each."""
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, "doc_id").select("node", "text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(parts):
            flat, at = shingles(part.column(1).to_pylist(), n)
            same = _nodes(flat, at) == part.column(0).to_numpy()  # another row may have the same doc_id
            sets = pa.array([flat[b:e].tobytes() for b, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "shingles"]).filter(pa.array(same))

    return rows.mapInArrow(batches, "node long, shingles binary")


def _loaded(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The sets of the wanted nodes, once each."""
    wanted = written(wanted.select("doc_id", "node"))
    sets = written(_sets(docs, wanted, n))
    return sets if sets.count() <= wanted.count() else sets.dropDuplicates(["node"])  # rows that repeat both doc_id and text


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = _common(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The (node, leader) of rows (node, leader, shingles, led) that link."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [[np.frombuffer(x.as_py(), dtype=np.uint64) for x in part.column(k)] for k in (2, 3)]
            keep = pa.array([_link(a, b, percent) for a, b in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["node", "leader"]).filter(keep)

    return pairs.select("node", "leader", "shingles", "led").mapInArrow(batches, "node long, leader long")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _least_shared(query: Column, low: Column, high: Column, percent: int) -> Column:
    """How many prefix shingles a query shares at least with a member it links to, for members of sizes low to high.

    Overlap is at least t/(1+t) of both sizes; beyond the shared prefix shingles it is at most the rest of the
    larger set. Between the ends of the range the bound is larger, so the ends decide."""
    at = lambda m: F.lit(percent / (100 + percent)) * (query + m) - F.lit(percent / 100) * F.greatest(query, m)
    low, high = F.greatest(low.cast("double"), F.lit(percent / 100) * query), F.least(high.cast("double"), query / F.lit(percent / 100))
    return F.greatest(F.lit(1.0), F.least(at(low), at(high)) - 1e-6)


def _alike(bits: Column, other: Column, size: Column, other_size: Column, percent: int) -> Column:
    """Whether bitmaps allow a link: each differing bit is a shingle that only one of the sets has."""
    apart = F.aggregate(F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return apart * (100 + percent) <= (size + other_size) * (100 - percent)


def _passing(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The (grp, block, node) of queries whose bitmap allows a link with a member of the block in another component."""

    def compare(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"grp": [], "block": [], "node": []}).astype({"grp": "int64", "block": "int32", "node": "int64"})
        a, b = [np.array(x["bits"].tolist(), dtype=np.int64).view(np.uint64) for x in (q, m)]
        size, comp = m["size"].to_numpy(), m["comp"].to_numpy()
        keep = np.zeros(len(q), dtype=bool)
        for k, (x, s, c) in enumerate(zip(a, q["size"].to_numpy(), q["comp"].to_numpy())):
            apart = np.bitwise_count(b ^ x).sum(axis=1, dtype=np.int64)
            keep[k] = ((apart * (100 + percent) <= (size + s) * (100 - percent)) & (comp != c)).any()
        return q.loc[keep, ["grp", "block", "node"]]

    keys = ["grp", "block", "chunk"]
    return queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(compare, "grp long, block int, node long")


def _chunked(queries: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a chunk: a block's queries in chunks of about CHUNK shingles, and its members once for each."""
    many = F.ceil(F.sum("size") / CHUNK).cast("int")
    chunks = written(queries.groupBy("grp", "block").agg(F.greatest(many, F.lit(1)).alias("chunks")))
    q = queries.join(chunks, ["grp", "block"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), "chunks").cast("int"))
    m = members.join(chunks, ["grp", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return q.drop("chunks"), m.drop("chunks")


def _opened(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the queries of each block and its members, as far as they join components that no link before joined."""

    def compare(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(q) or not len(m):
            return none
        sets = [np.frombuffer(x, dtype=np.uint64) for x in m["shingles"]]
        sizes, nodes = np.array([len(x) for x in sets]), m["node"].to_numpy()
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        holder = np.repeat(np.arange(len(sets)), sizes)[order]
        union, first = np.unique(flat[order], return_index=True)
        first = np.append(first, len(flat))
        # components as positions; a link renames one to the other
        every, position = np.unique(np.concatenate([m["comp"].to_numpy(), q["comp"].to_numpy()]), return_inverse=True)
        now = np.arange(len(every))
        of_member, of_query = position[: len(m)], position[len(m) :]
        out = []
        for node, comp, x in zip(q["node"], of_query, q["shingles"]):
            other = now[of_member] != now[comp]
            if not other.any():
                continue
            s = np.frombuffer(x, dtype=np.uint64)
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            at = at[union[at] == s]
            if 100 * len(at) < percent * len(s):
                continue
            # the overlap with every member at once
            widths = first[at + 1] - first[at]
            held = holder[np.repeat(first[at] - np.append(0, np.cumsum(widths)[:-1]), widths) + np.arange(widths.sum())]
            common = np.bincount(held, minlength=len(sets))
            for k in np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & other):
                if now[of_member[k]] != now[comp]:
                    out.append((node, nodes[k]))
                    now[now == now[of_member[k]]] = now[comp]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64") if out else none

    keys = ["grp", "block", "chunk"]
    return queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) along (node, leader): some rounds of shortcuts, which may end short of the root; then there are more roots than needed."""
    out = parents.select("node", F.col("leader").alias("root"))
    for _ in range(3):
        up = out.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = written(out.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b): the smallest node of its component.

    Each round takes the smallest label among neighbours and then the label's own label; rounds end when none changes."""
    both = written(edges.where("a <> b").unionAll(edges.where("a <> b").selectExpr("b as a", "a as b")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = written(nearer.join(up, "label").select("node", "old", F.least("label", "up").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; rows link at a Jaccard similarity of ``percent`` / 100 or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = written(_sizes(docs, n))
    cells = sizes.where("kind = 1").groupBy("id").agg(F.sum("size").alias("count")).collect()  # CELLS rows at most
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[[r.id for r in cells]] = [r["count"] for r in cells]
    rows = sizes.where("kind = 0").select(F.col("id").alias("doc_id"), "node", "size")
    known = sizes.where("kind = 0 and id is not null and size > 0").groupBy("node").agg(F.min("id").alias("doc_id"), F.min("size").alias("size"), F.first("bits").alias("bits"))

    # buckets of two nodes or more, with their leaders
    bucketed = _prefixes(docs, n, percent, counts).repartition("token").groupBy("token", "node").agg(F.min("size").alias("size"))
    bucketed = written(bucketed.withColumn("held", F.count(F.lit(1)).over(W.partitionBy("token"))).where("held > 1"))
    weights = written(bucketed.groupBy("node").agg(F.sum("held").alias("weight")))
    lead = F.struct("weight", F.xxhash64("node").alias("h"), "node", "size")
    weighed = bucketed.join(weights, "node").withColumn("lead", F.max(lead).over(W.partitionBy("token")))
    bucketed = bucketed.select("token", "node", "size")

    # each node against the leader of most of its buckets
    met = weighed.select("node", "size", F.col("lead.node").alias("leader"), F.col("lead.size").alias("leader_size"))
    met = met.where((F.col("node") != F.col("leader")) & _fits(F.col("size"), F.col("leader_size"), percent))
    best = met.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("times"), F.min("size").alias("size")).where(F.col("times") * PLAUSIBLE >= F.col("size"))
    best = written(best.groupBy("node").agg(F.max(F.struct("times", "leader")).alias("m")).select("node", "m.leader"))
    one = written(known.join(weights.select("node"), "node", "left_semi"))
    led = one.select(F.col("node").alias("leader"), F.col("bits").alias("led_bits"), F.col("size").alias("led_size"))
    near = best.join(one.drop("doc_id"), "node").join(led, "leader")
    stars = written(near.where(_alike(F.col("bits"), F.col("led_bits"), F.col("size"), F.col("led_size"), percent)).select("node", "leader"))
    compared = written(stars.select("node").unionAll(stars.select("leader")).distinct())
    places = one.select("doc_id", "node")
    sets = _loaded(docs, compared.join(places, "node"), n)
    led = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("led"))
    leaders = stars.select("leader").distinct()
    links = written(_verified(sets.join(stars, "node").join(led.join(leaders, "leader", "left_semi"), "leader"), percent))

    # groups of like nodes along the stars, and what is known to be connected along the links
    groups, linked = _roots(best).withColumnRenamed("root", "grp"), _roots(links).withColumnRenamed("root", "comp")
    nodes = bucketed.select("node").distinct().join(groups, "node", "left").join(linked, "node", "left")
    nodes = nodes.select("node", F.coalesce("grp", "node").alias("grp"), F.coalesce("comp", "node").alias("comp"))
    shape = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("held"))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("held") / BLOCK)).cast("int")
    nodes = written(nodes.join(shape, "grp").withColumn("block", block))
    members = bucketed.select("token", "node", "size").join(nodes, "node")
    mixed = members.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    open_rows = written(members.join(mixed, "token").select("token", "node", "size", "grp", "held", "block", "comp"))

    # the token-group matrix against the queries; of two blocks, the nodes of the smaller group ask
    matrix = open_rows.groupBy("token", "grp", "block", "held").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    ranges = open_rows.groupBy("grp", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    q = open_rows.select("token", "node", "size", "comp", F.col("grp").alias("own"), F.col("held").alias("own_held"), F.col("block").alias("own_block"))
    asks = F.struct("own_held", "own", "own_block") <= F.struct("held", "grp", "block")
    other = ~((F.col("c0") == F.col("comp")) & (F.col("c1") == F.col("comp")))
    near = (100 * F.col("high") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("low"))
    found = q.join(matrix, "token").where(asks & other & near).groupBy("node", "size", "comp", "grp", "block").agg(F.count(F.lit(1)).alias("shared"))
    chosen = found.join(ranges, ["grp", "block"]).where(F.col("shared") >= _least_shared(F.col("size"), F.col("low"), F.col("high"), percent)).select("node", "size", "comp", "grp", "block")
    chosen = written(chosen)
    inside = open_rows.select("node", "size", "comp", "grp", "block").distinct().join(chosen.select("grp", "block").distinct(), ["grp", "block"], "left_semi")
    inside = written(inside)
    bits = one.select("node", "bits")
    named = lambda df, last: df.select("grp", "block", "chunk", "node", "size", "comp", last).toDF("grp", "block", "chunk", "node", "size", "comp", last)
    chunked = _chunked(chosen, inside)
    chosen = chosen.join(_passing(*[named(x.join(bits, "node"), "bits") for x in chunked], percent).distinct(), ["grp", "block", "node"], "left_semi")
    chosen = written(chosen)
    inside = written(inside.join(chosen.select("grp", "block").distinct(), ["grp", "block"], "left_semi"))
    missing = inside.select("node").unionAll(chosen.select("node")).distinct().join(compared, "node", "left_anti")
    sets = sets.unionAll(_loaded(docs, missing.join(places, "node"), n))
    # which links span a block depends on the order of its rows: written once, so that both directions of a link are the same links'
    more = written(_opened(*[named(x.join(sets, "node"), "shingles") for x in _chunked(chosen, inside)], percent))

    edges = links.selectExpr("node as a", "leader as b").unionAll(more)
    labels = components(edges)
    at = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = written(at.where("size > 0").groupBy("label").agg(F.min("doc_id").alias("least")))
    return at.join(least, "label", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=4, percent=85)


QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLE: dict[str, str] = {}
