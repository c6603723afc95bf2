"""Approximate nearest neighbours by cosine over balanced posting lists.

1. Equal vectors form a class, of which the k + 1 smallest ids are kept: no query can return more of them.
2. Centroids are fitted by k-means on a sample of at most FIT_ROWS vectors; a centroid with too many of the sample is
   split until lists are balanced. Every vector is indexed: it goes to its nearest list and, near a boundary, to
   each further list whose distance is within REPLICATE of the nearest.
3. Centroids are searched through an in-memory graph (each linked to its nearest others) by a beam; a query opens
   the lists within OPEN times its nearest list's distance, and at least so many that they hold k others.
4. Lists longer than BLOCK are dealt to blocks, and each block is scored against the queries that open its
   list (in chunks of about CHUNK), in double precision on the original vectors. Of equal scores, the smaller ids stay.

Vectors that are null, zero, hold null or non-finite components, or whose length isn't the table's most common
one, take no part, neither do rows without vec_id. Rows that repeat id and vector count once. Ties go to the smaller vec_id. A
query without other vectors gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.shared import table, written

#: Vectors from which the centroids are fitted, at most.
FIT_ROWS = 20000
#: Vectors in a list that the number of lists aims at, and lists at most (their centroids are broadcast).
LIST_ROWS = 200
MOST_LISTS = 4096
#: Vectors of a list in one scoring block, and queries that a block meets at once.
BLOCK = 1000
CHUNK = 2000
LINKS = 24
#: Lists that a search of the graph keeps: for a vector that is indexed, and for a query.
BEAM = 48
QUERY_BEAM = 128
REPLICATE = 1.06
OPEN = 1.35


@dataclass
class Index:
    """Unit centroids and, for each, its LINKS nearest others; entries are where a search begins."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        c[some] = _unit(sums[some])
    return c, near


def fitted(sample: np.ndarray, lists: int, seed: int = 3) -> Index:
    """Balanced centroids of unit vectors, and the graph over them."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    c, near = _means(x, min(lists, len(x)), rng)
    cap = max(8, 2 * len(x) // max(1, len(c)))
    out, todo = [], [np.flatnonzero(near == k) for k in range(len(c))]
    while todo:
        own = todo.pop()
        if not len(own):
            continue
        if len(own) > cap:
            _, side = _means(x[own], 2, rng, 4)
            if 0 < side.sum() < len(own):
                todo += [own[side == 0], own[side == 1]]
                continue
        mean = x[own].mean(axis=0, keepdims=True)
        out.append(_unit(mean)[0] if np.linalg.norm(mean) > 1e-12 else x[own[0]])
    c = np.array(out)
    like = c @ c.T
    np.fill_diagonal(like, -2)
    links = np.argsort(-like, axis=1)[:, : min(LINKS, len(c) - 1)] if len(c) > 1 else np.zeros((1, 0), dtype=np.int64)
    return Index(c, links, rng.permutation(len(c))[:QUERY_BEAM])


def near_lists(index: Index, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector, the lists that a beam search of the graph finds, nearest first, with their distances."""
    c, links = index.centroids, index.links
    beam = min(beam, len(c))
    rows = np.arange(len(x))[:, None]
    ids = np.tile(index.entries[:beam], (len(x), 1))
    seen = np.zeros((len(x), len(c)), dtype=bool)
    seen[rows, ids] = True
    dist = 1 - x @ c[index.entries[:beam]].T
    open_ = np.ones(ids.shape, dtype=bool)
    while links.shape[1] and open_.any():
        # every row opens the three nearest centroids of its beam that it hasn't opened yet
        at = np.argsort(np.where(open_, dist, 9), axis=1)[:, :3]
        live = open_[rows, at]
        open_[rows, at] = False
        new = np.where(live[:, :, None], links[ids[rows, at]], -1).reshape(len(x), -1)
        fresh = (new >= 0) & ~seen[rows, new]
        seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
        r, k = np.nonzero(fresh)
        far = np.full(new.shape, 9.0)
        far[r, k] = 1 - np.einsum("ij,ij->i", x[r], c[new[r, k]])
        # the same list may be new through two links: only the first counts
        order = np.sort(np.where(fresh, new, -1), axis=1)
        if (order[:, 1:] == order[:, :-1]).any():
            first = np.argsort(new, axis=1, kind="stable")
            same = np.take_along_axis(new, first, 1)
            again = np.zeros(new.shape, dtype=bool)
            np.put_along_axis(again, first[:, 1:], same[:, 1:] == same[:, :-1], 1)
            far[again] = 9.0
        every, every_id = np.concatenate([dist, far], axis=1), np.concatenate([ids, np.maximum(new, 0)], axis=1)
        every_open = np.concatenate([open_, far < 9], axis=1)
        keep = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        dist, ids, open_ = every[rows, keep], every_id[rows, keep], every_open[rows, keep]
    order = np.argsort(dist, axis=1)
    return ids[rows, order], np.sqrt(np.maximum(0, 2 * dist[rows, order]))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _listed(classes: DataFrame, index: Index, ratio: float, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """(class, list, own) of every class: its nearest list (own), and those within ``ratio`` of that distance; with ``sizes`` of lists, also so many
    of the nearest that they hold ``least`` vectors."""
    shared = classes.sparkSession.sparkContext.broadcast((index, sizes))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sizes = shared.value
        for whole in parts:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                ids, dist = near_lists(index, _unit(_vectors(part.column(1))), BEAM if sizes is None else QUERY_BEAM)
                open_ = dist <= ratio * dist[:, :1] + 1e-9
                if sizes is not None:
                    open_ |= np.cumsum(sizes[ids], axis=1) - sizes[ids] < least
                r, k = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(ids[r, k].astype(np.int32)), pa.array(k == 0)], ["class", "list", "own"])

    return classes.select("class", "embedding").mapInArrow(batches, "class string, list int, own boolean")


def search(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row whose vec_id is divisible by ``every``."""
    dims = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    width = dims[0].d if dims else 0
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where((F.size("embedding") == width) & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("class", F.concat(F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64("embedding", F.lit(1)))))
    few = rows.select("class", "vec_id", "embedding").withColumn("n", F.dense_rank().over(W.partitionBy("class").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("class").agg(F.first("embedding").alias("embedding"), F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids")))
    count = classes.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = classes.select("embedding").sample(fraction=min(1.0, FIT_ROWS / count), seed=1).limit(FIT_ROWS) if count > FIT_ROWS else classes.select("embedding")
    sample = np.array([r.embedding for r in picked.collect()])
    index = fitted(sample, max(1, min(MOST_LISTS, count // LIST_ROWS)))

    wanted = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("class", "vec_id").distinct()
    queries = classes.join(wanted.select("class").distinct(), "class", "left_semi")
    postings = written(_listed(classes, index, REPLICATE))
    blocks = written(postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count_if("own").alias("held")))
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in blocks.collect():  # a number for each list
        sizes[r.list] = r.held
    blocks = blocks.drop("held")
    held = postings.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).join(classes, "class").select("list", "block", "class", "embedding", "ids")
    opened = written(_listed(queries, index, OPEN, sizes, k + 2))
    chunks = written(opened.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    held = held.join(chunks, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    asked = (
        opened.join(blocks, "list").join(chunks, "list").withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(2)), "chunks").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(classes, "class").select("list", "block", "chunk", F.col("class").alias("query"), F.col("embedding").alias("q_embedding"))
        .toDF("list", "block", "chunk", "query", "embedding")
    )

    def scored(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype=str), "class": pd.Series(dtype=str), "ids": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        if not len(q) or not len(v):
            return empty
        a, b = np.array(q["embedding"].tolist()), np.array(v["embedding"].tolist())
        na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        first = np.array([x[0] for x in v["ids"]], dtype=np.int64)
        take = min(len(v), k + 1)  # the query's own class and k others
        out = []
        for at in range(0, len(a), 256):
            like = (a[at : at + 256] / na[at : at + 256, None]) @ (b / nb[:, None]).T
            least = np.partition(like, len(v) - take, axis=1)[:, len(v) - take]
            r, c = np.nonzero(like >= least[:, None] - 1e-9)  # all that may be among the best, ties included
            # one formula for every pair, so that equal pairs give equal scores in whichever block
            score = (a[at + r] * b[c]).sum(axis=1) / (na[at + r] * nb[c])
            order = np.lexsort((first[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < take
            r, c, score = r[keep], c[keep], score[keep]
            out.append(pd.DataFrame({"query": q["query"].to_numpy()[at + r], "class": v["class"].to_numpy()[c], "ids": v["ids"].to_numpy()[c], "score": score}))
        return pd.concat(out)

    keys = ["list", "block", "chunk"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(scored, "query string, class string, ids array<long>, score double")
    once = found.groupBy("query", "class").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    ranked = once.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("n") <= k + 1)
    by_id = ranked.select("query", "score", F.explode("ids").alias("vec_id"))
    short = by_id.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).select("query", "score", "vec_id")
    each = wanted.select(F.col("class").alias("query"), F.col("vec_id").alias("query_id")).join(short, "query").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=50, k=5)


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE: dict[str, str] = {}
