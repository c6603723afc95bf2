"""Nearest texts by their counted words, and the label that most of them have.

The distance of two texts is the Euclidean one of their word counts. A block of rows is an index, past which queries stream. Its rows lie in tiles by their length: two texts
are no nearer than their lengths differ, so a query begins at the tile of its own length and leaves out those that are further than its k-th so far. In a tile, the counts of
the weightiest words are a matrix, those of the others lists of the rows that hold a word. The matrix, with the lengths of what it leaves out, bounds all distances of the tile from
below (Cauchy and Schwarz); only queries with a bound that isn't beyond their k-th go through their words' lists, which give exact distances. Words are hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import blocks as B

#: Words of two letters or digits or more, as the usual vectoriser takes them.
WORD = r"[\p{L}\p{N}_]{2,}"
ROWS, QUERIES = 60_000, 120_000
#: Columns of a tile's matrix: its weightiest words.
HEAVY = 512
#: Rows of a tile, and the queries that it meets at once; texts that are read at once; entries of lists that are added up at once.
FIRST, AT_ONCE, SLICE, ENTRIES = 4_096, 128, 2_000, 100_000
#: Whole numbers below this are exact in single precision.
EXACT = 1 << 24


def hashed(text: Column) -> Column:
    """The words' hashes in order, so that equal ones lie together."""
    return F.sort_array(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))


def counted(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, one text after the other, how often each is there, and where each text begins, with the end."""
    starts = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *[np.sort(t) for t in texts]]).astype(np.int64)
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    new[starts[:-1][starts[:-1] < len(flat)]] = True
    at = np.flatnonzero(new)
    return flat[at], np.diff(np.append(at, len(flat))), np.searchsorted(at, starts)


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs from ``begins`` on, one run after the other."""
    until = np.cumsum(sizes)
    return np.repeat(begins - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)


class Tile:
    """Rows of like length (``rows``, their places in the block): matrix of the weightiest words' counts, lists of rows for the others."""

    def __init__(self, rows: np.ndarray, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, norms: np.ndarray) -> None:
        self.rows, self.norms, self.size = rows, norms, len(rows)
        self.least, self.most = np.sqrt(norms.min()), np.sqrt(norms.max())
        order = np.argsort(words, kind="stable")
        words, counts, at = words[order], counts[order], np.repeat(np.arange(self.size, dtype=np.int32), sizes)[order]
        begins = np.flatnonzero(np.append(True, words[1:] != words[:-1])[: len(words)])
        self.names, self.begins = words[begins], np.append(begins, len(words))
        weights = np.add.reduceat(counts.astype(np.float64) ** 2, begins) if len(begins) else np.zeros(0)
        heavy = np.argsort(-weights, kind="stable")[:HEAVY]
        self.columns = np.full(len(self.names), -1, dtype=np.int32)
        self.columns[heavy] = np.arange(len(heavy))
        column = np.repeat(self.columns, np.diff(self.begins))
        held = column >= 0
        self.matrix = np.zeros((self.size, len(heavy)), dtype=np.float32)
        self.matrix[at[held], column[held]] = counts[held]
        inside = np.bincount(at[held], weights=counts[held].astype(np.float64) ** 2, minlength=self.size)
        self.heaviest, self.rest = np.sqrt(inside.max()), np.sqrt(norms - inside)
        # lists of the other words only: a weighty word's list is empty
        self.at, self.counts = at[~held], counts[~held].astype(np.float32)
        self.sizes = np.where(self.columns < 0, np.diff(self.begins), 0)
        self.begins = np.cumsum(self.sizes) - self.sizes
        # single precision: rests are taken for somewhat longer and lengths for shorter than they are
        self.longer, self.shorter = (self.rest * 1.00001).astype(np.float32), (norms * (1 - 1e-5)).astype(np.float32)


class Queries:
    """Some queries' distinct words (``names``, to which ``places`` point) and counts, query after query, and their lengths."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.many, self.of = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.names, self.places = np.unique(words, return_inverse=True)
        self.counts = counts.astype(np.float64)
        self.norms = np.bincount(self.of, weights=self.counts**2, minlength=self.many)
        self.lengths = np.sqrt(self.norms)
        #: The k-th squared distance so far, and what is known within it: (rows, distances) of each query.
        self.far = np.full(self.many, np.inf)
        self.known: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.many)]

    def meet(self, tile: Tile, k: int) -> None:
        """Rows of a tile that may be among the k nearest."""
        gap = np.maximum(0, np.maximum(tile.least - self.lengths, self.lengths - tile.most))
        active = gap * gap * (1 - 1e-9) <= self.far
        if not active.any():
            return
        place = np.minimum(np.searchsorted(tile.names, self.names), len(tile.names) - 1) if len(tile.names) else np.zeros(len(self.names), dtype=np.int64)
        there = tile.names[place] == self.names if len(tile.names) else np.zeros(len(self.names), dtype=bool)
        mine = np.flatnonzero(active[self.of] & there[self.places])
        of, counts, place = self.of[mine], self.counts[mine], place[self.places[mine]]
        asked = np.flatnonzero(active)
        line = np.cumsum(active) - 1
        column = tile.columns[place]
        heavy = column >= 0
        matrix = np.zeros((len(asked), tile.matrix.shape[1]))
        matrix[line[of[heavy]], column[heavy]] = counts[heavy]
        inside = (matrix * matrix).sum(axis=1)
        exact = np.sqrt(inside.max()) * tile.heaviest < EXACT
        products = matrix.astype(np.float32) @ tile.matrix.T if exact else matrix @ tile.matrix.T.astype(np.float64)
        rest = np.sqrt(np.maximum(self.norms[asked] - inside, 0))
        bounds = np.multiply.outer((rest * 1.00001).astype(np.float32), tile.longer)
        bounds += products
        bounds *= -2
        bounds += tile.shorter
        own = self.norms[asked]
        near = np.flatnonzero(bounds.min(axis=1) <= (self.far[asked] - own) + 1e-5 * own)
        if not len(near):
            return
        chosen = np.zeros(self.many, dtype=bool)
        chosen[asked[near]] = True
        light = np.flatnonzero(~heavy & chosen[of])
        of, counts, place = of[light], counts[light], place[light]
        ends = np.searchsorted(of, asked[near], side="right")
        until = np.append(0, np.cumsum(tile.sizes[place]))[np.append(0, ends)]
        begun = 0
        while begun < len(near):
            # as many queries as their lists allow, one at least
            end = max(begun + 1, int(np.searchsorted(until, until[begun] + ENTRIES, side="right")) - 1)
            part = slice(ends[begun - 1] if begun else 0, ends[end - 1])
            sizes = tile.sizes[place[part]]
            runs = _runs(tile.begins[place[part]], sizes)
            cells = np.repeat((np.searchsorted(near, line[of[part]]) - begun) * tile.size, sizes)
            cells += tile.at[runs]
            added = np.bincount(cells, weights=tile.counts[runs] * np.repeat(counts[part], sizes), minlength=(end - begun) * tile.size).astype(np.float64, copy=False).reshape(end - begun, tile.size)
            added += products[near[begun:end]]
            added *= -2
            added += tile.norms
            for i, distance in zip(asked[near[begun:end]].tolist(), added, strict=True):
                self._take(i, tile, distance + self.norms[i], k)
            begun = end

    def _take(self, i: int, tile: Tile, distance: np.ndarray, k: int) -> None:
        far = self.far[i]
        if np.isinf(far) and len(distance) > k:
            far = np.partition(distance, k - 1)[k - 1]
        found = np.flatnonzero(distance <= far)
        if len(found):
            self.known[i].append((tile.rows[found], distance[found]))
            every = np.concatenate([d for _, d in self.known[i]])
            if len(every) >= k:
                self.far[i] = np.partition(every, k - 1)[k - 1]
            if len(self.known[i]) > 1 and len(every) > k:
                rows = np.concatenate([r for r, _ in self.known[i]])
                kept = every <= self.far[i]
                self.known[i] = [(rows[kept], every[kept])]


class Index:
    """Rows' distinct words, dealt to tiles by the rows' lengths; row k of the block has the words from begins[k] to begins[k + 1]."""

    def __init__(self, texts: pd.Series) -> None:
        self.size = len(texts)
        parts = [counted(texts.iloc[at : at + SLICE].tolist()) for at in range(0, self.size, SLICE)]
        words = np.concatenate([np.zeros(0, dtype=np.int64), *[w for w, _, _ in parts]])
        counts = np.concatenate([np.zeros(0, dtype=np.int32), *[c.astype(np.int32) for _, c, _ in parts]])
        sizes = np.concatenate([np.zeros(0, dtype=np.int64), *[np.diff(b) for _, _, b in parts]])
        del parts
        self.begins = np.append(0, np.cumsum(sizes))
        norms = np.bincount(np.repeat(np.arange(self.size), sizes), weights=counts.astype(np.float64) ** 2, minlength=self.size)
        order = np.argsort(norms, kind="stable")
        self.tiles = []
        for at in range(0, self.size, FIRST):
            rows = order[at : at + FIRST]
            runs = _runs(self.begins[rows], sizes[rows])
            self.tiles.append(Tile(rows, words[runs], counts[runs], sizes[rows], norms[rows]))

    def all_nearest(self, texts: pd.Series, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text, the k rows of smallest squared distance, ties by id, and the distances."""
        for begun in range(0, len(texts), SLICE):
            words, counts, begins = counted(texts.iloc[begun : begun + SLICE].tolist())
            many = len(begins) - 1
            sizes = np.diff(begins)
            order = np.argsort(np.bincount(np.repeat(np.arange(many), sizes), weights=counts.astype(np.float64) ** 2, minlength=many), kind="stable")
            found: list = [None] * many
            for at in range(0, many, AT_ONCE):
                some = order[at : at + AT_ONCE]
                runs = _runs(begins[some], sizes[some])
                queries = Queries(words[runs], counts[runs], sizes[some])
                middle = np.median(queries.lengths)
                for tile in sorted(self.tiles, key=lambda t: max(t.least - middle, middle - t.most)):
                    queries.meet(tile, k)
                for i, known in zip(some.tolist(), queries.known, strict=True):
                    rows, distance = (np.concatenate([np.zeros(0, dtype=kind), *[x[j] for x in known]]) for j, kind in ((0, np.int64), (1, np.float64)))
                    best = np.lexsort((ids[rows], distance))[:k]
                    found[i] = rows[best], distance[best]
            yield from found

    def nearest(self, text: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows nearest to one text."""
        return next(self.all_nearest(pd.Series([text]), ids, k))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, id, label, distance, rank): the k rows (id, label, text) nearest to each query (query, text), ties to the smaller id; distance is squared. Rows and queries
    with a null id or text are left out; texts without words are as far as the other's words are many."""

    def prepared(r: pd.DataFrame) -> tuple[Index, np.ndarray, np.ndarray]:
        return Index(r["words"]), r["id"].to_numpy(), r["label"].to_numpy()

    def score(q: pd.DataFrame, block: tuple[Index, np.ndarray, np.ndarray]) -> pd.DataFrame:
        index, ids, labels = block
        found = list(index.all_nearest(q["words"], ids, k))
        at, distance = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return pd.DataFrame({"query": np.repeat(q["query"].to_numpy(), [len(x) for x, _ in found]), "id": ids[at], "label": labels[at], "distance": distance.round().astype(np.int64)})

    listed = rows.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), hashed(F.col("text")).alias("words"))
    asked = queries.where("query is not null and text is not null").select(F.col("query").cast("long").alias("query"), hashed(F.col("text")).alias("words"))
    found = B.against(listed, asked, "id", "query", score, "query long, id long, label string, distance long", ROWS, QUERIES, prepared)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)


def voted(found: DataFrame) -> DataFrame:
    """(query, guess): the label that most of a query's nearest have, ties to the smallest."""
    votes = found.where("label is not null").groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("guess"))
