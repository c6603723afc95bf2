"""A stated set of queries against all rows, in blocks: each block of rows meets each block of queries once, and returns only what it keeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a block, at most about; smaller blocks only where all cores need work, of these sizes at least.
ROWS, QUERIES = 20_000, 2_000
LEAST_ROWS, LEAST_QUERIES = 1_000, 50
#: Scores that a task holds at once.
CELLS = 1_000_000


def grid(rows: int, queries: int, most_rows: int, most_queries: int, cores: int) -> tuple[int, int]:
    """How many blocks rows and queries make: enough for ``cores``, and among such grids about the one that sends least. A row is sent once for each block of queries, and a query for each of rows."""
    many, asked = max(1, -(-rows // most_rows)), max(1, -(-queries // most_queries))
    best = round(math.sqrt(cores * rows / max(1, queries)))
    many = max(many, min(best, -(-cores // asked), -(-rows // LEAST_ROWS)))
    asked = max(asked, min(-(-cores // many), -(-queries // LEAST_QUERIES)))
    if cores < many * asked < 4 * cores:
        # cores would wait for a last few pairs: somewhat more blocks of rows may take less time, if they send hardly more
        sent, most = (lambda g: rows * g[1] + queries * g[0]), 1.1 * (rows * asked + queries * many)
        grids = [(m, a) for m in range(many, min(2 * many, max(many, -(-rows // LEAST_ROWS))) + 1) for a in range(-(-queries // most_queries) or 1, asked + 1)]
        many, asked = min([(many, asked), *[g for g in grids if g[0] * g[1] >= cores and sent(g) <= most]], key=lambda g: (-(-g[0] * g[1] // cores) / (g[0] * g[1]), sent(g)))
    return many, asked


def against(
    rows: DataFrame, queries: DataFrame, row_key: str, query_key: str, score: Callable[[pd.DataFrame, object], pd.DataFrame | Iterator[pd.DataFrame]], schema: str, most_rows: int = 0, most_queries: int = 0, prepare: Callable[[pd.DataFrame], object] | None = None
) -> DataFrame:
    """The union of ``score(some queries, block)`` over all pairs of blocks, a block being ``prepare(its rows)``, or the rows. A task holds one block of rows, past which the
    queries of a block stream in Arrow batches. ``score`` must not depend on which queries come together; where it finds much, it gives frame after frame."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    many, asked = grid(rows.count(), queries.count(), most_rows or ROWS, most_queries or QUERIES, cores)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.select(deal(row_key, many).alias("_rows"), F.struct(*rows.columns).alias("_row")).withColumn("_queries", every(asked))
    q = queries.select(deal(query_key, asked).alias("_queries"), F.struct(*queries.columns).alias("_query")).withColumn("_rows", every(many))
    pair = (F.col("_rows") * asked + F.col("_queries")).alias("_pair")
    # a partition for each pair of blocks, or a few pairs after each other; a pair's rows stand before its queries
    tasks = min(many * asked, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = r.select(pair, F.lit(0).alias("_side"), "_row", none(q, "_query").alias("_query")).unionAll(q.select(pair, F.lit(1).alias("_side"), none(r, "_row").alias("_row"), "_query"))

    def frame(batches: list[pa.RecordBatch], column: int) -> pd.DataFrame:
        cells = [b.column(column) for b in batches]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(c.flatten(), names=[f.name for f in c.type]) for c in cells]).to_pandas()

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, block = None, [], None
        for part in parts:
            pairs, sides = part.column(0).to_numpy(), part.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(pairs) != 0) | (np.diff(sides) != 0)) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pairs)], strict=True):
                if at == end:
                    continue
                if pairs[at] != pair:
                    pair, held, block = pairs[at], [], None
                if sides[at] == 0:
                    held.append(part.slice(at, end - at))
                    continue
                if held:
                    block, held = frame(held, 2), []
                    block = block if prepare is None else prepare(block)
                if block is not None:  # else a block without rows
                    found = score(frame([part.slice(at, end - at)], 3), block)
                    for some in [found] if isinstance(found, pd.DataFrame) else found:
                        if len(some):
                            yield pa.RecordBatch.from_pandas(some, schema=kinds, preserve_index=False)

    kinds = _arrow(spark, schema)
    return both.repartitionById(tasks, "_pair").sortWithinPartitions("_pair", "_side").mapInArrow(scored, schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slices(queries: int, rows: int) -> Iterator[slice]:
    """Slices of a batch of queries, each with ``CELLS`` scores against the rows, or one query."""
    step = max(1, CELLS // max(1, rows))
    return (slice(at, at + step) for at in range(0, queries, step))


def matrix(vectors: pd.Series) -> np.ndarray:
    """A column of vectors in double precision."""
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, rounded to five digits; 0 where a norm is 0."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    norms = np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
    return np.round(np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0), 5)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores, ties to the smaller id; a row's own id is left out."""
    out_r, out_c = [], []
    for r, line in enumerate(scores):
        other = np.flatnonzero(ids != own[r])
        if len(other) > k:
            least = np.partition(line[other], len(other) - k)[len(other) - k]
            other = other[line[other] >= least]
        order = other[np.lexsort((ids[other], -line[other]))][:k]
        out_r += [r] * len(order)
        out_c += order.tolist()
    return np.array(out_r, dtype=np.int64), np.array(out_c, dtype=np.int64)
