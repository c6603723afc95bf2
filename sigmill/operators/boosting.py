"""Boosted trees over counted words, as Spark's library learns them (variance, logistic loss, all columns, up to 16 bins a column), for columns that are mostly zero.

Spark's own trees hold a dense row of all columns for each text and read it for each level. Here a text holds one number for each of its words, the slot of the word's column and bin;
zeros are what is left of a node's sums. For each level, tasks add up their texts' slots by node, slices of columns are summed across tasks and give their best split, and only
these and the trees pass the driver. Texts' nodes and predictions follow from the trees. A column's thresholds come from the counts of all texts, not of a sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TREES, DEPTH, BINS, RATE = 10, 5, 16, 0.1
EPSILON = np.finfo(np.float64).eps


def thresholds(values: np.ndarray, counts: np.ndarray, rows: int, most: int) -> np.ndarray:
    """Bounds between a column's bins: half way between its values, or where these are too many, between ``most`` + 1 groups of about as many rows. Zeros are the rows that aren't counted."""
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    if rows > counts.sum():
        values, counts = np.append(0.0, values), np.append(rows - counts.sum(), counts)
    halves = (values[:-1] + values[1:]) / 2
    if len(halves) <= most:
        return halves
    stride, found, seen = rows / (most + 1), [], float(counts[0])
    target = stride
    for k in range(1, len(values)):
        before, seen = seen, seen + float(counts[k])
        if abs(before - target) < abs(seen - target):
            found.append(halves[k - 1])
            target += stride
    return np.array(found)


def _vectors(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of a batch: for each entry its row, column and value."""
    _, _, indices, values = part.column(column).flatten()
    sizes = np.diff(indices.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), indices.flatten().to_numpy(), values.flatten().to_numpy()


class Bins:
    """The slots of columns: bin b > 0 of column c is slot begins[c] + b - 1; bin 0, which zeros are in, has none."""

    def __init__(self, columns: np.ndarray, bounds: list[np.ndarray]) -> None:
        self.columns = columns
        self.begins = np.append(0, np.cumsum([len(b) for b in bounds])).astype(np.int64)
        self.slots = int(self.begins[-1])
        self.bounds = np.concatenate([np.zeros(0), *bounds])
        self.place = np.full(int(columns.max(initial=-1)) + 1, -1, dtype=np.int64)
        self.place[columns] = np.arange(len(columns))

    def of(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, slots) of the entries beyond their column's first bound."""
        place = np.where(columns < len(self.place), self.place[np.minimum(columns, len(self.place) - 1)], -1)
        held = place >= 0
        rows, place, values = rows[held], place[held], values[held]
        bins, many = np.zeros(len(place), dtype=np.int64), np.diff(self.begins)[place]
        for k in range(int(np.diff(self.begins).max(initial=0))):
            more = np.flatnonzero(many > k)
            bins[more] += values[more] > self.bounds[self.begins[place[more]] + k]
        inside = bins > 0
        return rows[inside], (self.begins[place] + bins - 1)[inside].astype(np.int32)


class Trees:
    """Trees by the numbers of their nodes (1, and 2n and 2n + 1 below n): the slots from ``low`` on to ``high`` go to the right, leaves have values."""

    def __init__(self) -> None:
        self.splits: list[dict[int, tuple[int, int]]] = []
        self.values: list[dict[int, float]] = []

    def nodes(self, many: int, rows: np.ndarray, slots: np.ndarray, slots_in_all: int, first: int = 0) -> Iterator[np.ndarray]:
        """Each tree's node of each text."""
        used = sorted({s for tree in self.splits[first:] for s in tree.values()})
        known = np.zeros(slots_in_all + 1, dtype=bool)
        for low, high in used:
            known[low:high] = True
        few = np.flatnonzero(known[slots])
        rows, slots = rows[few], slots[few]
        order = np.argsort(slots, kind="stable")
        rows, slots = rows[order], slots[order]
        right = np.zeros((len(used), many), dtype=bool)
        for k, (low, high) in enumerate(used):
            right[k, rows[np.searchsorted(slots, low) : np.searchsorted(slots, high)]] = True
        at = {s: k for k, s in enumerate(used)}
        for tree in self.splits[first:]:
            node = np.ones(many, dtype=np.int64)
            for n in sorted(tree):
                here = np.flatnonzero(node == n)
                node[here] = 2 * n + right[at[tree[n]], here]
            yield node

    def margins(self, many: int, rows: np.ndarray, slots: np.ndarray, slots_in_all: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
        """The weighted sum of the first ``trees`` trees, and the texts' nodes in the next one, if there is one."""
        total, last = np.zeros(many), np.ones(many, dtype=np.int64)
        for k, node in enumerate(self.nodes(many, rows, slots, slots_in_all)):
            if k == trees:
                last = node
                break
            table = np.zeros(1 << (DEPTH + 1))
            table[list(self.values[k])] = list(self.values[k].values())
            total += table[node] * (1.0 if k == 0 else RATE)
        return total, last


def _impurity(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.divide(q - np.divide(s * s, n, out=np.zeros_like(s), where=n > 0), n, out=np.zeros_like(s), where=n > 0)


def best_splits(sums: np.ndarray, whole: np.ndarray, begins: np.ndarray) -> list[tuple[int, float, int, float, float, float]]:
    """(node, gain, slot, and of the right side its rows, sum and sum of squares) of each node's best split; ties to the smaller slot. ``sums`` (3, nodes, slots) and ``whole`` (3, nodes)."""
    right, sizes = sums.copy(), np.diff(begins)
    for k in range(int(sizes.max(initial=0)) - 2, -1, -1):
        at = begins[:-1][sizes > k + 1] + k
        right[:, :, at] += right[:, :, at + 1]
    n, s, q = right
    wn, ws, wq = (w[:, None] for w in whole)
    gain = _impurity(wn, ws, wq) - (wn - n) / np.maximum(wn, 1) * _impurity(wn - n, ws - s, wq - q) - n / np.maximum(wn, 1) * _impurity(n, s, q)
    gain = np.where((n >= 1) & (wn - n >= 1), gain, -1.0)
    if not gain.shape[1]:
        return []
    best = gain.argmax(axis=1)
    return [(i, float(gain[i, k]), int(k), float(n[i, k]), float(s[i, k]), float(q[i, k])) for i, k in enumerate(best.tolist()) if gain[i, k] > 0]


def _binned(rows: DataFrame, features: str, label: Column, columns: list[int]) -> tuple[DataFrame, Bins]:
    """(y, slots) of each row, y being -1 or 1, and the bins; features are counts, whole numbers."""

    def valued(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            _, c, v = _vectors(part, 0)
            pairs, n = np.unique((c.astype(np.int64) << 32) + v.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.float64)), pa.array(n.astype(np.int64))], names=["c", "v", "n"])

    many = rows.count()
    most = min(BINS, many) - 1

    def bounded(group: pa.Table) -> pa.Table:
        order = np.argsort(group["c"].to_numpy(), kind="stable")
        c, v, n = (group[x].to_numpy()[order] for x in "cvn")
        at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        found = [thresholds(v[a:b], n[a:b], many, most).tolist() for a, b in zip(at, [*at[1:], len(c)], strict=True)]
        return pa.table({"c": pa.array(c[at], type=pa.int32()), "b": pa.array(found, type=pa.list_(pa.float64()))})

    counts = rows.select(features).mapInArrow(valued, "c int, v double, n long").where("v <> 0").groupBy("c", "v").agg(F.sum("n").alias("n"))
    parts = counts.withColumn("part", F.col("c") % 64).groupBy("part").applyInArrow(bounded, "c int, b array<double>")
    found = {r.c: np.array(r.b) for r in parts.collect()}
    kept = np.array(sorted(c for c in columns if len(found.get(c, ()))), dtype=np.int64)
    bins = Bins(kept, [found[c] for c in kept.tolist()])

    def slotted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, slots = bins.of(*_vectors(part, 0))
            ends = np.append(0, np.cumsum(np.bincount(at, minlength=part.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(slots))], names=["y", "slots"])

    return rows.select(features, label.alias("y")).mapInArrow(slotted, "y double, slots array<int>"), bins


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(part.column(1).offsets.to_numpy())
    return part.column(0).to_numpy(), np.repeat(np.arange(len(sizes)), sizes), part.column(1).flatten().to_numpy()


def fit(rows: DataFrame, features: str, label: Column, columns: list[int]) -> tuple[Trees, Bins]:
    """Trees that tell rows with ``label`` 1 from those with -1 by these columns of their features."""
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    binned, bins = _binned(rows, features, label, columns)
    # a task holds the sums of its texts, however many these are: as many tasks as cores
    binned = binned.persist(StorageLevel.DISK_ONLY)
    near = binned.coalesce(tasks)
    cuts = np.unique(np.linspace(0, len(bins.columns), min(tasks, max(1, len(bins.columns))) + 1).round().astype(np.int64))
    trees, begins = Trees(), bins.begins

    def summed(tree: int, asked: list[int]):
        line = np.full(1 << (DEPTH + 1), -1)
        line[asked] = np.arange(len(asked))

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, whole = np.zeros((3, len(asked) * bins.slots)), np.zeros((3, len(asked)))
            for part in parts:
                y, at, slots = _texts(part)
                margin, node = trees.margins(len(y), at, slots, bins.slots, tree)
                aim = y if tree == 0 else 4 * y / (1 + np.exp(2 * y * margin))
                mine = line[node]
                inside = mine >= 0
                for k, w in enumerate((None, aim[inside], aim[inside] ** 2)):
                    whole[k] += np.bincount(mine[inside], weights=w, minlength=len(asked))
                held = np.flatnonzero(inside[at])
                cells, of = mine[at[held]] * bins.slots + slots[held], aim[at[held]]
                for k, w in enumerate((None, of, of * of)):
                    sums[k] += np.bincount(cells, weights=w, minlength=sums.shape[1])
            sums = sums.reshape(3, len(asked), bins.slots)
            for k in range(len(cuts) - 1):
                some = sums[:, :, begins[cuts[k]] : begins[cuts[k + 1]]]
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], type=pa.int32()), "sums": [np.ascontiguousarray(some).tobytes()], "whole": [whole.tobytes()]})

        def best(group: pa.Table) -> pa.Table:
            k = group["slice"][0].as_py()
            own = begins[cuts[k] : cuts[k + 1] + 1] - begins[cuts[k]]
            sums, whole = np.zeros(3 * len(asked) * int(own[-1])), np.zeros(3 * len(asked))
            for part in group["sums"]:
                sums += np.frombuffer(part.as_buffer())
            for part in group["whole"]:
                whole += np.frombuffer(part.as_buffer())
            whole = whole.reshape(3, len(asked))
            found = best_splits(sums.reshape(3, len(asked), -1), whole, own)
            found = [(i, g, slot + int(begins[cuts[k]]), *right) for i, g, slot, *right in found]
            found += [(i, -1.0, -1, *whole[:, i].tolist()) for i in range(len(asked)) if k == 0]
            return pa.Table.from_pylist([dict(zip(("node", "gain", "slot", "n", "s", "q"), f, strict=True)) for f in found], schema=pa.schema([("node", pa.int32()), ("gain", pa.float64()), ("slot", pa.int32()), ("n", pa.float64()), ("s", pa.float64()), ("q", pa.float64())]))

        return near.mapInArrow(add, "slice int, sums binary, whole binary").groupBy("slice").applyInArrow(best, "node int, gain double, slot int, n double, s double, q double").collect()

    for tree in range(TREES):
        trees.splits.append({})
        trees.values.append({})
        asked = [1]
        for level in range(DEPTH):
            if not asked:
                break
            found, below = summed(tree, asked), []
            for i, node in enumerate(asked):
                whole = next(r for r in found if r.node == i and r.slot < 0)
                mine = min((r for r in found if r.node == i and r.slot >= 0), key=lambda r: (-r.gain, r.slot), default=None)
                if mine is None:
                    trees.values[tree][node] = whole.s / whole.n if whole.n else 0.0
                    continue
                end = int(begins[np.searchsorted(begins, mine.slot, side="right")])
                trees.splits[tree][node] = (mine.slot, end)
                for child, n, s, q in ((2 * node, whole.n - mine.n, whole.s - mine.s, whole.q - mine.q), (2 * node + 1, mine.n, mine.s, mine.q)):
                    if level + 1 == DEPTH or abs((q - s * s / n) / n) < EPSILON:
                        trees.values[tree][child] = s / n
                    else:
                        below.append(child)
            asked = below
    binned.unpersist()
    return trees, bins


def margins(rows: DataFrame, features: str, keep: list[str], model: tuple[Trees, Bins], name: str) -> DataFrame:
    """``keep`` of the rows with what the trees say: above 0 for label 1."""
    trees, bins = model

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, slots = bins.of(*_vectors(part, len(keep)))
            margin, _ = trees.margins(part.num_rows, at, slots, bins.slots, len(trees.splits))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(margin)], names=[*keep, name])

    schema = StructType([*[rows.schema[c] for c in keep], StructField(name, DoubleType())])
    return rows.select(*keep, F.col(features).alias("_of")).mapInArrow(told, schema)
