"""Line dedup by pairwise alignment.

1. Rows with equal texts are one text; its document is the smallest doc_id. Rows of a larger doc_id are whole copies: all their
   lines go, if they have LEAST_WORDS words together.
2. Lines are hashed without outer spaces. The shortest runs of lines with LEAST_WORDS words, from each line on and up to each line, are
   keys: any block that two texts share holds one, however common its lines are by themselves, and every line of a block is in one. Each text with a key and the first
   holder of the key are a pair: as many pairs as keys, whatever the number of holders.
3. A pair is aligned by patience diff: equal first and last lines, then the lines that both hold once, in the longest
   run that keeps their order, then again between these anchors. Aligned blocks (neighbours in both texts) of
   LEAST_WORDS words or more go from the later text. Repeated and moved blocks are aligned on their own: a run
   of the later text that the earlier one holds goes wherever it stands.
   So a line goes if, and only if, it is in a block of LEAST_WORDS words that any earlier text holds; a blank one if the lines around it go.

The earlier of two texts is that of the smaller doc_id, then of the smaller hash; the first text with a line keeps it.
A document whose every line is deleted (and that had text) is left out by ``deduplicated``; all other rows stay.
Null text stays null, empty text empty; rows with null doc_id stay as they are. Rows that repeat doc_id and text get
equal results and are no copies of each other; rows that share only the doc_id are texts of their own. Other columns pass through.
Two texts are taken as equal if two 64-bit hashes agree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.shared import give_back, table, unused, written

#: Words that an aligned block has at least.
LEAST_WORDS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _in_order(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (place, place in the other text), in order of the first, whose second numbers rise."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(anchors)
    for k, (_, at) in enumerate(anchors):
        spot = bisect_left(tails, at)
        before[k] = last[spot - 1] if spot else -1
        tails[spot : spot + 1] = [at]
        last[spot : spot + 1] = [k]
    run, k = [], last[-1] if last else -1
    while k >= 0:
        run.append(anchors[k])
        k = before[k]
    return run[::-1]


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The aligned places of two lists of line hashes, by patience diff."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: k for k, x in enumerate(b[b0:b1], b0) if times_b[x] == 1}
        run = _in_order([(k, place[x]) for k, x in enumerate(a[a0:a1], a0) if x in place and times_a[x] == 1])
        for (i, j), (p, q) in zip(run, [*run[1:], (a1, b1)]):
            todo.append((i, p, j, q))
        if run:
            todo.append((a0, run[0][0], b0, run[0][1]))
    return sorted(out)


def runs(words: np.ndarray) -> np.ndarray:
    """(begin, end) of the shortest runs of lines with LEAST_WORDS words, from each line on and up to each line; ``words`` has each line's number."""
    upto = np.append(0, np.cumsum(words))
    some = np.flatnonzero(words > 0)
    ends = np.searchsorted(upto, upto[some] + LEAST_WORDS)  # of the run from a line on
    begins = np.searchsorted(upto, upto[some + 1] - LEAST_WORDS, side="right") - 1  # of the run up to a line
    on, up = ends < len(upto), upto[some + 1] >= LEAST_WORDS
    both = np.concatenate([np.stack([some[on], ends[on]], axis=1), np.stack([begins[up], some[up] + 1], axis=1)])
    return np.unique(both, axis=0)


def run_hashes(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A hash of the lines of each run."""
    sizes = (of[:, 1] - of[:, 0]).astype(np.int64)
    out = sizes.astype(np.uint64)
    for k in range(int(sizes.max(initial=0))):
        held = sizes > k
        x = (out[held] ^ keys[of[held, 0] + k]) * _BASE
        out[held] = x ^ (x >> np.uint64(29))
    return out.view(np.int64)


def aligned_lines(later: list[int], words: list[int], earlier: list[int], earlier_words: list[int]) -> list[int]:
    """The places of the lines that go from the later of two texts. Lines are hashes, 0 for a blank one; words are the numbers of their words."""
    mine, theirs = (np.array(x, dtype=np.int64).view(np.uint64) for x in (later, earlier))
    own = runs(np.array(words))
    gone: set[int] = set()
    block: list[tuple[int, int]] = []
    for at in [*matches(later, earlier), None]:
        if at and block and at == (block[-1][0] + 1, block[-1][1] + 1):
            block.append(at)
            continue
        if sum(words[i] for i, _ in block) >= LEAST_WORDS:
            gone.update(i for i, _ in block)
        block = [at] if at else []
    open_ = [(i, j) for i, j in own.tolist() if not gone.issuperset(range(i, j))]
    if open_:  # moved blocks: candidates by hash, then line by line
        at: dict[int, list[tuple[int, int]]] = {}
        held = runs(np.array(earlier_words))
        for h, (i, j) in zip(run_hashes(theirs, held).tolist(), held.tolist(), strict=True):
            at.setdefault(h, []).append((i, j))
        for h, (i, j) in zip(run_hashes(mine, np.array(open_)).tolist(), open_, strict=True):
            if any(earlier[p:q] == later[i:j] for p, q in at.get(h, ())):
                gone.update(range(i, j))
    return sorted(gone)


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("node"), F.xxhash64(text, F.lit(1)).alias("proof")]


def _texts(docs: DataFrame) -> DataFrame:
    """(node, proof, first, rows, keys, words) of every distinct text: its smallest doc_id, its rows, its lines' hashes and word counts."""
    lines = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), *_hashes(F.col("text")), F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("lines")
    )
    shown = lines.select(
        "doc_id", "node", "proof",
        F.transform("lines", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("keys"),
        F.transform("lines", lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)).alias("words"),
    )
    own = F.struct("keys", "words")
    return shown.groupBy("node", "proof").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.first(own).alias("l")).select(
        "node", "proof", "first", "rows", "l.keys", "l.words"
    )


def _keys(texts: DataFrame) -> DataFrame:
    """(node, first, key) of each text, each key once."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                found = []
                for keys, words in zip(part.column(2), part.column(3), strict=True):
                    lines = keys.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    found.append(np.unique(run_hashes(lines, runs(words.values.to_numpy(zero_copy_only=False).astype(np.int64)))))
                sizes = np.array([len(x) for x in found], dtype=np.int64)
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found]))], names=["node", "first", "key"])
        give_back()

    return texts.select("node", "first", "keys", "words").mapInArrow(batches, "node long, first long, key long")


def pairs(texts: DataFrame) -> DataFrame:
    """(node, source) of the texts that are aligned; the source is the earlier one."""
    keys = written(_keys(texts))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("first", "node")).alias("source")).where("held > 1")
    return keys.join(shared.select("key", F.col("source.node").alias("source")), "key").where("node <> source").select("node", "source").distinct()


def with_blanks(words: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The places of lines that go, out of each text's numbers of words and places; blank ones go by the lines around them."""
    for sizes, gone in words:
        out = []
        for n, places in zip(sizes, gone, strict=True):
            if not places.is_valid:
                out.append(None)
                continue
            n = n.values.to_numpy(zero_copy_only=False)
            goes = np.zeros(len(n), dtype=bool)
            goes[places.values.to_numpy(zero_copy_only=False)] = True
            solid = np.flatnonzero(n > 0)
            after = np.searchsorted(solid, np.arange(len(n)))  # of the lines with words, the first at or after each line
            inner = (n == 0) & (after > 0) & (after < len(solid))
            goes[n == 0] = False
            goes[inner] = goes[solid[after[inner] - 1]] & goes[solid[after[inner]]]
            out.append(np.flatnonzero(goes).astype(np.int32))
        yield pa.array(out, pa.list_(pa.int32()))
    give_back()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(node, proof, first, gone array<int>, whole) of the texts that lose lines or have copies: the lines that go, and whether copies go as a whole."""
    texts = written(_texts(docs))
    found = written(pairs(texts))
    later = texts.select("node", "keys", "words")
    earlier = texts.select(F.col("node").alias("source"), F.col("keys").alias("held"), F.col("words").alias("held_words"))
    both = found.join(earlier, "source").join(later, "node").select("node", "keys", "words", "held", "held_words")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                gone = [aligned_lines(*(x.as_py() for x in row)) for row in zip(*part.columns[1:], strict=True)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(gone, pa.list_(pa.int32()))], ["node", "gone"])
                yield out.filter(pa.array([bool(x) for x in gone], pa.bool_()))
        give_back()

    gone = both.mapInArrow(batches, "node long, gone array<int>").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    enough = F.aggregate("words", F.lit(0), lambda n, x: n + x) >= LEAST_WORDS
    out = texts.select("node", "proof", "first", "rows", "words", enough.alias("whole")).join(gone, "node", "left").where("gone is not null or rows > 1")
    return out.withColumn("gone", F.arrow_udf(with_blanks, "array<int>")("words", "gone")).drop("rows", "words")


def deduplicated(docs: DataFrame, keep_emptied: bool = False) -> DataFrame:
    """``docs`` without the repeated blocks; n_chars follows where it is a column."""
    own = {c: unused(docs, f"_{c}") for c in ("node", "proof", "first", "gone", "whole")}
    gone = written(repeated_lines(docs)).select(*[F.col(c).alias(n) for c, n in own.items()])
    node, proof = _hashes(F.col("text"))
    out = docs.join(gone, (node == F.col(own["node"])) & (proof == F.col(own["proof"])) & docs["doc_id"].isNotNull(), "left")
    copy = F.col(own["whole"]) & (F.col("doc_id").cast("long") > F.col(own["first"]))
    kept = F.when(copy, F.array().cast("array<string>")).otherwise(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(own["gone"], i)))
    changed = F.coalesce(copy, F.lit(False)) | F.col(own["gone"]).isNotNull()
    if not keep_emptied:
        out = out.where(~changed | F.exists(kept, lambda x: F.trim(x) != ""))
    out = out.withColumn("text", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), keep_emptied=True)


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE: dict[str, str] = {}
