"""Packing of documents into token sequences along a space-filling curve.

1. Every document is tokenised and closed with an end id; the ids' random projection to three dimensions
   gives a Hilbert key, so that documents of like vocabulary lie near each other on the curve.
2. The curve is cut at quantiles of the keys, taken from a bounded sample of documents; documents go to the
   range that holds their key (ties are told apart by a hash of doc_id, so a key that many share spans ranges).
3. In each range, documents follow each other in order of the key and fill sequences to the last id. What
   remains at a range's end goes into sequences whose lengths are powers of two, so nothing is padded.

Null text counts as empty: one piece, the end id. Repeated rows are packed each. An empty table gives no
rows. Other columns are ignored. A document longer than a sequence is cut into pieces. A range is read as a
stream, so memory follows the longest document only.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.shared import give_back, partitions, slices, table

SEQUENCE = 4096
END_ID = 2
DIMENSIONS = 3
BITS = 10
#: Rows of the sample per range from which the ranges' bounds come.
SAMPLE_PER_RANGE = 20
#: Words whose ids a worker keeps.
KEPT_WORDS = 300_000
#: Characters on which str.split and the tokenizer's notion of space differ.
ODD_SPACES = "\x1c\x1d\x1e\x1f"

#: Words of letters whose lower case is one letter and that no normal form changes, with marks behind them, which are one pretoken.
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)")
#: The spelling of bytes in the vocabulary: printable ones as they are, the others in order from 256 on; spaces stay, they part words.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED) if b != 32}

_state: dict = {}


class _Words:
    """Ids of texts, as little-endian strings of 16 bits, or 32 where the vocabulary needs them. The pretokenizer never matches across space, so a text's
    ids are those of its space-separated words, and words are kept."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.kept: dict[str, bytes] = {"": b""}
        # the same merges without normaliser and pattern, for words that need neither: plain letters, in the vocabulary's spelling of bytes
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = WhitespaceSplit()
        self.marks: dict[str, bytes] = {"": b""}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _simple(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of LETTERS only: one pretoken each, so that each ends at its end-of-word token."""
        out: list[bytes] = []
        width = np.dtype(self.dtype).itemsize
        parts = [words[k : k + 32] for k in range(0, len(words), 32)]
        spelled = (" ".join(words).encode().decode("latin-1").translate(BYTES)).split(" ") if words else []
        texts = [" ".join(spelled[k : k + 32]) for k in range(0, len(words), 32)]
        for part, e in zip(parts, self.letters.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype=self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) * width + width).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                out += [raw[b:e] for b, e in zip([0, *cuts], cuts)]
            else:
                out += self._ids(part)
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't kept yet."""
        # lists of columns cost less than a tuple for each word
        simple, stems, ends, whole = [], [], [], []
        for w in words:
            m = LETTERS.fullmatch(w)
            if m:
                stem, mark = m.groups()
                simple.append(w)
                stems.append(stem.lower())
                ends.append(mark)
            else:
                whole.append(w)
        kept, marks = self.kept, self.marks
        need = list(set(stems).difference(kept.keys()))
        of = dict(zip(need, self._simple(need)))
        if more := list(set(ends).difference(marks.keys())):
            marks.update(zip(more, self._ids(more)))
        new = dict(zip(whole, self._ids(whole)))
        new.update(zip(simple, [(of.get(stem) or kept[stem]) + marks[mark] for stem, mark in zip(stems, ends)]))
        if len(kept) < KEPT_WORDS:
            kept.update(of)
            kept.update(new)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {k: self._ids([t])[0] for k, t in enumerate(texts) if any([c in t for c in ODD_SPACES])}
        split = pc.utf8_split_whitespace(pa.array([t if k not in odd else "" for k, t in enumerate(texts)], pa.string()))
        coded = split.flatten().dictionary_encode()  # each word once, and where it stands
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = list(map(self.kept.get, distinct))
        if missing := {w for w, x in zip(distinct, known) if x is None}:
            new = self.learn(missing)
            known = [new[w] if x is None else x for w, x in zip(distinct, known)]
        # the ids of all words in a row, then those of the texts' words gathered from there
        kind = np.dtype(self.dtype)
        lengths = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // kind.itemsize
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        widths = lengths[at]
        ends = np.cumsum(widths, dtype=np.int32)
        place = np.repeat(starts[at] - (ends - widths), widths) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        raw = np.frombuffer(b"".join(known), dtype=kind)[place].tobytes()
        cuts = (np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()].astype(np.int64) * kind.itemsize).tolist()
        return [odd[k] if k in odd else raw[b:e] for k, (b, e) in enumerate(zip(cuts, cuts[1:]))]


def _words(vocabulary: str) -> _Words:
    import public_tokenizers

    if vocabulary not in _state:
        _state[vocabulary] = _Words(public_tokenizers.path(vocabulary))
    return _state[vocabulary]


def _directions(size: int) -> np.ndarray:
    """A random direction for every id."""
    if "directions" not in _state or len(_state["directions"]) < size:
        _state["directions"] = np.random.default_rng(7).standard_normal((size, DIMENSIONS)).astype("f4")
    return _state["directions"]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each row of non-negative cell coordinates below 2**bits (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[:, i] >> b & 1
    return key


def _keys(flat: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """Curve key of each document, with a hash of its id in the low bits; documents' ids begin at ``starts``, each has some."""
    sums = np.add.reduceat(_directions(1 << 16)[flat & 0xFFFF], starts, axis=0, dtype=np.float64)
    lengths = np.diff(np.append(starts, len(flat)))[:, None]
    cells = np.clip((sums / lengths * np.minimum(lengths, 4096) ** 0.5 / 24 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    low = np.array([zlib.crc32(str(i).encode()) for i in doc_ids], dtype=np.int64)
    return hilbert(cells, BITS) << 32 | low


def tokenized(docs: DataFrame, vocabulary: str, bounds: list[int] | None = None) -> DataFrame:
    """(doc_id, curve, place, width, ids): ids as little-endian numbers of ``width`` bytes with the end id; place is the range among ``bounds``."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cuts = _words(vocabulary), np.array(bounds or [], dtype=np.int64)
        kind = np.dtype(words.dtype)
        end = np.array([END_ID], dtype=kind).tobytes()
        for part in slices(parts, rows=5000, size=4 << 20):
            ids = [x + end for x in words.encode([t or "" for t in part.column(1).to_pylist()])]
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // kind.itemsize
            flat = np.frombuffer(b"".join(ids), dtype=kind)
            curve = _keys(flat, np.append(0, np.cumsum(lengths)[:-1]), part.column(0).to_pylist())
            place = np.searchsorted(cuts, curve, side="right").astype(np.int32)
            width = np.full(len(ids), kind.itemsize, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve), pa.array(place), pa.array(width), pa.array(ids, pa.binary())], ["doc_id", "curve", "place", "width", "ids"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, curve long, place int, width int, ids binary")


def pack(docs: DataFrame, ranges: int, vocabulary: str = "word_bpe_49k.json", size: int = SEQUENCE) -> DataFrame:
    """The pieces of every document, each with its sequence and offset."""
    rows = docs.count()
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(rows, 1))
    bounds: list[int] = []
    if ranges > 1 and rows:
        sample = tokenized(docs.sample(fraction=share, seed=5), vocabulary).select("curve")
        bounds = [int(x.curve) for x in sample.collect()]  # about SAMPLE_PER_RANGE numbers for each range
        bounds = sorted(bounds)[:: max(1, len(bounds) // ranges)][1:]

    def ranged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        place, number, filled = None, 0, 0
        out: list[list] = []

        def close(pieces: list) -> None:
            """Deals what remains of a range to sequences of a power of two."""
            nonlocal number
            left = sum(p[2] for p in pieces)
            room = 0
            offset = 0
            for doc_id, start, length, ids, total in pieces:
                while length:
                    if not room:
                        room, offset = 1 << (left.bit_length() - 1), 0
                        left -= room
                        number += 1
                    take = min(room, length)
                    emit(doc_id, start, take, ids, total, number - 1, offset)
                    start, length, room, offset = start + take, length - take, room - take, offset + take

        def emit(doc_id, start, length, ids, total, sequence, offset) -> None:
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            out.append([doc_id, start, length, crc, total, (place << 40) + sequence, offset])

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        pending: list = []
        for part in parts:
            for doc_id, at, width, cell in zip(*[c.to_pylist() for c in part.columns[:3]], part.column(3)):
                if at != place:
                    close(pending)
                    pending, filled, place, number = [], 0, at, 0
                ids = np.frombuffer(cell.as_buffer(), dtype=f"<u{width}")
                total = len(ids)
                start = 0
                while start < total:
                    take = min(size - filled, total - start)
                    pending.append((doc_id, start, take, ids, total))
                    start, filled = start + take, filled + take
                    if filled == size:
                        offset = 0
                        for d, s, n, x, t in pending:
                            emit(d, s, n, x, t, number, offset)
                            offset += n
                        pending, filled, number = [], 0, number + 1
                if len(out) > 5000:
                    yield flush()
        close(pending)
        if out:
            yield flush()

    dealt = tokenized(docs, vocabulary, bounds).repartition(max(1, ranges // 4), "place").sortWithinPartitions("place", "curve", "doc_id", "ids")
    return dealt.select("doc_id", "place", "width", "ids").mapInArrow(
        ranged, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 4 * partitions(spark))


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
