"""Byte-level BPE as a monoid over text segments.

A segment's element is (text span, token ids). A leaf is encoded directly; two neighbours are joined by
re-encoding a window around their boundary. The window grows on either side until it ends where a
non-space character meets a space: no match of the splitting pattern crosses such a place and none looks
past it, so the ids outside the window are those of the whole text, whatever stands elsewhere. Decoding
splits the ids in halves and concatenates the bytes up the tree.

Null text counts as empty: no ids, and the digests of the empty string. Rows with a null or repeated
doc_id are encoded one by one like all others; other columns are ignored. Each row is handled on its own, in one
pass without a shuffle, and a very long text needs memory in proportion to its own length only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.shared import table

#: Characters of text in a leaf of the tree, and ids in a leaf of the decoding tree.
LEAF_CHARS = 4096
LEAF_IDS = 8192
#: Characters that the splitting pattern certainly takes as space.
SPACES = " \n\t\r"


@lru_cache(maxsize=4)
def _codec(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    of = {rank: token for token, rank in ranks.items()}
    return own.encode_ordinary, of, {rank: str(rank) for rank in of}


def _stable_before(text: str, low: int, at: int) -> int:
    """The last place p in (low, at) with a non-space before it and a space after it, else low."""
    width = 16
    while True:
        start = max(low + 1, at - width)
        for p in range(at - 1, start - 1, -1):
            if text[p] in SPACES and not text[p - 1].isspace():
                return p
        if start == low + 1 or start > at:
            return low
        at, width = start, width * 2


def _stable_after(text: str, at: int, high: int) -> int:
    """The first place q in (at, high) with a non-space before it and a space after it, else high."""
    for q in range(at + 1, high):
        if text[q] in SPACES and not text[q - 1].isspace():
            return q
    return high


def encode_text(text: str, encode: Callable[[str], list[int]], leaf_chars: int = LEAF_CHARS) -> list[int]:
    """The ids of the whole text, by reduction over halves."""

    def node(low: int, high: int) -> list[int]:
        if high - low <= leaf_chars:
            return encode(text[low:high])
        mid = (low + high) // 2
        left, right = node(low, mid), node(mid, high)
        p, q = _stable_before(text, low, mid), _stable_after(text, mid, high)
        drop, skip = len(encode(text[p:mid])), len(encode(text[mid:q]))
        del left[len(left) - drop :]
        left += encode(text[p:q])
        left += right[skip:]
        return left

    return node(0, len(text))


def decode_ids(ids: list[int], of: dict[int, bytes], leaf_ids: int = LEAF_IDS) -> bytes:
    """The bytes of the ids, by concatenation over halves."""
    if len(ids) <= leaf_ids:
        return b"".join(map(of.__getitem__, ids))
    mid = len(ids) // 2
    return decode_ids(ids[:mid], of, leaf_ids) + decode_ids(ids[mid:], of, leaf_ids)


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids array<int>) of every row of (doc_id, text)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, _, _ = _codec(_path(vocabulary))
        for part in parts:
            ids = [encode_text(t or "", plain) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, bytes binary) of every row of (doc_id, ids); null ids give empty bytes."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of, _ = _codec(_path(vocabulary))
        for part in parts:
            out = [decode_ids(x or [], of) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(batches, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encodes and decodes every row in one pass; only counts and digests leave the Python worker."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, of, shown = _codec(_path(vocabulary))
        for part in parts:
            n, ids_sha, out_sha = [], [], []
            for cell in part.column(1):
                ids = encode_text(cell.as_py() or "", plain)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(decode_ids(ids, of)).hexdigest())
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLE: dict[str, str] = {}
