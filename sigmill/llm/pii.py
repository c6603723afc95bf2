"""Personal data, found also behind light disguises, with spans in the characters of the source.

Base detection runs on the source text. Deobfuscation runs a chain of transducers over places of interest:
wide or look-alike characters become plain ones, invisible characters go, spelled digits become digits, and
at/dot disguises become "@" and ".". Each output character carries the source span it came from, so what is
found in the normalised text maps back to source characters. Spans found that way are added where they
don't overlap a base span of the same kind; base spans always stay.

Null text counts as empty and has no spans. Every row is handled on its own, repeated rows and null ids
included; other columns are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.shared import give_back, slices, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: An address starts where its run of digits does, and takes whole runs: without backtracking, long runs cost their length.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like plain ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
    "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "\xa0": " ", "。": ".",
}
# Characters without width.
INVISIBLE = frozenset("­​‌‍⁠﻿")
# Spelled digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Names of "@", "." and "+" in these languages.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|ät|arobase|arroba", "dot|punkt|point|punto", "plus|más"

_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_DIGIT = f"(?:{_WORDS}|[0-9])"
_L = "A-Za-zÀ-ÿ"
#: Characters that transducer 1 changes.
ODD = re.compile(f"[{re.escape(''.join(LOOKALIKES) + ''.join(INVISIBLE))}\uff01-\uff5e\U0001d400-\U0001d7ff]")
#: Two digits or more in a row, spelled or not; a plus or its name may stand before.
RUN = re.compile(rf"(?<![{_L}0-9])(?:(?:{PLUS_WORDS})[ ]|\+[ ]?)?{_DIGIT}(?:[ ]?[-. (),]?[ ]?(?:(?:{DOT_WORDS})[ ])?{_DIGIT})+(?![{_L}0-9])", re.I)
SPELLED_WORD = re.compile(rf"(?<![{_L}])(?:{_WORDS})(?![{_L}])", re.I)
#: A bare "at" counts before a name with a dot; not where the dot ends a sentence (small letter before, capital and small letter after: "at this.That").
AT = re.compile(
    rf"[ ]?[\[({{<][ ]?(?:{AT_WORDS})[ ]?[\])}}>][ ]?|(?<=[A-Za-z0-9])[ ](?:{AT_WORDS})[ ](?!(?-i:[a-z])[A-Za-z0-9-]*\.(?-i:[A-Z][a-z]))"
    rf"(?=[A-Za-z0-9-]+(?:[ ]?[\[({{<][ ]?(?:{DOT_WORDS})|[ ](?:{DOT_WORDS})[ ]|\.[A-Za-z0-9]))|[ ]@[ ]", re.I
)
#: What a match of AT or DOT holds at least.
_CLUES = [f" {w} " for w in (*AT_WORDS.split("|"), *DOT_WORDS.split("|"), "@")] + list("[({<")
DOT = re.compile(rf"[ ]?[\[({{<][ ]?(?:{DOT_WORDS}|\.)[ ]?[\])}}>][ ]?|(?<=[A-Za-z0-9])[ ](?:{DOT_WORDS})[ ](?=[A-Za-z0-9])", re.I)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in map(int, digits[-2::-2]):
        total += d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the plain detectors, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in [x.lstrip("0") for x in m[0].split(".")]):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


Mapped = tuple[str, list[int], list[int]]


def plain_characters(text: str) -> Mapped:
    """Transducer 1: wide, look-alike and invisible characters. Gives the text and each character's source start and end."""
    out, starts, ends = [], [], []
    for i, c in enumerate(text):
        if c in INVISIBLE:
            if ends:
                ends[-1] = i + 1
            continue
        plain = c if c < "\x80" else LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c) if c in LOOKALIKES or "＀" <= c <= "￯" or "\U0001d400" <= c <= "\U0001d7ff" else c
        for x in plain:
            out.append(x)
            starts.append(i)
            ends.append(i + 1)
    return "".join(out), starts, ends


def rewritten(mapped: Mapped, pattern: re.Pattern, to) -> Mapped:
    """A transducer: each match of the pattern becomes ``to(match)``, whose characters carry the match's source span."""
    text, starts, ends = mapped
    out, s, e, at = [], [], [], 0
    for m in pattern.finditer(text):
        new = to(m)
        if new is None or m.end() == m.start():
            continue
        out.append(text[at : m.start()])
        s += starts[at : m.start()]
        e += ends[at : m.start()]
        out.append(new)
        s += [starts[m.start()]] * len(new)
        e += [ends[m.end() - 1]] * len(new)
        at = m.end()
    if not out:
        return mapped
    out.append(text[at:])
    return "".join(out), s + starts[at:], e + ends[at:]


def _digits(m: re.Match) -> str | None:
    """A run of spelled digits in plain digits; the separators go, but for dots of an address and a leading plus."""
    if not SPELLED_WORD.search(m[0]):
        return None
    shown = re.sub(rf"(?i)(?:{PLUS_WORDS}) ", "+", m[0])
    shown = re.sub(rf"(?i) ?(?:{DOT_WORDS}) ", ".", shown)
    shown = re.sub(rf"(?i)[{_L}]+", lambda w: SPELLED.get(w[0].lower(), w[0]), shown)
    return re.sub(r"[ ,()-]", "", shown)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that show only in the normalised text."""
    odd = not text.isascii() and ODD.search(text)
    low = text if odd else text.lower()  # a cheap look for the rarer words first; any of them alone decides nothing
    if not (odd or SPELLED_WORD.search(text) or any([w in low for w in _CLUES]) and (DOT.search(text) or AT.search(text))):
        return []
    mapped = plain_characters(text)
    mapped = rewritten(mapped, RUN, _digits)
    mapped = rewritten(mapped, AT, lambda m: "@")
    mapped = rewritten(mapped, DOT, lambda m: ".")
    taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}  # in order, without overlaps
    found = []
    for s, kind, e in base_spans(mapped[0]):
        start, end = mapped[1][s], mapped[2][e - 1]
        at = bisect_left(taken[kind], (end,)) - 1  # the last that begins before the end
        if at < 0 or taken[kind][at][1] <= start:
            found.append((start, kind, end))
    return found


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row; base and spans are arrays of (kind, start, end) in order of start."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        named = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]
        for part in slices(parts):
            base, every = [], []
            for cell in part.column(1):
                text = cell.as_py() or ""
                plain = base_spans(text)
                base.append(named(plain))
                every.append(named(sorted(plain + added_spans(text, plain))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    one = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, f"doc_id long, base {one}, spans {one}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of text replaced by its kind in brackets; null text stays null, n_chars follows where it is a column."""
    names = docs.columns

    def masked(text: str) -> str:
        plain = base_spans(text)
        out, free = [], 0
        for s, k, e in sorted(plain + added_spans(text, plain)):
            if e <= free:
                continue
            out += [text[free : max(s, free)], f"[{KINDS[k].upper()}]"]
            free = e
        return "".join(out) + text[free:]

    def batches(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if (t := c.as_py()) is None else masked(t) for c in part], pa.string())
        give_back()

    # only texts go to Python and back
    out = docs.withColumn("text", F.arrow_udf(batches, "string")(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
