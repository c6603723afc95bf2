"""Column functions over text: tokens, version tokens, release types, timestamps, string similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and constants below must equal what sources use.
#: A word of any script. ``\\w`` differs between engines on letters with accents, this doesn't.
WORD = r"[\p{L}\p{N}_]+"
#: Two to four numbers of up to four digits, parted by dots.
VERSION = r"\b\d{1,4}(?:\.\d{1,4}){1,3}\b"
#: A vulnerability identifier: four to seven digits at its end, not eight.
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"


def words(text: Column) -> Column:
    """The distinct lower-case words of a text; null and empty texts have none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def mentions(text: Column, pattern: str) -> Column:
    """Sorted distinct matches of a pattern, in upper case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def version_last(text: Column) -> Column:
    """The last version token of a text, null without one."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VERSION), F.lit(0)), F.lit(-1))


def release_type(version: Column) -> Column:
    """MAJOR, MINOR or PATCH by the zeros at a version's end; UNKNOWN without a version."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    rest_zero = F.forall(F.slice(parts, 2, 4), lambda x: x == 0)
    last_zero = F.try_element_at(parts, F.lit(-1)) == 0
    three = F.when(rest_zero, "MAJOR").when(last_zero, "MINOR").otherwise("PATCH")
    two = F.when(last_zero, "MAJOR").otherwise("MINOR")
    return F.when(version.isNull(), "UNKNOWN").when(F.size(parts) >= 3, three).otherwise(two)


def breaking_version(text: Column) -> Column:
    """Whether a text names a version x.0.0, or x.0 and no x.0.y; ``1.2.0`` counts, since it holds ``2.0``."""
    has = lambda p: F.coalesce(text, F.lit("")).rlike(p)
    return has(r"\b\d{1,2}\.0\.0\b") | (has(r"\b\d{1,2}\.0\b") & ~has(r"\b\d{1,2}\.0\.\d+\b"))


def timestamp(value: Column) -> Column:
    """Digits are epoch seconds (also ``20260211``); else ISO text, in UTC where it names no zone; else null."""
    return F.when(value.rlike("^[0-9]+$"), F.timestamp_seconds(value.try_cast("bigint"))).otherwise(F.try_to_timestamp(value))


def terms(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more, distinct."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def levenshtein_norm(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in lower case; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def _bigrams(x: Column) -> Column:
    plain = F.regexp_replace(x, r"\s+", "")
    return F.when(F.length(plain) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams, as a multiset, over all bigrams; equal strings 1, strings without bigrams 0."""
    x, y = _bigrams(a), _bigrams(b)
    held = lambda all_, g: F.size(F.filter(all_, lambda z: z == g))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(held(x, g), held(y, g)))
    every = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(every == 0, 0.0).otherwise(2.0 * both / every)


def squeezed(text: str) -> str:
    """Without white space, as ``\\s`` has it."""
    return text.translate(_SPACES)


_SPACES = dict.fromkeys(map(ord, " \t\n\x0b\f\r"))
#: Cells of a batch of string pairs that are compared at once.
_CELLS = 1 << 20


def _letters(texts: list[str]) -> np.ndarray:
    width = max(1, *map(len, texts))
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def _jaro(a: list[str], b: list[str]) -> np.ndarray:
    x, y = _letters(a), _letters(b)
    n, m = (np.array([len(t) for t in side], dtype=np.int64) for side in (a, b))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    at = np.arange(y.shape[1])[None, :]
    free, left = at < m[:, None], np.zeros(x.shape, dtype=bool)
    for i in range(x.shape[1]):  # each letter takes the first equal one in reach that is free
        fits = free & (y == x[:, i : i + 1]) & (np.abs(at - i) <= reach) & (i < n)[:, None]
        left[:, i] = fits.any(axis=1)
        rows = np.flatnonzero(left[:, i])
        free[rows, fits[rows].argmax(axis=1)] = False
    right = (at < m[:, None]) & ~free
    both = left.sum(axis=1)
    most = max(1, int(both.max(initial=0)))
    in_order = lambda letters, taken: np.take_along_axis(letters, np.argsort(~taken, axis=1, kind="stable"), axis=1)[:, :most]
    differ = (in_order(x, left) != in_order(y, right)) & (np.arange(most)[None, :] < both[:, None])
    k = np.maximum(both, 1)
    found = (both / np.maximum(n, 1) + both / np.maximum(m, 1) + (both - differ.sum(axis=1) / 2) / k) / 3
    return np.where([p == q for p, q in zip(a, b, strict=True)], 1.0, np.where(both > 0, found, 0.0))


def jaro_all(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of pairs of strings: pairs of like length are compared together, letter by letter."""
    out = np.zeros(len(a))
    longest = np.array([max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    order, begun = np.argsort(longest, kind="stable"), 0
    while begun < len(a):
        end = begun + 1
        while end < len(a) and (end + 1 - begun) * longest[order[end]] <= _CELLS:
            end += 1
        rows = order[begun:end]
        out[rows] = _jaro([a[i] for i in rows], [b[i] for i in rows])
        begun = end
    return out


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    return float(jaro_all([a], [b])[0])


def winkler_all(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler of pairs of strings in lower case."""
    x, y = a.tolist(), b.tolist()
    j = jaro_all(x, y)
    same = np.array([next((k for k, (p, q) in enumerate(zip(s[:4], t[:4])) if p != q), min(4, len(s), len(t))) for s, t in zip(x, y, strict=True)], dtype=np.float64)
    return j + 0.1 * same * (1 - j)


def dice_all(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Dice over bigrams of pairs of strings."""
    x, y = ([squeezed(t) for t in side] for side in (a, b))
    grams = [[t[i : i + 2] for t in side for i in range(len(t) - 1)] for side in (x, y)]
    of = [np.repeat(np.arange(len(side)), [max(0, len(t) - 1) for t in side]) for side in (x, y)]
    _, codes = np.unique(np.array(grams[0] + grams[1], dtype="U2"), return_inverse=True)
    kinds = int(codes.max(initial=0)) + 1
    (p, n), (q, m) = (np.unique(o * kinds + c, return_counts=True) for o, c in zip(of, (codes[: len(grams[0])], codes[len(grams[0]) :]), strict=True))
    held, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    both = np.bincount(held // kinds, weights=np.minimum(n[i], m[j]), minlength=len(x))
    every = np.array([max(0, len(s) - 1) + max(0, len(t) - 1) for s, t in zip(x, y, strict=True)])
    return np.where([s == t for s, t in zip(a, b, strict=True)], 1.0, 2 * both / np.maximum(every, 1))


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = winkler_all(a[known].str.lower(), b[known].str.lower())
    return pd.Series(out).astype(object).where(known, None).astype("Float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro plus a tenth of the rest for each of up to four shared first letters, whatever the Jaro value; lower-cased."""
    return F.pandas_udf(_jaro_winkler, "double")(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
