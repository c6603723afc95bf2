"""Names of a list in whole texts: every run of words of a text is looked up as it stands.

A text is cut at the letters that may stand around a name; a name of n words is found where n words and what stands between them are equal to it. So
each place of a text gives one key for each number of words that names have, names are met by equality whatever their number, and only what is found is shuffled. Letters that
cut words don't count at a name's ends. Null texts hold nothing; names shorter than LEAST are left out, and so are stop words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators.labels import sized

# The letters that may stand around a name, the shortest name, words that are no names in a question.
EDGE = r"\s,.()\[\]\"'!?;:/\\"
LEAST = 4
STOPS = (
    "version", "patch", "update", "issue", "issues", "failure", "failures", "error", "errors", "release", "releases", "latest", "newest", "current", "critical", "breaking", "network", "logging", "monitoring", "data",
    "configuration", "security", "dependency", "resource", "compatibility", "today", "yesterday", "month", "week",
)


def _words(text: Column) -> tuple[Column, Column]:
    """The words of a text, and what stands after each."""
    cut = lambda k: F.regexp_extract_all(text, F.lit(f"([^{EDGE}]+)([{EDGE}]*)"), F.lit(k))
    return cut(1), cut(2)


def listed(names: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """(name, key, words) of ``names`` (name): how a name is looked up, and how many words it has."""
    key = F.regexp_replace(F.lower("name"), f"^[{EDGE}]+|[{EDGE}]+$", "")
    rows = names.where(F.length(F.trim("name")) >= LEAST).select("name", key.alias("key")).distinct().where("key <> ''")
    return rows.where(~F.lower("name").isin(*stops)).withColumn("words", F.size(_words(F.col("key"))[0]))


def found(texts: DataFrame, key: str, text: str, names: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """(key, name): each name of ``names`` (name) that a row's text holds at word borders, once."""
    known = listed(names, stops)
    lengths = sorted(r.words for r in known.select("words").distinct().collect())  # a few numbers
    if not lengths:
        return texts.select(key, F.lit(None).cast("string").alias("name")).where("false")
    most = lengths[-1]
    rows = texts.select(F.col(key), F.lower(text).alias("_low"))
    rows = rows.select(key, *[c.alias(n) for c, n in zip(_words(F.col("_low")), ("_w", "_s"), strict=True)])
    shifted = [F.expr(f"slice({c}, {k + 1}, greatest(size({c}) - {k}, 0))").alias(f"{c}{k}") for k in range(most) for c in ("_w", "_s")]
    at = rows.select(key, F.explode(F.arrays_zip(*shifted)).alias("x"))
    # a run that ends with the text has no word in its later places, and so no key
    keys = {n: F.concat(*[p for k in range(n) for p in ([F.col(f"x._s{k - 1}")] if k else []) + [F.col(f"x._w{k}")]]) for n in lengths}
    each = at.select(key, F.explode(F.array_compact(F.array(*keys.values()))).alias("key_"))
    return each.join(sized(known.select("name", F.col("key").alias("key_"))), "key_").select(key, "name").distinct()


def longest(texts: DataFrame, key: str, text: str, names: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """(key, name): the longest name that a row's text holds at word borders, ties to the smallest; rows without one are left out."""
    best = F.min(F.struct((-F.length("name")).alias("l"), "name"))["name"]
    return found(texts, key, text, names, stops).groupBy(key).agg(best.alias("name"))
