"""Which strings hold which others, through postings of grams: each needle is looked for under its rarest gram only, then verified.

Postings and counts of grams compress so well that adaptive execution takes them for small and would broadcast them through the driver: their joins are merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram; a shorter needle is a gram of its own.
SIZE = 3


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` letters."""
    n = F.length(text) - size + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _postings(texts: DataFrame, keys: list[str], short: bool) -> DataFrame:
    """(keys, text, gram) of each text's grams of SIZE letters, or of fewer for needles that are shorter."""
    sizes = range(1, SIZE) if short else [SIZE]
    return texts.select(*keys, "text", F.explode(F.concat(*[grams(F.col("text"), k) for k in sizes])).alias("gram"))


def candidates(needles: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, needle, text): texts that hold the rarest gram of the needle. ``needles`` (keys, needle) and ``texts`` (keys, text) have distinct rows."""
    of_texts = _postings(texts, keys, False)
    counts = of_texts.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    long = needles.where(F.length("needle") >= SIZE).select(*keys, "needle", F.explode(grams(F.col("needle"), SIZE)).alias("gram"))
    # a gram that no text holds stands first: such a needle meets nothing
    rarest = long.join(counts.hint("merge"), [*keys, "gram"], "left").groupBy(*keys, "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    found = rarest.where("m.n > 0").select(*keys, "needle", F.col("m.gram").alias("gram")).join(of_texts.hint("merge"), [*keys, "gram"])
    short = needles.where(F.length("needle").between(1, SIZE - 1)).select(*keys, "needle", F.col("needle").alias("gram"))
    return found.unionByName(short.join(_postings(texts, keys, True).hint("merge"), [*keys, "gram"])).select(*keys, "needle", "text")


def holding(needles: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, needle, text): every text that holds a needle with equal keys. Empty and null needles and texts, and rows with a null key, meet nothing."""
    return candidates(needles, texts, keys).where(F.col("text").contains(F.col("needle")))
