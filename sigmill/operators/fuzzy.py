"""Fuzzy matching of names against a list, by filter and verification.

A name's score against a query is 1 if they are equal without case, else 0.6 Jaro-Winkler + 0.4 Dice over bigrams. Each query's best KEPT names are found without
comparing it with all names:

1. Probe: some names that share most of the query's rarest pieces of three letters are scored; the last of the best KEPT is a bound that every result must reach.
2. Filter: from this bound, and Jaro-Winkler being 1 at most, follows how many bigrams a name must share. A name that shares none of the
   query's rarest bigrams, but for the number that it may lack, can't be a result. Names that share one are candidates; lengths and the true number of shared bigrams bound
   their scores from above, and only those that can reach the bound are scored.
3. Where the bound says nothing (0.6 or less, from Dice alone), the query goes against all names in blocks: letters and bigrams that two names share bound their
   score, and only pairs that can reach the best so far are scored.

Scores are compared as rounded to four digits, ties go by name. Null names and queries are left out, empty ones are names like others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.operators import blocks as B
from sigmill.operators import substring as S

KEPT = 3
#: Pieces of a query that are probed, names of each, and names that are scored for a bound: results don't depend on them.
PROBED, NAMES, TRIED = 6, 400, 24
#: Names and queries of a block in which nothing is known of the scores.
ROWS, QUERIES = 4000, 250
ROUNDING = 1e-4


def _with_tokens(df: DataFrame, low: str) -> DataFrame:
    """``df`` with tokens, the bigrams of a string without white space, as a set: the second one of a kind is another token; and size, their number."""
    rows = df.withColumn("_plain", F.regexp_replace(low, r"\s+", "")).withColumn("size", F.greatest(F.length("_plain") - 1, F.lit(0)))
    rows = rows.withColumn("_each", F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(1), F.greatest("size", F.lit(1))), lambda i: F.substring("_plain", i, F.lit(2)))).otherwise(F.array().cast("array<string>")))
    numbered = F.transform("_each", lambda x, i: F.concat(x, F.size(F.filter(F.slice("_each", F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    return rows.withColumn("tokens", numbered).drop("_plain", "_each")


def scores(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of pairs of strings in lower case."""
    found = 0.6 * X.winkler_all(a, b) + 0.4 * X.dice_all(a, b)
    # halves go up, and what is a half but for the last binary digits too
    return pd.Series(np.where((a == b).to_numpy(), 1.0, np.floor(found * 1e4 + 0.5 + 1e-8) / 1e4))


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.pandas_udf(scores, "double")("low", "other"))


def _most(low: Column, other: Column, shared: Column, size: Column, others: Column) -> Column:
    """What two strings can score at most, by their lengths, first letters and shared bigrams."""
    short, long = F.least(F.length(low), F.length(other)), F.greatest(F.length(low), F.length(other))
    jaro = F.when(long == 0, 1.0).otherwise((2 + short / F.greatest(long, F.lit(1))) / 3)
    same = sum((F.when((short >= k) & (F.substring(low, 1, k) == F.substring(other, 1, k)), 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    return 0.6 * (jaro + 0.1 * same * (1 - jaro)) + 0.4 * F.when(size + others > 0, 2 * shared / (size + others)).otherwise(0.0)


def _best(scored: DataFrame) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEPT)


def candidates(queries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left to score: (query, low, name, other) of pairs that may be among the best, and (query, low, bound) of queries whose bound says nothing.
    ``queries`` (query, low) and ``names`` (name, other) have distinct rows."""
    known = _with_tokens(_bounded(queries, names), "low")
    # Dice is d at least, so of the query's bigrams a name shares d / (2 - d) at least
    d = (F.col("bound") - ROUNDING - 0.6) / 0.4
    known = known.withColumn("d", d).withColumn("least", F.when((d > 0) & (F.col("size") > 0), F.greatest(F.ceil(d * F.col("size") / (2 - d) - 1e-9), F.lit(1))))
    listed = _with_tokens(names, "other").withColumnRenamed("size", "others")
    postings = listed.select("name", "others", F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = known.where("least is not null").select("query", "d", "size", "least", F.explode("tokens").alias("token")).join(counts, "token", "left")
    prefix = each.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "token"))).where(F.col("place") <= F.col("size") - F.col("least") + 1)
    # all bigrams of the shorter may be shared; then those that are among the prefix, and the rest of the query's
    met = prefix.join(postings, "token").where((F.col("query") != F.col("name")) & (2 * F.least("size", "others") >= F.col("d") * (F.col("size") + F.col("others")) - 1e-9))
    met = met.groupBy("query", "name").agg(F.count(F.lit(1)).alias("held"), F.first("others").alias("others"))
    met = met.join(known.where("least is not null").select("query", "low", "bound", "d", "size", "least", "tokens"), "query")
    shared = F.least(F.col("held") + F.col("least") - 1, "size", "others")
    met = met.where(2 * shared >= F.col("d") * (F.col("size") + F.col("others")) - 1e-9).join(listed.select("name", "other", F.col("tokens").alias("b")), "name")
    met = met.withColumn("shared", F.size(F.array_intersect("tokens", "b")))
    may = met.where(_most(F.col("low"), F.col("other"), F.col("shared"), F.col("size"), F.col("others")) >= F.col("bound") - ROUNDING)
    return may.select("query", "low", "name", "other"), known.where("least is null").select("query", "low", "bound")


def _bounded(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``queries`` with what the last of KEPT names scores that share most of a query's rarest pieces; 0 where there aren't as many."""
    postings = names.select("name", "other", F.explode(S.grams(F.col("other"), S.SIZE)).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = queries.select("query", "low", F.explode(S.grams(F.col("low"), S.SIZE)).alias("gram")).join(counts, "gram")
    rarest = rarest.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("n", "gram"))).where(F.col("place") <= PROBED)
    some = postings.withColumn("k", F.row_number().over(W.partitionBy("gram").orderBy("name"))).where(F.col("k") <= NAMES)
    met = rarest.join(some, "gram").where("name <> query").groupBy("query", "low", "name", "other").agg(F.count(F.lit(1)).alias("held"))
    tried = met.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("held"), F.abs(F.length("low") - F.length("other")), "name"))).where(F.col("k") <= TRIED)
    bound = _best(_scored(tried)).groupBy("query").agg(F.when(F.count(F.lit(1)) == KEPT, F.min("score")).otherwise(0.0).alias("bound"))
    return queries.join(bound, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))


def _letters(texts: pd.Series, alphabet: dict[str, int], size: int) -> np.ndarray:
    """How often each string holds each piece of ``size`` letters, white space left out of longer pieces; pieces beyond ``alphabet`` are left out."""
    out = np.zeros((len(texts), len(alphabet)), dtype=np.float32)
    for i, t in enumerate(texts):
        t = t if size == 1 else X.squeezed(t)
        for k in range(len(t) - size + 1):
            at = alphabet.get(t[k : k + size])
            if at is not None:
                out[i, at] += 1
    return out


def _shared(a: pd.Series, b: pd.Series, size: int) -> np.ndarray:
    """For all pairs, how many pieces of ``size`` letters two strings share, repeats counted."""
    cut = lambda t: t if size == 1 else X.squeezed(t)
    alphabet = {x: k for k, x in enumerate(sorted({cut(t)[k : k + size] for t in a for k in range(len(cut(t)) - size + 1)}))}
    x, y = _letters(a, alphabet, size), _letters(b, alphabet, size)
    # the smaller of two counts: the sum over levels of both counts reaching the level
    out, level = np.zeros((len(a), len(b)), dtype=np.float32), 1
    while (x >= level).any() and (y >= level).any():
        out += (x >= level).astype(np.float32) @ (y >= level).astype(np.float32).T
        level += 1
    return out


def block_best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """The best KEPT names of a block for each query (query, low, bound): bounds first, then scores in order of the bounds until no other can reach the best."""
    if not len(q) or not len(r):
        return pd.DataFrame({"query": pd.Series(dtype=str), "name": pd.Series(dtype=str), "score": pd.Series(dtype=float)})
    lengths = lambda s: s.str.len().to_numpy(dtype=np.float64)
    pieces = lambda s: np.array([max(0, len(X.squeezed(t)) - 1) for t in s], dtype=np.float64)
    la, lb, ga, gb = lengths(q["low"])[:, None], lengths(r["other"])[None, :], pieces(q["low"])[:, None], pieces(r["other"])[None, :]
    letters = _shared(q["low"], r["other"], 1)
    jaro = np.where(letters > 0, (letters / np.maximum(la, 1) + letters / np.maximum(lb, 1) + 1) / 3, 0.0)
    heads = [s.str.slice(0, 4).str.ljust(4, "\0").to_numpy() for s in (q["low"], r["other"])]
    same, going = np.zeros_like(jaro), np.ones(jaro.shape, dtype=bool)
    for k in range(4):
        x, y = (np.array([ord(h[k]) for h in side]) for side in heads)
        going &= (x[:, None] == y[None, :]) & (x[:, None] > 0)
        same += going
    dice = 2 * _shared(q["low"], r["other"], 2) / np.maximum(ga + gb, 1)
    most = 0.6 * (jaro + 0.1 * same * (1 - jaro)) + 0.4 * dice
    equal = q["low"].to_numpy()[:, None] == r["other"].to_numpy()[None, :]
    most[equal] = 1.0
    most[q["query"].to_numpy()[:, None] == r["name"].to_numpy()[None, :]] = -1.0
    out = []
    order = np.argsort(-most, axis=1, kind="stable")
    reach = q["bound"].to_numpy(dtype=np.float64) - ROUNDING
    open_, at, found = np.arange(len(q)), 0, {k: [] for k in range(len(q))}
    while len(open_) and at < len(r):
        columns = order[open_, at : at + 16]
        rows = np.repeat(open_, columns.shape[1])
        ok = most[rows, columns.ravel()] >= np.maximum(reach[rows], 0)
        rows, cols = rows[ok], columns.ravel()[ok]
        got = scores(q["low"].iloc[rows].reset_index(drop=True), r["other"].iloc[cols].reset_index(drop=True)).to_numpy()
        for i, c, s in zip(rows.tolist(), cols.tolist(), got.tolist(), strict=True):
            found[i].append((-s, r["name"].iat[c]))
        for i in set(rows.tolist()):
            found[i] = sorted(found[i])[:KEPT]
            if len(found[i]) == KEPT:
                reach[i] = max(reach[i], -found[i][-1][0] - ROUNDING)
        at += columns.shape[1]
        open_ = np.array([i for i in open_ if at < len(r) and most[i, order[i, at]] >= max(reach[i], 0)], dtype=np.int64)
    for i, best in found.items():
        out += [(q["query"].iat[i], name, -s) for s, name in best]
    return pd.DataFrame(out, columns=["query", "name", "score"])


def nearest(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name, score, rank) of each query's KEPT best names."""
    asked = queries.where("query is not null").select("query", F.lower("query").alias("low")).distinct()
    listed = names.where("name is not null").select("name", F.lower("name").alias("other")).distinct()
    if listed.limit(ROWS + 1).count() <= ROWS:  # one block of names: nothing to filter
        alone = asked.withColumn("bound", F.lit(0.0))
        return _best(B.against(listed, alone, "name", "query", block_best, "query string, name string, score double", ROWS, QUERIES))
    pairs, unknown = candidates(asked, listed)
    rest = B.against(listed, unknown, "name", "query", block_best, "query string, name string, score double", ROWS, QUERIES)
    return _best(_scored(pairs).select("query", "name", "score").unionAll(rest))


def _held(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, held, one): how many other names hold a query or are held by it, and the first of them."""
    asked, listed = (df.where(f"{c} is not null").select(c, F.lower(c).alias("low")).distinct() for df, c in ((queries, "query"), (names, "name")))
    every = lambda df, c: df.select(F.lit(0).alias("k"), F.col("low").alias(c)).distinct()
    up = S.holding(every(asked, "needle"), every(listed, "text"), ["k"]).select(F.col("needle").alias("a"), F.col("text").alias("b"))
    down = S.holding(every(listed, "needle"), every(asked, "text"), ["k"]).select(F.col("text").alias("a"), F.col("needle").alias("b"))
    # an empty string is held by every other: two names say enough
    some = listed.orderBy("name").limit(3)
    meet = lambda a, b: a.select("query", F.lit(0).alias("k")).join(F.broadcast(b.select("name", F.lit(0).alias("k"))), "k").select("query", "name")
    blanks = meet(asked.where("low = ''"), some).unionAll(meet(asked, listed.where("low = ''").limit(2)))
    held = asked.join(up.unionAll(down).distinct(), F.col("low") == F.col("a")).select("query", "b").join(listed.select("name", F.col("low").alias("b")), "b").select("query", "name")
    pairs = held.unionAll(blanks).where("name <> query").distinct()
    return pairs.groupBy("query").agg(F.count(F.lit(1)).alias("held"), F.min("name").alias("one"))


def fuzzy(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, best, score, match, suggestions) of each query (query) among ``names`` (name), its own spelling left out: equal without case 1, the only name that contains the query
    or is contained 0.95, else 0.6 Jaro-Winkler + 0.4 Dice. Match: "match" from 0.9, "partial" from 0.6, else "none"; suggestions: the three best names, "name:score", if there is no match."""
    found = nearest(queries, names).groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "name"))).alias("found"))
    rows = found.join(_held(queries, names), "query", "left").withColumn("best", F.col("found")[0]["name"]).withColumn("score", -F.col("found")[0]["s"])
    only = (F.col("score") < 1) & (F.coalesce("held", F.lit(0)) == 1)
    rows = rows.withColumn("best", F.when(only, F.col("one")).otherwise(F.col("best"))).withColumn("score", F.when(only, 0.95).otherwise(F.col("score")))
    match = F.when(F.col("score") >= 0.9, "match").when(F.col("score") >= 0.6, "partial").otherwise("none")
    near = F.filter(F.col("found"), lambda x: (F.col("score") < 0.6) | (-x["s"] >= 0.5))
    shown = F.transform(near, lambda x: F.concat(x["name"], F.lit(":"), F.format_number(-x["s"], 2)))
    return rows.select("query", F.when(F.col("score") >= 0.6, F.col("best")).alias("best"), F.round("score", 4).alias("score"), match.alias("match"), F.when(F.col("score") >= 0.9, "").otherwise(F.array_join(shown, ";")).alias("suggestions"))
