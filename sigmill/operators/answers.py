"""Release entries: predicates, entries and passages of answers, ranking, gates and evidence.

Entries are frames with brand, name, number, channel, date (yyyymmdd), url, notes, is_cve, tags, search_tags, breaking, security.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators.records import TAG_CVE, identifier_of_url

# Words that a text about usability, and one about defects, holds; a repeated one counts twice.
USABILITY = ("usability", "user experience", "ux", "ui", "interface", "design", "intuitive", "confusing", "difficult", "hard to use", "user-friendly", "clunky", "awkward", "navigation")
DEFECTS = (
    "defect", "bug", "error", "issue", "problem", "broken", "crash", "glitch", "fault", "failure", "malfunction", "doesn't work", "not working", "broken", "fix", "fixing", "debug", "troubleshoot",
    "issue with", "problem with", "error message", "exception", "exception", "fail", "failed",
)


def text_of(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c.cast("string"), F.lit(""))


def day(date: Column) -> Column:
    """yyyymmdd with dashes; other lengths as they are, empty ones null."""
    d = text_of(date)
    return F.when(F.length(d) == 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(d)


def about_vulnerability(e: DataFrame) -> Column:
    """One of: flagged, a url of the national database, labelled, a tag about security, a search tag with an identifier."""
    any_ = lambda c, p: F.coalesce(F.exists(c, lambda t: t.rlike(p)), F.lit(False))
    return (
        F.coalesce(e["is_cve"], F.lit(False)) | F.coalesce(e["url"].contains("nvd.nist.gov"), F.lit(False)) | F.coalesce(F.array_contains(e["security"], "SECURITY"), F.lit(False))
        | any_(e["tags"], "(?i)security|vulnerability|cve") | any_(e["search_tags"], TAG_CVE)
    )


def about_failure(e: DataFrame, kind: str | None = None) -> Column:
    """Any failure, or the one named, whatever its case, among failures or search tags."""
    if kind is None:
        return F.coalesce(F.size(e["breaking"]) > 0, F.lit(False))
    has = lambda c: F.coalesce(F.exists(c, lambda t: F.lower(t) == kind.lower()), F.lit(False))
    return has(e["breaking"]) | has(e["search_tags"])


def on_dates(entries: DataFrame, kind: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """All entries, those of the newest date ("latest"), of one date ("exact") or of an inclusive range; missing dates are the oldest."""
    d = F.coalesce(F.col("date"), F.lit(""))
    if kind == "latest":
        newest = entries.agg(F.max(d).alias("_newest"))  # one row
        return entries.join(F.broadcast(newest), d == F.col("_newest")).drop("_newest")
    if kind == "exact":
        return entries.where(d == first)
    return entries.where(d.between(first, last)) if kind == "range" else entries


def answer(e: DataFrame, vulnerable: bool = False) -> list[Column]:
    """The columns of an answer's entry: number, name, date, url, and the identifier of its url for vulnerabilities."""
    out = [text_of(e["number"]).alias("version"), F.coalesce(text_of(e["brand"]), text_of(e["name"])).alias("name"), day(e["date"]).alias("date"), text_of(e["url"]).alias("url")]
    return out + ([F.coalesce(identifier_of_url(e["url"]), e["id"].cast("string")).alias("cve_id")] if vulnerable else [])


def passage(e: DataFrame, notes: int = 200, between: str = " — ") -> Column:
    """An entry in words; missing parts are left out."""
    number = F.when(text_of(e["number"]).isNotNull(), F.concat(F.lit("v"), e["number"]))
    return F.concat_ws(between, F.coalesce(text_of(e["brand"]), text_of(e["name"])), number, text_of(e["channel"]), F.when(e["is_cve"], "CVE security vulnerability"), text_of(F.substring(e["notes"], 1, notes)))


def phrases(e: DataFrame, software: Column, severity: Column) -> Column:
    """What an answer claims, in up to eight phrases of five letters or more."""
    said = lambda before, c, after="": F.when(text_of(c).isNotNull(), F.concat(F.lit(before), c, F.lit(after)))
    every = F.array(
        said("software ", software), said("version ", e["number"]), said("released ", e["date"]), said("", e["channel"], " release channel"), said("CVE identifier ", identifier_of_url(e["url"])),
        said("severity ", severity), text_of(F.substring(e["notes"], 1, 200)),
    )
    return F.slice(F.filter(every, lambda p: p.isNotNull() & (F.length(F.trim(p)) > 4)), 1, 8)


def sentences(text: Column) -> Column:
    """Parts of a text after ".", "!" or "?" and white space, of nine letters or more."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > 8)


def reranked(entries: DataFrame, key: str, order: Column, score: Column, first: int = 30) -> DataFrame:
    """``entries`` with their place within ``key``: the ``first`` ones in ``order`` by score, ties in order, the others behind them as they were."""
    rows = entries.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(order)))
    by = [F.when(F.col("_at") <= first, -score).otherwise(F.lit(float("inf"))), F.col("_at")]
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*by)).cast("long")).drop("_at")


def relevance(title: Column, context: Column, words: tuple[str, ...], others: tuple[str, ...]) -> Column:
    """Nine points for each word in the title, one for each in the context (texts of replies); none where the title has only other words."""
    low, around = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(context, F.lit("")))
    count = lambda c, every: sum((c.contains(k).cast("long") for k in every), F.lit(0).cast("long"))
    own = count(low, words)
    return F.when((own == 0) & (count(low, others) > 0), 0).otherwise(9 * own + count(around, words)).cast("long")


def context(replies: DataFrame, key: str, order: Column, author: Column, text: str, authors: int = 3, community: int = 5, cut: int = 200) -> DataFrame:
    """(key, context): the first texts of the author's side and of the others', each cut, in one text."""
    side = replies.withColumn("_side", F.when(author, 0).otherwise(1))
    rank = side.withColumn("_n", F.row_number().over(W.partitionBy(key, "_side").orderBy(order))).where((F.col("_n") <= authors) & (F.col("_side") == 0) | (F.col("_n") <= community) & (F.col("_side") == 1))
    rows = rank.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_side", "_n", F.substring(text, 1, cut).alias("t")))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("context"))


def topic(update_related: Column, any_intent: Column) -> tuple[Column, Column]:
    """(score, relevant) of a question without a model: 0.85 with an intent, else 0.6, at least 0.7 about updates."""
    score = F.greatest(F.when(any_intent, 0.85).otherwise(0.6), F.when(update_related, 0.7).otherwise(0.0))
    return score, update_related | (score >= 0.6)


def overridden(relevant: Column, sure: Column, rejected: Column, rejection: Column) -> Column:
    """A model's rejection holds unless the entity is sure (0.7) and the rejection isn't (below 0.85)."""
    return F.when(rejected & ~((sure >= 0.7) & (rejection < 0.85)), False).otherwise(relevant)


def aligned(asked: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, entries, decision): questions that found no entry abstain."""
    counts = entries.groupBy(key).agg(F.count(F.lit(1)).alias("entries"))
    out = asked.select(key).join(counts, key, "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    return out.withColumn("decision", F.when(F.col("entries") > 0, "confident").otherwise("abstain"))


def broad_composite(has_entries: Column) -> Column:
    """Questions without an entity pass one gate of half the weight."""
    return F.when(has_entries, 0.85 * 0.5 + 0.5).otherwise(0.0)


def resolved(references: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """``references`` (ref, "kind:number") with the row (idx, title) of their kind's source; null where there is none."""
    every = None
    for kind, rows in sources.items():
        one = rows.select(F.lit(kind).alias("_kind"), F.col("idx").cast("long").alias("_idx"), "title")
        every = one if every is None else every.unionAll(one)
    parts = F.split("ref", ":")
    asked = references.withColumn("_kind", F.get(parts, 0)).withColumn("_idx", F.get(parts, 1).try_cast("bigint"))
    return asked.join(every, ["_kind", "_idx"], "left").drop("_kind", "_idx")


def evidence_mix(references: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(kind, found, percent): how much each kind of reference weighs."""
    kind = F.get(F.split("ref", ":"), 0)
    weight = F.coalesce(*[F.when(F.col("kind") == k, w) for k, w in weights.items()], F.lit(0.0))
    counts = references.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("found")).withColumn("w", F.col("found") * weight)
    return counts.withColumn("percent", F.round(F.try_divide(100 * F.col("w"), F.sum("w").over(W.partitionBy(F.lit(1)))), 3)).drop("w")
