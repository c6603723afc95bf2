"""Normalisation of nested records (JSON text): alias fields, string leaves, identifiers, timestamps, severities, vendors.

Records are frames with a text column of JSON; each operator adds columns, so a plan reads each record once. Broken JSON and null
give nulls or empty lists, as missing keys do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions import text as X

# The keys under which sources hold a field, the first present one counts.
ALIASES = {
    "title": ("title", "postTitle", "name"),
    "body": ("selftext", "body", "text", "content"),
    "url": ("url", "permalink", "link"),
    "subreddit": ("subreddit", "sub"),
    "author": ("author", "username", "user"),
    "score": ("score", "upvotes", "ups"),
    "post_id": ("id", "post_id", "postId", "redditId"),
}
# Keys of the times of a record, in order of preference.
CREATED = ("created_utc", "createdUtc", "created_at", "createdAt", "created", "timestamp", "timeCreated")
UPDATED = ("updatedAt", "updated_at", "lastUpdated", "last_updated", "modified", "modifiedAt")
# Patterns of identifiers in urls (any number of digits) and in tags.
URL_CVE, TAG_CVE = r"(?i)CVE-\d{4}-\d+", r"(?i)cve-?\d{4}"
# Score versions in order of preference.
SCORES = ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
# Words of a description that name a vendor.
VENDORS = {
    "apple": "Apple", "google": "Google", "microsoft": "Microsoft", "linux": "Linux", "docker": "Docker", "mozilla": "Mozilla", "apache": "Apache", "nginx": "nginx", "oracle": "Oracle",
    "ibm": "IBM", "cisco": "Cisco", "intel": "Intel", "amd": "AMD", "nvidia": "NVIDIA", "redhat": "Red Hat", "ubuntu": "Ubuntu", "debian": "Debian", "fedora": "Fedora", "amazon": "Amazon",
    "cloudflare": "Cloudflare", "kubernetes": "Kubernetes", "nodejs": "Node.js", "python": "Python", "golang": "Go", "gitlab": "GitLab", "github": "GitHub", "jetbrains": "JetBrains",
    "wordpress": "WordPress", "joomla": "Joomla", "drupal": "Drupal",
}
#: Levels of a record that are searched for text.
DEPTH = 6


def field(record: Column, key: str) -> Column:
    return F.get_json_object(record, f"$.{key}")


def alias(record: Column, name: str) -> Column:
    """The first key of ALIASES that isn't null; empty where there is none, but for score, which stays null."""
    found = F.coalesce(*[field(record, k) for k in ALIASES[name]])
    return found if name == "score" else F.coalesce(found, F.lit(""))


def _leaves(text: str | None) -> list[dict]:
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return []
    out, todo = [], [("", root, 0)]
    while todo:
        path, value, depth = todo.pop()
        if isinstance(value, str):
            out.append({"path": path or "<root>", "value": value})
        elif depth < DEPTH and isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v, depth + 1) for k, v in reversed(value.items())]
        elif depth < DEPTH and isinstance(value, list):
            todo += [(f"{path}[{k}]", v, depth + 1) for k, v in reversed(list(enumerate(value)))]
    return out


def _leaves_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
    for part in parts:
        yield pa.array([_leaves(c.as_py()) for c in part], kind)


def string_leaves(record: Column) -> Column:
    """Every text in a record down to DEPTH levels, with its path (``a.b[0].c``; ``<root>`` for a record that is a text), in order of the record."""
    return F.arrow_udf(_leaves_of, "array<struct<path: string, value: string>>")(record)


def identifiers(leaves: Column) -> tuple[Column, Column]:
    """The sorted distinct identifiers in the leaves, in upper case, and the sorted distinct paths that hold one."""
    found = F.flatten(F.transform(leaves, lambda x: F.regexp_extract_all(x["value"], F.lit(X.CVE), F.lit(0))))
    paths = F.transform(F.filter(leaves, lambda x: x["value"].rlike(X.CVE)), lambda x: x["path"])
    return F.array_sort(F.array_distinct(F.transform(found, F.upper))), F.array_sort(F.array_distinct(paths))


def identifier_of_url(url: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(url, URL_CVE, 0), F.lit("")))


def tagged(tags: Column) -> Column:
    """Whether a list of tags has one that names an identifier; false for null."""
    return F.coalesce(F.exists(tags, lambda t: t.rlike(TAG_CVE)), F.lit(False))


def _picked(record: Column, keys: tuple[str, ...]) -> Column:
    """(field, at) of the first key whose value is a time."""
    at = lambda k: X.timestamp(F.trim(field(record, k)))
    return F.coalesce(*[F.when(at(k).isNotNull(), F.struct(F.lit(k).alias("field"), at(k).alias("at"))) for k in keys])


def created(record: Column) -> Column:
    """(field, at) by the preferred keys, else by the first other key with "created" in its name whose value is a time."""
    named = F.filter(F.json_object_keys(record), lambda k: F.lower(k).contains("created"))
    others = F.from_json(record, "map<string, string>")
    tried = F.transform(named, lambda k: F.struct(k.alias("field"), X.timestamp(F.trim(F.try_element_at(others, k))).alias("at")))
    return F.coalesce(_picked(record, CREATED), F.try_element_at(F.filter(tried, lambda x: x["at"].isNotNull()), F.lit(1)))


def updated(record: Column) -> Column:
    return _picked(record, UPDATED)


def iso(at: Column) -> Column:
    """UTC time as ISO text with offset, microseconds only where there are some."""
    part = F.when(F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, "'.'SSSSSS")).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def normalised(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with the sixteen columns of a normal row; times that are missing are empty texts and null epochs."""
    r = F.col(record)
    out = records.withColumn("_leaves", string_leaves(r)).withColumn("_c", created(r)).withColumn("_u", updated(r))
    cves, paths = identifiers(F.col("_leaves"))
    times = [c for n, s in (("created", "_c"), ("updated", "_u")) for c in (
        F.coalesce(F.col(f"{s}.field"), F.lit("")).alias(f"{n}_field"), F.coalesce(iso(F.col(f"{s}.at")), F.lit("")).alias(f"{n}_iso_utc"), F.floor(F.unix_micros(f"{s}.at") / 1_000_000).alias(f"{n}_epoch"))]
    return out.select(*records.columns, *[alias(r, n).alias(n) for n in ("post_id", "subreddit", "author", "score", "title", "body", "url")],
                      F.array_join(cves, ";").alias("cves"), F.size(cves).alias("cve_count"), F.array_join(paths, ";").alias("cve_paths"), *times)


def audit(normal: DataFrame) -> DataFrame:
    """Rows with identifiers: title and paths cut for display."""
    return normal.where("cve_count > 0").select("post_id", "subreddit", "created_iso_utc", F.substring("title", 1, 140).alias("title"), "cves", F.substring("cve_paths", 1, 320).alias("cve_paths"), "url")


def cvss(entry: Column) -> tuple[Column, Column, Column]:
    """(score, severity, vector) of the first metric of the preferred version, as texts; empty where missing."""
    first = F.coalesce(*[F.get_json_object(entry, f"$.metrics.{k}[0]") for k in SCORES])
    data = lambda k: F.get_json_object(first, f"$.cvssData.{k}")
    severity = F.coalesce(F.nullif(data("baseSeverity"), F.lit("")), F.get_json_object(first, "$.baseSeverity"))
    return tuple(F.coalesce(c, F.lit("")) for c in (data("baseScore"), severity, data("vectorString")))


#: The part of an entry that vendors are read from.
CONFIGURATIONS = "array<struct<nodes: array<struct<cpeMatch: array<struct<criteria: string>>>>>>"


def vendors(configurations: Column, description: Column) -> Column:
    """The sorted vendors of the product names of a record, joined by semicolons; without any, those that its description names."""
    nodes = F.flatten(F.transform(configurations, lambda c: F.coalesce(c["nodes"], F.array())))
    matches = F.flatten(F.transform(nodes, lambda n: F.coalesce(n["cpeMatch"], F.array())))
    named = F.transform(matches, lambda m: F.try_element_at(F.split(m["criteria"], ":"), F.lit(4)))
    named = F.coalesce(F.array_sort(F.array_distinct(F.filter(named, lambda v: ~v.isin("", "*", "-")))), F.array().cast("array<string>"))
    low = F.lower(F.coalesce(description, F.lit("")))
    words = F.filter(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in VENDORS.items()]), lambda v: v.isNotNull())
    return F.array_join(F.when(F.size(named) > 0, named).otherwise(F.array_sort(words)), ";")
