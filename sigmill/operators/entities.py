"""Questions about software: entities by a grammar of patterns and a dictionary, the primary one, intents and the prompt that they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V = r"(?:\s*[\d.]+)?"
_OS_V = r"(?:\s*\d+(?:\.\d+)*)?"
# Names of systems, software and devices, each group with how sure a match is.
OS = (
    rf"\b(windows{_OS_V}|win\s*\d+(?:\.\d+)*)\b", rf"\b(macos{_OS_V}|mac\s*os{_OS_V}|os\s*x{_OS_V})\b", rf"\b(ios{_OS_V})\b", rf"\b(ipados{_OS_V})\b", rf"\b(android{_OS_V})\b",
    r"\b(ubuntu\s*[\d.]*|debian\s*[\d.]*|fedora\s*[\d.]*|centos\s*[\d.]*)\b", r"\b(chrome\s*os|chromeos)\b", r"\b(linux\s*mint\s*[\d.]*)\b",
)
SOFTWARE = (
    rf"\b(firefox{_V})\b", rf"\b(chrome{_V}|chromium{_V})\b", rf"\b(safari{_V})\b", rf"\b(edge{_V})\b", r"\b(visual\s*studio\s*code|vs\s*code|vscode)\b",
    r"\b(microsoft\s*office|office\s*365|excel|word|outlook|powerpoint|teams)\b", r"\b(slack|discord|zoom|skype)\b", rf"\b(docker{_V}|kubernetes|k8s)\b", rf"\b(node\.?js{_V}|python{_V}|java{_V})\b",
    r"\b(photoshop|illustrator|premiere|lightroom)\b", r"\b(spotify|netflix|whatsapp|telegram|signal)\b", rf"\b(openssl{_V}|openssh{_V}|nginx{_V}|apache{_V})\b", rf"\b(linux\s*kernel|kernel{_V})\b",
    rf"\b(git{_V}|curl{_V}|bash{_V})\b", rf"\b(github{_V}|gitlab{_V}|bitbucket{_V})\b", rf"\b(npm{_V}|yarn{_V}|pip{_V}|gradle{_V}|maven{_V})\b",
    rf"\b(terraform{_V}|ansible{_V}|jenkins{_V}|prometheus{_V}|grafana{_V})\b", rf"\b(react{_V}|vue{_V}|angular{_V}|next\.?js{_V}|express{_V})\b",
    rf"\b(postgres(?:ql)?{_V}|mysql{_V}|mongodb{_V}|redis{_V}|sqlite{_V})\b",
)
DEVICE = (r"\b(ipad|iphone|macbook|imac)\b", r"\b(pixel\s*\d*|galaxy\s*\w*|surface\s*\w*)\b")
#: What a match of each pattern holds, one of these at least: looked for first, as a plain search takes far less than a pattern.
OS_HOLDS = (("win",), ("mac", "os"), ("ios",), ("ipados",), ("android",), ("ubuntu", "debian", "fedora", "centos"), ("chrome",), ("linux",))
SOFTWARE_HOLDS = (
    ("firefox",), ("chrom",), ("safari",), ("edge",), ("visual", "code"), ("office", "excel", "word", "outlook", "powerpoint", "teams"), ("slack", "discord", "zoom", "skype"), ("docker", "kubernetes", "k8s"),
    ("node", "python", "java"), ("photoshop", "illustrator", "premiere", "lightroom"), ("spotify", "netflix", "whatsapp", "telegram", "signal"), ("openss", "nginx", "apache"), ("kernel",), ("git", "curl", "bash"),
    ("github", "gitlab", "bitbucket"), ("npm", "yarn", "pip", "gradle", "maven"), ("terraform", "ansible", "jenkins", "prometheus", "grafana"), ("react", "vue", "angular", "next", "express"),
    ("postgres", "mysql", "mongodb", "redis", "sqlite"),
)
DEVICE_HOLDS = (("ipad", "iphone", "macbook", "imac"), ("pixel", "galaxy", "surface"))
HOLDS = dict(zip((*OS, *SOFTWARE, *DEVICE), (*OS_HOLDS, *SOFTWARE_HOLDS, *DEVICE_HOLDS), strict=True))
GROUPS = (("os", OS, 0.95), ("software", SOFTWARE, 0.92), ("device", DEVICE, 0.88))
VERSION = r"\b(?:(?:version|ver|v)\s*(\d+(?:\.\d+)*(?:\s*(?:beta|alpha|rc|dev|preview)\s*\d*)?)|(\d+\.\d+(?:\.\d+)*))\b"
DICTIONARY_SURE, NOUN_SURE = 0.95, 0.55
#: A word after an article or the like.
NOUN = r"(?:^|[^\p{L}\p{N}])(?:the|a|an|my|your|this|that|der|die|das|le|la|el)\s+([a-z][a-z0-9-]+)"
# The system of a device, in order.
DEVICE_OS = {"ipad": "ipados", "iphone": "ios", "macbook": "macos", "imac": "macos", "pixel": "android", "galaxy": "android", "surface": "windows"}
# Names under which software is listed.
LISTED = {"visual studio code": "vscode", "vs code": "vscode", "k8s": "kubernetes", "node js": "node", "nodejs": "node"}
# What a question is about.
ABOUT_CVE = r"\b(cves?[\s-]?\d*|vulnerabilit(y|ies)|exploit|zero.?day|advisor(y|ies))\b"
ABOUT_PATCH = r"\b(patch(es|ed)?|hotfix(es)?|hot.?fix(es)?|bug.?fix(es)?|security.?fix(es)?|security.?patch(es)?|security.?update)\b"
ABOUT_UPDATE = r"\b(update|upgrade|latest|new version|changelog)\b"
ABOUT_ALL = r"\b(all|every|each|list|show\s+all|show\s+every|give\s+(me\s+)?all|any)\b"


def _matches(low: Column, pattern: str) -> Column:
    """The matches of a pattern in a text in lower case, trimmed; the pattern is tried only where the text holds what each match does."""
    held = reduce(Column.__or__, [low.contains(x) for x in HOLDS[pattern]])
    found = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
    return F.when(held, found).otherwise(F.array().cast("array<string>"))


def _found(low: Column, group: str, patterns: tuple[str, ...], sure: float) -> Column:
    """Distinct names of one group in order of the patterns: array<struct<kind, name, sure>>."""
    each = F.concat(*[_matches(low, p) for p in patterns])
    return F.transform(F.array_distinct(each), lambda n: F.struct(F.lit(group).alias("kind"), n.alias("name"), F.lit(sure).alias("sure")))


def nouns(text: Column) -> Column:
    """Words that are taken for nouns, in lower case, where nothing better is known: those after a word that nouns follow. Our own rule, in place of a tagger."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(NOUN), F.lit(1)), lambda x: F.trim(x))


def entities(low: Column) -> Column:
    """The entities of a text in lower case by the grammar of patterns: systems, software, devices."""
    return F.concat(*[_found(low, k, p, s) for k, p, s in GROUPS])


def in_texts(texts: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """(key, kind, name, sure) of the entities of each text: those of the grammar; ``known`` (key, name), a dictionary name in the text, which joins the software and is surer than a
    pattern; and nouns of the text as software, if they have three letters or more, begin with one of a to z and are nothing else."""
    row = lambda source, kind, name, sure: F.struct(F.lit(source).alias("source"), kind.alias("kind"), name.alias("name"), sure.alias("sure"))
    low = texts.select(key, F.lower(text).alias("_low"))  # a column of its own, as each pattern reads it
    found = low.select(key, F.explode(entities(F.col("_low"))).alias("x")).select(key, row("grammar", F.col("x.kind"), F.col("x.name"), F.col("x.sure")).alias("x"))
    others = low.select(key, F.explode(F.array_distinct(nouns(F.col("_low")))).alias("n")).where((F.length("n") > 2) & F.col("n").rlike("^[a-z]"))
    rows = found.unionAll(others.select(key, row("noun", F.lit("software"), F.col("n"), F.lit(NOUN_SURE)).alias("x")))
    if known is not None:
        rows = rows.unionAll(known.select(key, row("list", F.lit("software"), F.lower("name"), F.lit(DICTIONARY_SURE)).alias("x")))
    once = rows.groupBy(key, F.col("x.name").alias("name")).agg(F.collect_set("x").alias("x"), F.max(F.when(F.col("x.source") == "list", F.col("x.sure"))).alias("listed"))
    of = lambda source: F.filter("x", lambda e: e["source"] == source)
    each = once.select(key, "name", "listed", F.explode(F.when(F.size(of("grammar")) > 0, of("grammar")).when(F.col("listed").isNotNull(), of("list")).otherwise(F.col("x"))).alias("e"))
    return each.select(key, "e.kind", "name", F.greatest("e.sure", "listed").alias("sure"))


def overall(found: Column) -> Column:
    """The mean of how sure the entities are, to two digits; 0 without any."""
    return F.when(F.size(found) > 0, F.round(F.aggregate(found, F.lit(0.0), lambda s, x: s + x["sure"]) / F.size(found), 2)).otherwise(0.0)


def plain_name(name: Column) -> Column:
    """Without a version at its end, in lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(name, r"\s*\d+(\.\d+)*\s*$", ""), r"\s+", " ")))


def primary(found: Column) -> Column:
    """(kind, name, sure) of the entity that a question is about: a system before software before a device (as its system); the surest, then the first."""
    best = lambda kind: F.aggregate(
        F.filter(found, lambda x: x["kind"] == kind), F.lit(None).cast("struct<kind: string, name: string, sure: double>"), lambda a, x: F.when(a.isNull() | (x["sure"] > a["sure"]), x).otherwise(a)
    )
    named = lambda kind: F.when(best(kind).isNotNull(), F.struct(F.lit(kind).alias("kind"), plain_name(best(kind)["name"]).alias("name"), best(kind)["sure"].alias("sure")))
    device = F.get(F.filter(found, lambda x: x["kind"] == "device"), 0)["name"]
    system = F.coalesce(*[F.when(device.contains(k), v) for k, v in DEVICE_OS.items()])
    return F.coalesce(named("os"), named("software"), F.when(system.isNotNull(), F.struct(F.lit("os").alias("kind"), system.alias("name"), F.lit(0.75).alias("sure"))))


def versions(text: Column) -> Column:
    """Version numbers that a question names: with a word for version before them, or with a dot."""
    all_ = lambda k: F.regexp_extract_all(F.lower(text), F.lit(VERSION), F.lit(k))
    return F.filter(F.transform(F.arrays_zip(all_(1).alias("a"), all_(2).alias("b")), lambda x: F.trim(F.when(x["a"] != "", x["a"]).otherwise(x["b"]))), lambda v: v != "")


def breaking(text: Column, kinds: tuple[tuple[str, str | None], ...]) -> Column:
    """The first of ``kinds`` (pattern, name) that a question matches: (at, name), null where none does."""
    return F.coalesce(*[F.when(F.lower(text).rlike(p), F.struct(F.lit(k).alias("at"), F.lit(n).cast("string").alias("name"))) for k, (p, n) in enumerate(kinds)])


def intent(text: Column, named: Column, failing: Column) -> Column:
    """cve before patch, failures, version and general. ``named``: version numbers of the question; ``failing``: whether it is about failures."""
    has = lambda p: F.lower(text).rlike(p)
    version = (F.size(named) > 0) | has(r"\bversion\b") | has(ABOUT_UPDATE)
    return F.when(has(ABOUT_CVE), "cve").when(has(ABOUT_PATCH), "patch").when(failing, "breaking").when(version, "version").otherwise("general")


def prompt(text: Column, name: Column, named: Column, kind: Column, label: Column, suffix: Column) -> Column:
    """The question in a fixed form, by what it is about; ``suffix`` names the dates."""
    # The sentences.
    has = lambda p: F.lower(text).rlike(p)
    about = ((F.size(named) > 0) | has(r"\bversion\b")) & (F.size(named) > 0)
    what = F.concat(F.lit('"'), F.coalesce(label, F.lit("failures")), F.lit('" releases for '), name, suffix)
    return (
        F.when(about, F.concat(F.lit("What's new in "), name, F.lit(" "), F.get(named, 0), F.lit("?")))
        .when(kind == "cve", F.concat(F.lit("What are the CVEs or security vulnerabilities for "), name, suffix, F.lit("?")))
        .when(kind == "patch", F.concat(F.lit("What patches are available for "), name, suffix, F.lit("?")))
        .when(kind == "breaking", F.when(has(ABOUT_ALL), F.concat(F.lit("List all "), what)).otherwise(F.concat(F.lit("What are the "), what, F.lit("?"))))
        .when(has(ABOUT_UPDATE), F.concat(F.lit("What's the latest version of "), name, suffix, F.lit("?")))
        .otherwise(F.concat(F.lit("Tell me about "), name, suffix))
    )


def post_prompt(name: Column, named: Column, about_cve: Column, about_update: Column) -> Column:
    """What a post asks, by its flags (null: no); ``named``: the version numbers in it."""
    # The sentences.
    return (
        F.when(F.size(named) > 0, F.concat(F.lit("What's new in "), name, F.lit(" "), F.get(named, 0), F.lit("?")))
        .when(about_cve, F.concat(F.lit("What are the latest security updates for "), name, F.lit("?")))
        .when(about_update, F.concat(F.lit("What's the latest update for "), name, F.lit("?")))
        .otherwise(F.concat(F.lit("Tell me about "), name, F.lit(" releases")))
    )


def canonical(asked: DataFrame, names: DataFrame, near: Column | None = None) -> DataFrame:
    """``asked`` (with a column entity) with its listed name: by LISTED, then by a name of ``names`` (name) that is equal without separators, then, for an entity with one of ".-_",
    by its first part (three letters or more), then by ``near``, a name in the question of about its length; null without any. Ties go to the longest, then the smallest name."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[\s.\-_]", "")
    part = lambda c: F.trim(F.split(F.lower(c), r"[.\-_]")[0])
    best = F.min(F.struct((-F.length("name")).alias("l"), "name"))["name"]
    by_key = names.groupBy(key(F.col("name")).alias("_key")).agg(best.alias("_by_key"))
    by_part = names.groupBy(part(F.col("name")).alias("_part")).agg(best.alias("_by_part"))
    e = F.col("entity")
    listed = F.coalesce(*[F.when(F.lower(e) == k, v) for k, v in LISTED.items()])
    split = e.rlike(r"[.\-_]") & (F.length(part(e)) >= 3) & (part(e) != F.lower(e))
    rows = asked.withColumn("_key", key(e)).withColumn("_part", F.when(split, part(e))).join(by_key, "_key", "left").join(by_part, "_part", "left")
    last = F.lit(None).cast("string")
    if near is not None:
        ratio = F.length(near) / F.greatest(F.length(e), F.lit(1))
        last = F.when((F.lower(near) != F.lower(e)) & ratio.between(0.6, 1.5), near)
    return rows.withColumn("canonical", F.coalesce(listed, "_by_key", F.when(F.col("_part").isNotNull(), F.coalesce("_by_part", "_part")), last)).drop("_key", "_part", "_by_key", "_by_part")
