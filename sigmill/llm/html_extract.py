"""HTML extraction by wrapper induction.

1. A page becomes a tree of elements, and this a tree of blocks: inline elements belong to the block around them. The page's
   segments are what stands between block borders. Runs of like siblings (tag, class, id) are one node of a template.
2. For each host, PAGES_FIT different pages (those whose hashes are smallest) are aligned by simple tree matching, one
   after the other; nodes that the template lacks are inserted where they stand. This tree is the host's wrapper.
3. Every page is aligned with its host's wrapper. Each segment has a place (the matched node; where none matches, the path of
   labels), and Spark counts over all pages of the host in how many different pages a place holds a text. A text
   that at least half of them hold (at least three of them in an article or main element, else two) is a constant of the template.
   Copies count once. Where constants would take more than MOST_CONSTANT of a host's words, its pages may be near copies of each other:
   then pages count as different by a minimum hash of their longest segment's words, which near copies mostly share.
4. What varies is content, constants are not. Markup breaks ties: elements that are no article text by their tag
   (menus, forms, footers, ...) or hidden are left out; an article or main element, where there is one, holds the content; class words
   (ZONE_WORDS as the head of a class name) leave an element out unless nothing else varies.

Null and empty html give empty text. Pages without a host (null or odd url) form a group of their own. Repeated rows give
equal results. A host with one page, or only copies of one, has no constants. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.shared import slices, table, written

#: Pages of a host from which its wrapper is induced; the constants come from all pages.
PAGES_FIT = 8
#: Bytes of wrappers and constants up to which they are broadcast; more are joined by shuffle.
MOST_BYTES = 64 << 20
#: Share of a host's words from which on its pages may be near copies.
MOST_CONSTANT = 0.6
#: Pages (16 bytes each) up to which the choice of pages to fit from is broadcast.
MOST_CHOSEN = 500_000
#: Children times children up to which two nodes' children are aligned by the weight of what matches below; beyond it, by their labels alone.
MOST_CELLS = 250_000

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select option".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ZONES = frozenset("nav header footer aside form menu button dialog head".split())
CLOSES_P = BLOCKS - {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of a class, id or role that mark a zone outside the article.
ZONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert modal popup overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo related recommended share sharing social "
    "comment comments reply replies respond discussion disqus subscribe newsletter signup login search form toolbar pagination pager skip".split()
)
# Words after a zone word that leave it the head of a name ("ad-slot", "comment-list").
PARTS = frozenset(
    "area bar block body bottom box button buttons card cards col column container content control controls group inner item items label left line link links list main outer panel "
    "primary right row secondary section slot strip text thread title tools top unit widget wrap wrapper".split()
)
# Words before "header" or "title" that make it the article's own.
OWN_WORDS = frozenset("article content entry page post story".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|</\s*([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
DEEP = 1_000_000  # calls: deep pages are aligned by recursion, which Python keeps off the machine's stack


class Node:
    __slots__ = ("tag", "zone", "weak", "items", "label")

    def __init__(self, tag: str, zone: bool, weak: str, label: str) -> None:
        self.tag, self.zone, self.weak, self.label = tag, zone, weak, label
        self.items: list = []  # texts and nodes, in order


def zone_word(name: str) -> str:
    """The zone word that heads a class name; empty where there is none."""
    words = [w.lower() for w in re.split(r"[-_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name)) if w]
    while len(words) > 1 and words[-1] not in ZONE_WORDS and (words[-1] in PARTS or words[-1].isdigit()):
        words.pop()
    if not words or words[-1] not in ZONE_WORDS or words[-1] == "header" and any(w in OWN_WORDS for w in words):
        return ""
    return words[-1]


@lru_cache(maxsize=5000)
def _marks(tag: str, attributes: str) -> tuple[str, bool, str]:
    """An element's label for matching, whether its tag sets it outside the article, and the zone word of its names."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in MARKS.finditer(attributes)}
    weak = "" if tag in ("body", "html", "article", "main") and "comment" not in attributes else next((w for v in found.values() for x in v.split() if (w := zone_word(x))), "")
    name = re.sub(r"[0-9]+", "0", f"{found.get('class', '')}#{found.get('id', '')}")
    return f"{tag}.{name}", tag in ZONES or bool(HIDDEN.search(attributes)), weak


def parse(text: str) -> Node:
    """The tree of a page; unclosed elements are closed as browsers do for paragraphs, items, rows and cells."""
    root = Node("#", False, "", "#")
    open_: list[Node] = [root]
    held: Counter = Counter()  # open elements by tag
    at, size = 0, len(text)

    def cut(k: int) -> None:
        held.subtract(x.tag for x in open_[k:])
        del open_[k:]

    while at < size:
        m = TOKEN.search(text, at)
        if not m:
            open_[-1].items.append(text[at:])
            break
        if m.start() > at:
            open_[-1].items.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(open_) - 1, 0, -1) if held[tag] else ():
                if open_[k].tag == tag:
                    cut(k)
                    break
                if tag not in BLOCKS and open_[k].tag in BLOCKS:  # a stray inline end tag closes no block
                    break
        elif m[2]:
            tag, attributes = m[2].lower(), m[3]
            if tag in RAW:
                end = re.compile(rf"</\s*{re.escape(tag)}\s*>", re.I).search(text, at)
                at = end.end() if end else size
                continue
            if tag in CLOSES_P and held["p"]:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag == "p":
                        cut(k)
                        break
                    if open_[k].tag in BLOCKS:
                        break
            if tag in ("li", "tr", "td", "th", "dt", "dd"):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag == tag or tag == "tr" and open_[k].tag in ("td", "th") or {tag, open_[k].tag} in ({"dt", "dd"}, {"td", "th"}):
                        cut(k)
                        if tag != "tr" or not any(x.tag == "tr" for x in open_[-3:]):
                            break
                    elif open_[k].tag in ("ul", "ol", "table", "dl"):
                        break
            label, zone, weak = _marks(tag, attributes)
            node = Node(tag, zone, weak, label)
            open_[-1].items.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                open_.append(node)
                held[tag] += 1
    return root


def _lengths(root: Node) -> dict[int, int]:
    """The length of the text below each element outside of zones, by id()."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.items if not isinstance(x, str) and not (x.zone or x.weak)]
    out: dict[int, int] = {}
    for node in reversed(order):
        out[id(node)] = sum([len(x) if isinstance(x, str) else out.get(id(x), 0) for x in node.items])
    return out


def _article(root: Node) -> Node | None:
    """The article or main element with the most text, outside of zones; of a main element, the article that holds most of it."""
    lengths = _lengths(root)
    top, within = None, root
    while True:
        found, todo = [], [within]
        while todo:
            for x in todo.pop().items:
                if not isinstance(x, str) and id(x) in lengths:
                    (found if x.tag in ("article", "main") else todo).append(x)
        best = max(found, key=lambda x: lengths[id(x)], default=None)
        if best is None or top is not None and 2 * lengths[id(best)] < lengths[id(top)]:
            return top
        top = within = best
        if top.tag == "article":
            return top


class Block:
    """A node of the tree that is aligned."""

    __slots__ = ("label", "kids", "place")

    def __init__(self, label: str) -> None:
        self.label, self.kids, self.place = label, [], 0


def outline(root: Node) -> tuple[Block, list[tuple[Block, str, str]], bool]:
    """The page's blocks, its segments (block, text, zone word) in page order, and whether they are those of an article or main element."""
    top = _article(root)
    tree, segments, held = Block("#"), [], []

    def close(block: Block, weak: str) -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            segments.append((block, text, weak))

    # (items left, block, within the article, only headings count, zone word, whether it ends a block)
    open_ = [(iter(root.items), tree, top is None, False, "", True)]
    while open_:
        items, block, within, only, weak, ends = open_[-1]
        for x in items:
            if isinstance(x, str):
                if within and not only:
                    held.append(x)
            elif x.tag == "br":
                held.append(" ")
            elif not x.zone or x.tag == "header" and within and top is not None:
                inner = (within or x is top, x.zone or only and x.tag not in HEADINGS, weak or x.weak)
                if x.tag in BLOCKS or inner[2] != weak:
                    close(block, weak)
                    new = Block(x.label)
                    block.kids.append(new)
                    open_.append((iter(x.items), new, *inner, True))
                else:
                    open_.append((iter(x.items), block, *inner, False))
                break
        else:
            open_.pop()
            if ends:
                close(block, weak)
    return tree, segments, top is not None


def _runs(kids: list[Block]) -> list[list[Block]]:
    return [list(g) for _, g in groupby(kids, key=lambda x: x.label)]


def weight(t: Block, p: Block, known: dict) -> int:
    """Simple tree matching: the number of nodes in the best match of two trees whose roots match, children in order; a run of like siblings is one node."""
    if t.label != p.label:
        return 0
    key = (id(t), id(p))
    if key not in known:
        known[key] = 1 + _best(t.kids, _runs(p.kids), known)[0]
    return known[key]


def _best(kids: list[Block], runs: list[list[Block]], known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The weight of the best alignment of a template's children with a page's runs, and what matches."""
    mine, theirs = [t.label for t in kids], [r[0].label for r in runs]
    if len(mine) * len(theirs) > MOST_CELLS:
        spots: dict[str, list[int]] = {}
        for k, label in enumerate(mine):
            spots.setdefault(label, []).append(k)
        pairs, free = [], 0
        for j, label in enumerate(theirs):
            own = spots.get(label, ())
            k = bisect_left(own, free) if own else 0
            if k < len(own):
                pairs.append((own[k], j))
                free = own[k] + 1
        return len(pairs), pairs
    best = [[0] * (len(theirs) + 1) for _ in range(len(mine) + 1)]
    score = {}
    for i, label in enumerate(mine):
        for j, other in enumerate(theirs):
            here = max(best[i][j + 1], best[i + 1][j])
            if label == other:
                score[i, j] = weight(kids[i], runs[j][0], known)
                here = max(here, best[i][j] + score[i, j])
            best[i + 1][j + 1] = here
    pairs, i, j = [], len(mine), len(theirs)
    while i and j:
        if (i - 1, j - 1) in score and best[i][j] == best[i - 1][j - 1] + score[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def grow(template: Block, page: Block) -> None:
    """Aligns a page with the template and inserts the nodes that the template lacks."""
    known: dict = {}
    todo = [(template, page)]
    while todo:
        t, p = todo.pop()
        runs = _runs(p.kids)
        of = {j: t.kids[i] for i, j in _best(t.kids, runs, known)[1]}
        kids, at = [], 0
        for j, run in enumerate(runs):
            if j in of:
                while t.kids[at] is not of[j]:
                    kids.append(t.kids[at])
                    at += 1
                at += 1
            kids.append(of.get(j) or Block(run[0].label))
            todo += [(kids[-1], member) for member in reversed(run)]
        t.kids = kids + t.kids[at:]
        if len(runs) > 1 or len(t.kids) != len(runs):
            known.clear()  # weights of a template that has grown


def places(template: Block | None, page: Block) -> None:
    """Sets each block's place: the number of the template's node that it matches (from 1), else a negative hash of its labels' path."""
    known: dict = {}
    todo: list[tuple[Block | None, Block, int]] = [(template, page, 0)]
    while todo:
        t, p, above = todo.pop()
        path = _mixed(above, p.label)
        p.place = t.place if t is not None else -path
        if t is None:
            todo += [(None, x, path) for x in p.kids]
            continue
        runs = _runs(p.kids)
        of = {j: t.kids[i] for i, j in _best(t.kids, runs, known)[1]}
        todo += [(of.get(j), x, path) for j, run in enumerate(runs) for x in run]


def _mixed(above: int, label: str) -> int:
    import xxhash

    return (xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=above) >> 2) + 1


def induced(pages: list[str]) -> Block | None:
    """The wrapper of some pages of one host; None for fewer than two different ones."""
    sys.setrecursionlimit(DEEP)
    trees = [outline(parse(p))[0] for p in dict.fromkeys(pages)]
    if len(trees) < 2:
        return None
    out = Block("#")
    for tree in trees:
        grow(out, tree)
    return out


def shown(template: Block | None) -> str:
    """A wrapper as text: in order from the root, each node's number of children and its label."""
    rows, todo = [], [template] if template is not None else []
    while todo:
        t = todo.pop()
        rows.append([len(t.kids), t.label])
        todo += reversed(t.kids)
    return json.dumps(rows, ensure_ascii=False)


def read(text: str | None) -> Block | None:
    """The wrapper of its text, with numbered places."""
    rows = json.loads(text) if text else []
    holder = Block("")
    open_ = [(holder, 1)]
    for k, (kids, label) in enumerate(rows, 1):
        new = Block(label)
        new.place = k
        above, left = open_.pop()
        above.kids.append(new)
        if left > 1:
            open_.append((above, left - 1))
        if kids:
            open_.append((new, kids))
    return holder.kids[0] if rows else None


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def page_class(segments: list[tuple[Block, str, str]]) -> int:
    """The minimum hash of the word trigrams of a page's longest segment: equal for copies, mostly equal for near copies."""
    import xxhash

    words = max((text for _, text, _ in segments), key=len).encode("utf-8", "surrogatepass").split()
    grams = (b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2)))
    return min([xxhash.xxh3_64_intdigest(g) for g in grams]) - (1 << 63)


def content(segments: list[tuple[Block, str, str]], constants: frozenset[tuple[int, int]]) -> str:
    """What varies, each segment on a line; zones by class words only where nothing else varies, reader comments never."""
    varying = [(text, weak) for block, text, weak in segments if not constants or (block.place, text_hash(text)) not in constants]
    return "\n".join([t for t, weak in varying if not weak] or [t for t, weak in varying if weak not in COMMENT_WORDS])


def host_of(url):
    """A url's host in lower case without www., empty where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of every host: the wrapper as text."""
    ids = pages.select("host", F.xxhash64("html").alias("h"))
    best = [F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(PAGES_FIT)]
    picks = ids.groupBy("host").agg(*best).select("host", F.explode(F.array(*[f"m{k}" for k in range(PAGES_FIT)])).alias("m"))
    # the hashes first, then the pages that have them, once each
    seeds = F.explode(F.array(*[F.xxhash64("h", F.lit(k)) for k in range(PAGES_FIT)]))
    chosen = written(ids.distinct().withColumn("m", seeds).join(picks.distinct(), ["host", "m"], "left_semi").select("host", "h").distinct())
    wanted = F.broadcast(chosen) if chosen.count() <= MOST_CHOSEN else chosen
    fit = pages.select("host", F.xxhash64("html").alias("h"), "html").join(wanted, ["host", "h"]).dropDuplicates(["host", "h"])

    def induce(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": group["host"].iloc[:1], "template": [shown(induced([x or "" for x in group.sort_values("h")["html"]]))]})

    return fit.groupBy("host").applyInPandas(induce, "host string, template string")  # PAGES_FIT pages a group at most


def _with(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with what is known of their hosts: by broadcast up to MOST_BYTES, else each host in parts, since it may hold very many pages."""
    sizes = [F.length("template")] + ([12 * F.size("constants")] if "constants" in found.columns else [])
    if (found.agg(F.sum(sum(sizes, F.lit(0)))).first()[0] or 0) <= MOST_BYTES:
        return pages.join(F.broadcast(found), "host", "left")
    salts = 64
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")


def _aligned(html: str, template: Block | None) -> tuple[list[tuple[Block, str, str]], bool]:
    tree, segments, inside = outline(parse(html))
    places(template, tree)
    return segments, inside


def constants(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, constants): the (place, text hash) that at least half of a host's different pages hold, counted over all pages."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        loaded = lru_cache(maxsize=64)(read)
        names = ["host", "place", "hash", "page", "like", "words", "inside"]
        for part in slices(parts):
            rows: set[tuple] = set()
            for host, html, template in zip(*[c.to_pylist() for c in part.columns]):
                segments, inside = _aligned(html, loaded(template)) if template and html else ([], False)
                if segments:
                    held = {(block.place, text_hash(text)): len(text.split()) for block, text, _ in segments}
                    page, like = hash(tuple(sorted(held))), page_class(segments)
                    rows.update((host, *key, page, like, words, inside) for key, words in held.items())
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    seen = _with(pages, found).select("host", "html", "template").mapInArrow(batches, "host string, place long, hash long, page long, like long, words long, inside boolean")
    held = written(seen.distinct())
    both = lambda page, like: [F.count_distinct("page").alias(page), F.count_distinct("like").alias(like)]
    counts = held.groupBy("host", "place", "hash").agg(*both("n", "c"), F.max("words").alias("words"), F.max("inside").alias("inside"))
    mass = F.col("n") * F.col("words")
    counts = written(counts.withColumn("mass", mass))
    # a row a host, so that a host with very many pages is no key of a join
    hosts = written(held.groupBy("host").agg(*both("pages", "likes")).join(counts.groupBy("host").agg(F.sum("mass").alias("total")), "host"))
    beside = (lambda df: F.broadcast(df)) if hosts.count() <= MOST_CHOSEN else (lambda df: df)
    counts = counts.where("n > 1").join(beside(hosts), "host")
    least = F.when(F.col("inside"), 3).otherwise(2)
    plain, strict = (2 * F.col("n") >= F.col("pages")) & (F.col("n") >= least), (2 * F.col("c") >= F.col("likes")) & (F.col("c") >= least)
    shares = counts.where(plain).groupBy("host").agg((F.sum("mass") / F.first("total")).alias("share"))
    fixed = counts.join(beside(shares), "host").where(F.when(F.col("share") > MOST_CONSTANT, strict).otherwise(plain))
    return fixed.groupBy("host").agg(F.collect_list(F.struct("place", "hash")).alias("constants"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    found = written(templates(pages))
    found = written(found.join(constants(pages, found), "host", "left"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        loaded = lru_cache(maxsize=64)(read)
        for part in slices(parts, 2):
            out = []
            for html, template, fixed in zip(part.column(2), part.column(3).to_pylist(), part.column(4)):
                text = html.as_py() or ""
                known = frozenset((x["place"], x["hash"]) for x in fixed.as_py() or ())
                out.append(content(_aligned(text, loaded(template or "") if known else None)[0], known) if text else "")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return _with(pages, found).select("page_id", "url", "html", "template", "constants").mapInArrow(batches, "page_id long, url string, text string")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op10_html_extract": op10_html_extract}
ORACLE: dict[str, str] = {}
