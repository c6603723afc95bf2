import random
from itertools import combinations

import pytest

from sigmill.llm import html_extract as hx

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu {0}</a></ul></nav>"
    "<!-- ad --><div class=\"ad\">Buy {0}</div><article><h1>Head {0}</h1><p><b>First &amp; {0}<br><p>Second\n  {0}.</p><aside>Side</aside><form>F</form>"
    "<section class='comments'><p>Reader</p></section></article><footer>&copy; host</footer></body></html>"
)
PLAIN = (
    "<html><body><div id='top'>Site name</div><div class='l1'><a href='/'>Home</a> <a href='/x'>News</a> <a href='/y'>Sport</a></div>"
    "<div class='c'><h1>Title {0}</h1><p>Text {0} one with words</p><ul><li>Point {0}</li><li>Other {0}</li></ul><p>More {0}</p></div>"
    "<div class='r'><p>Read our rules</p></div><div id='end'>All rights kept</div></body></html>"
)


def text(page, constants=frozenset()):
    return hx.content(hx.outline(hx.parse(page))[1], constants)


@pytest.fixture(scope="module")
def extracted(spark):
    def run(pages, host="h.example.com"):
        rows = [(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)]
        got = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        return [r.text for r in sorted(got, key=lambda r: r.page_id)]

    return run


def test_article():
    assert text(PAGE.replace("{0}", "x")) == "Head x\nFirst & x\nSecond x."


def tree(depth, width, labels="ab"):
    t = hx.Block(random.choice(labels))
    t.kids = [tree(depth - 1, width, labels) for _ in range(random.randrange(width + 1))] if depth else []
    return t


def exhaustive(t, p):
    """The best match over all choices of equally many children and runs, in order."""
    if t.label != p.label:
        return 0
    runs = [r[0] for r in hx._runs(p.kids)]
    best = 0
    for k in range(min(len(t.kids), len(runs)) + 1):
        for a in combinations(t.kids, k):
            for b in combinations(runs, k):
                if all(x.label == y.label for x, y in zip(a, b)):
                    best = max(best, sum(exhaustive(x, y) for x, y in zip(a, b)))
    return 1 + best


def test_tree_matching_is_the_best():
    random.seed(3)
    for _ in range(150):
        a, b = tree(3, 3), tree(3, 3)
        assert hx.weight(a, b, {}) == exhaustive(a, b)


def test_a_wrapper_holds_its_pages_and_its_text_gives_it_back():
    random.seed(4)
    pages = [tree(3, 4, "abc") for _ in range(6)]
    out = hx.Block("#")
    for p in pages:
        whole = hx.Block("#")
        whole.kids = [p]
        hx.grow(out, whole)
        hx.places(hx.read(hx.shown(out)), whole)
        todo = [whole]
        while todo:
            x = todo.pop()
            assert x.place > 0
            todo += x.kids
    assert hx.shown(hx.read(hx.shown(out))) == hx.shown(out)


def test_pages_without_an_article_element(extracted):
    pages = [PLAIN.replace("{0}", f"w{k} of day {k}") for k in range(6)]
    want = [f"Title {w}\nText {w} one with words\nPoint {w}\nOther {w}\nMore {w}" for w in (f"w{k} of day {k}" for k in range(6))]
    assert extracted(pages) == want
    assert text(pages[0]) != want[0]  # without the template, the menu stays


def test_constants_inside_an_article_and_in_odd_places(extracted):
    page = "<body><main><p>Our tagline for all</p><h1>Head {0}</h1><p>Text of {0} goes here</p><p>Share this page</p></main></body>"
    assert extracted([page.replace("{0}", f"n{k}") for k in range(5)]) == [f"Head n{k}\nText of n{k} goes here" for k in range(5)]
    # the wrapper knows no list, but most pages hold the same one
    page = "<body><div><h1>Head {0}</h1><p>Text of {0} goes here</p></div><div class='k'><dl><dt>Call us</dt></dl></div></body>"
    assert extracted([page.replace("{0}", f"n{k}") for k in range(40)]) == [f"Head n{k}\nText of n{k} goes here" for k in range(40)]


def test_a_shared_beginning_is_no_constant(extracted):
    lead = "This dispatch was filed by our correspondent at the usual place and in the usual way, "
    page = f"<html><body><div id='top'>{lead}as always</div><div class='c'>{lead}on {{0}}</div></body></html>"
    assert extracted([page.replace("{0}", k) for k in "abc"]) == [lead + f"on {k}" for k in "abc"]


def test_copies_are_no_template(extracted):
    page = "<body><div><h1>Head</h1><p>The same story on each page of this host</p></div></body>"
    assert extracted([page] * 5) == ["Head\nThe same story on each page of this host"] * 5


def test_class_names():
    for name in ("ad", "ad-slot", "site-footer", "postComments", "comment-list", "share-buttons", "cookie_notice", "sidebar-2"):
        assert hx.zone_word(name), name
    for name in ("share-of-market", "form-factor", "article-header", "content", "headline", "ladder", "entry-content"):
        assert not hx.zone_word(name), name
    assert text("<article><p class='share-of-market'>Kept</p><div class='entry-header'><h1>Kept too</h1></div><div class='share'>Gone</div></article>") == "Kept\nKept too"
    assert text("<body><div class='search'><p>The only text</p></div><div class='comments'>Reader</div></body>") == "The only text"


@pytest.mark.parametrize("odd", ["", "plain", "<", "<p", "a<b>c", "<p>one<p>two", "&lt;p&gt;", "<ul><li>a<li>b</ul>", "<table><tr><td>a<td>b<tr><td>c</table>", "<div>" * 3000 + "deep", "</p></div>x", "<math><mi>x</mi></math>"])
def test_odd_pages(odd):
    got = text(odd)
    assert isinstance(got, str) and "\n\n" not in got
    if "deep" in odd:
        assert got == "deep"


def test_a_deep_menu_goes(extracted):
    page = "<body>" + "<div>" * 2000 + "Menu" + "</div>" * 2000 + "<div class='c'><p>Text {0}</p></div></body>"
    assert extracted([page.replace("{0}", f"n{k}") for k in range(4)]) == [f"Text n{k}" for k in range(4)]


def test_query_rows(spark):
    rows = [(i, f"http://www.Site{i % 3}.example.com:80/p/{i}?q#f", PAGE.replace("{0}", f"n{i}")) for i in range(30)]
    rows += [(100, None, PAGE.replace("{0}", "u")), (101, "http://solo.example", "<p>alone</p>"), (102, "http://site1.example.com/x", None), (103, "x", ""), (None, "http://site1.example.com/x", "<article>" + "<p>w w</p>" * 20000 + "</article>"), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as template")
    got = hx.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[3] == "Head n3\nFirst & n3\nSecond n3." and by[101] == "alone" and by[102] == by[103] == "" and by[100] == "Head u\nFirst & u\nSecond u."
    assert by[None] == "\n".join(["w w"] * 20000)
    assert hx.extract(pages.limit(0)).count() == 0


def test_near_copies_are_no_template(extracted):
    story = " ".join(f"word{k} of the long story" for k in range(80))
    page = f"<body><div><h1>Head</h1><p>{story}</p><p>One more passage that all of them hold</p><p>But {{0}} here</p></div></body>"
    assert extracted([page.replace("{0}", f"end {k}") for k in range(6)]) == [f"Head\n{story}\nOne more passage that all of them hold\nBut end {k} here" for k in range(6)]
