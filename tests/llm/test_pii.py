import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sigmill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c)
        if k % 2:
            x = x * 2
            x = x - 9 if x > 9 else x
        s += x
    return s % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-_ 0123456789()é", max_size=60))
def test_base_against_regex(text):
    assert pii.base_spans(text) == brute(text)


def shown(text):
    base = pii.base_spans(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, base)]


def test_disguises_map_back():
    assert shown("mail john.doe [at] example [dot] com now") == [("email", "john.doe [at] example [dot] com")]
    assert shown("mail jane at mail dot example dot org now") == [("email", "jane at mail dot example dot org")]
    assert shown("x jоhn@exаmple.com y") == [("email", "jоhn@exаmple.com")]
    assert shown("ring plus one four one five five five five two six seven one now")[0][0] == "phone"
    assert shown("host １２.3.4.5 up") == [("ip", "１２.3.4.5")]
    assert shown("four one one one 1111 1111 1111 1 and one more") in ([], [("card", "four one one one 1111 1111 1111 1")])
    assert shown("ad\u200bmin@site.org") == []  # the base span of its tail stays as it is
    assert shown("Post an anna arroba beispiel punkt de senden") == [("email", "anna arroba beispiel punkt de")]
    assert shown("Ruf an: plus vier neun eins sieben null zwei drei vier fünf sechs") == [("phone", "plus vier neun eins sieben null zwei drei vier fünf sechs")]
    assert shown("écrire à luc (arobase) exemple (point) fr") == [("email", "luc (arobase) exemple (point) fr")]
    assert shown("llame más tres cuatro seis uno dos tres cuatro cinco seis siete") == [("phone", "más tres cuatro seis uno dos tres cuatro cinco seis siete")]
    for clean in ("un deux trois", "meet at noon. dot the i", "one two three go", "the cat sat at home.", "", "we look at this.That is"):
        assert shown(clean) == []


def test_other_words_do_not_decide_on_a_disguise(documents):
    for text, want in (("write to bob at example.com", [("email", "bob at example.com")]), ("Bob At Example.Com", [("email", "Bob At Example.Com")]), ("we look at this.That is", []), ("meet at noon.", [])):
        for more in ("", " one", " dot ", " 1\xa0000", " a – b", " (at) "):
            assert shown(text + more) == want
    assert pii.redact(documents([(1, "write to bob at example.com")])).first().text == "write to [EMAIL]"


def test_long_runs_cost_their_length():
    import time

    begun = time.perf_counter()
    for text in ("7" * 300_000, "1." * 150_000, "1.1.1.1 " * 40_000, "one " * 60_000, "a at b.c " * 20_000, "9" * 6000 + ".1.1.1", "+1" * 100_000):
        pii.added_spans(text, pii.base_spans(text))
    assert time.perf_counter() - begun < 20


def test_query_rows(documents):
    rows = [(1, "a@b.co and 10.0.0.256 10.0.0.25; 4111 1111 1111 1111; +1 (988) 555-2485"), (2, None), (3, ""), (4, "é🎉 x.y@é a@b.c.d"), (None, "1.2.3.4"), (1, "x " * 100000 + " q@w.er")]
    got = pii.spans(documents(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), [(pii.KINDS[k], s, e) for s, k, e in brute(t or "")]) for i, t in rows)
    assert sorted((str(r.doc_id), [tuple(x) for x in r.base]) for r in got) == want
    red = {r.doc_id: r.text for r in pii.redact(documents(rows[:4])).collect()}
    assert red[1] == "[EMAIL] and 10.0.0.256 [IP]; [CARD]; [PHONE]" and red[2] is None
    assert pii.spans(documents([])).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_registered_query_counts_kinds(spark, tmp_path):
    rows = [(1, "a@b.co 10.0.0.25 +1 (988) 555-2485 c@d.ef"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op7_pii(spark, str(tmp_path)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 1, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:16,phone:17:34,email:35:41").hexdigest() and got[2].spans == ""
