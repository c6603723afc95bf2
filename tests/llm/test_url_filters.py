import datetime as dt

from sigmill.llm import url_filters as uf

D = dt.date


def decide(spark, urls, entries):
    rows = [(i, u, d) for i, (u, d) in enumerate(urls)]
    caps = spark.createDataFrame(rows, "id long, url string, fetched date").selectExpr("*", "'x' as key", "'y' as action")
    out = uf.decide(caps, spark.createDataFrame(entries, "key string, action string, day string")).collect()
    return {r.id: (r.entry, r.action, r.blocked) for r in out}


ENTRIES = [("bad.com", "block", "2024-01-10"), ("bad.com", "allow", "2024-02-10"), ("Sub.bad.com/a/b", "block", "2024-02-20"), ("good.bad.com", "allow", "2024-01-01"), ("x.org", "block", "2024-01-01"), ("x.org", "allow", "2024-01-01")]


def test_as_of_rules(spark):
    day = D(2024, 1, 20)
    got = decide(spark, [
        ("http://bad.com/x", D(2024, 1, 9)), ("http://BAD.com:80/x", D(2024, 1, 10)), ("https://u@a.bad.com?q", D(2024, 2, 9)), ("http://bad.com", D(2024, 2, 10)),
        ("http://sub.bad.com/a/b/c", D(2024, 2, 20)), ("http://sub.bad.com/a/bc", D(2024, 2, 20)), ("http://good.bad.com/", day), ("http://notbad.com/", day),
        (None, day), ("", day), ("::odd", day), ("http://bad.com", None), ("http://x.org", day), ("http://bad.com/" + "p/" * 300, day),
    ], ENTRIES)
    none = (None, None, False)
    assert got[0] == none and got[1] == ("bad.com", "block", True) and got[2] == got[1] and got[3] == ("bad.com", "allow", False)
    assert got[4] == ("sub.bad.com/a/b", "block", True) and got[5] == ("bad.com", "allow", False) and got[6] == ("good.bad.com", "allow", False)
    assert all(got[k] == none for k in (7, 8, 9, 10, 11)) and got[12] == ("x.org", "block", True) and got[13] == got[1]


def test_hosts_of_many_labels(spark):
    day = D(2024, 1, 20)
    got = decide(spark, [("http://" + "a." * 5000 + "bad.com/x", day), ("http://" + "a." * 5000 + "good.bad.com", day), ("http://com", day)], ENTRIES)
    assert got == {0: ("bad.com", "block", True), 1: ("good.bad.com", "allow", False), 2: (None, None, False)}


def test_shuffled_list_and_small_tables(spark, monkeypatch):
    urls = [("http://bad.com/x", D(2024, 1, 10))] * 3
    want = decide(spark, urls, ENTRIES)
    monkeypatch.setattr(uf, "MOST_BROADCAST", 0)
    assert decide(spark, urls, ENTRIES) == want and len(want) == 3
    assert decide(spark, urls, []) == {k: (None, None, False) for k in range(3)}
    assert decide(spark, [], ENTRIES) == {}
