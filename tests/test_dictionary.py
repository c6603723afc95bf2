"""Names in whole texts against a plain search, and what the entities of a text are made of."""

import random
import re

from sigmill.operators import dictionary as D
from sigmill.operators import entities as E
from sigmill.operators import neighbours as N

EDGE = re.compile(r"[\s,.()\[\]\"'!?;:/\\]", re.A)


def plain(text, names):
    low, out = text.lower(), set()
    for name in names:
        key, at = name.lower(), -1
        while (at := low.find(key, at + 1)) >= 0:
            end = at + len(key)
            if (at == 0 or EDGE.match(low[at - 1])) and (end == len(low) or EDGE.match(low[end])):
                out.add(name)
    return out


def cases():
    rng = random.Random(6)
    words = ["node", "js", "vs", "code", "vs-code", "linux", "Mint", "a", "b_c", "münch", "日本"]
    join = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", ".", "-", ", ", "/", "  "]) for _ in range(n)).rstrip(" .-,/")
    names = {join(rng.randrange(1, 5)) for _ in range(5000)} | {"version", "Update", "abc"}
    texts = [join(rng.randrange(0, 40)) for _ in range(120)] + ["", "VERSION 3 of vs-code!", "x" * 200_000 + " linux"]
    return {n for n in names if len(n.strip()) >= 4}, texts


def test_names_against_a_plain_search(spark):
    names, texts = cases()
    rows = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, text string")
    got = {}
    for r in D.found(rows, "id", "text", spark.createDataFrame([(n,) for n in [*names, None, "abc"]], "name string"), D.STOPS).collect():
        got.setdefault(r.id, set()).add(r.name)
    allowed = {n for n in names if n.lower() not in D.STOPS}
    for i, t in enumerate(texts):
        assert got.get(i, set()) == plain(t, allowed), t


def test_longest_name_and_none(spark):
    rows = spark.createDataFrame([(1, "I use Visual Studio Code, daily"), (2, "visual studios"), (3, None)], "id int, text string")
    names = spark.createDataFrame([("Visual Studio",), ("Visual Studio Code",), ("Visual",), ("daily",)], "name string")
    assert [tuple(r) for r in D.longest(rows, "id", "text", names).orderBy("id").collect()] == [(1, "Visual Studio Code"), (2, "Visual")]
    assert D.longest(rows, "id", "text", names.where("false")).count() == 0


def test_entities_of_texts(spark):
    rows = spark.createDataFrame([(1, "The docker upgrade broke my Gizmo on windows 11"), (2, "a zz 9x"), (3, None), (4, "docker and firefox")], "id int, text string")
    known = spark.createDataFrame([(1, "Gizmo"), (4, "Docker")], "id int, name string")
    got = {(r.id, r.kind, r.name, r.sure) for r in E.in_texts(rows, "id", "text", known).collect()}
    assert got == {(1, "os", "windows 11", 0.95), (1, "software", "docker", 0.92), (1, "software", "gizmo", 0.95), (4, "software", "docker", 0.95), (4, "software", "firefox", 0.92)}
    assert ("software", "upgrade", 0.55) in {(r.kind, r.name, r.sure) for r in E.in_texts(spark.createDataFrame([(1, "the upgrade")], "id int, text string"), "id", "text").collect()}


def test_nearest_texts_against_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(80)]
    text = lambda: " ".join(rng.choices(words, [1 / (k + 1) for k in range(80)], k=rng.randrange(0, 70)))
    base = text()
    rows = [(i, rng.choice("abc"), rng.choice([text(), text(), base + f" own{i % 3}"])) for i in range(300)] + [(300, None, base), (301, "a", None), (None, "a", base)]
    asked = [(i, text()) for i in range(25)] + [(50, base), (51, ""), (52, None), (53, "never seen")]
    bag = lambda t: {w: re.findall(r"\w{2,}", t).count(w) for w in re.findall(r"\w{2,}", t)}
    far = lambda a, b: sum((a.get(w, 0) - b.get(w, 0)) ** 2 for w in a.keys() | b.keys())
    monkeypatch.setattr(N, "ROWS", 130)
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, "id long, label string, text string"), spark.createDataFrame(asked, "query long, text string")).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.distance, r.id)
    for q, t in asked:
        want = sorted((far(bag(t), bag(x)), i) for i, _, x in rows if i is not None and x is not None)[:5] if t is not None else []
        assert [got.get(q, {})[k] for k in sorted(got.get(q, {}))] == want, q


def test_few_rows_are_finished(monkeypatch):
    import numpy as np
    import pandas as pd

    rng = random.Random(8)
    texts = [[rng.randrange(50) for _ in range(60)] + [1000 + i, 2000 + i // 2] * 8 for i in range(400)]
    index = N.Index(pd.Series([np.array(t, dtype=np.int64) for t in texts]))
    seen, begun = [], index.begins

    class Watched(np.ndarray):
        def __getitem__(self, k):
            seen.append(k)
            return np.asarray(begun)[k]

    index.begins = np.asarray(begun).view(Watched)
    at, distance = index.nearest(np.array(texts[7], dtype=np.int64), np.arange(400), 1)
    assert at.tolist() == [7] and distance.tolist() == [0.0] and len(seen) <= 2 * 40


def test_votes(spark):
    found = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, None)], "query int, label string")
    assert {(r["query"], r.guess) for r in N.voted(found).collect()} == {(1, "b"), (2, "a")}


def test_patterns_are_tried_where_a_match_can_be(spark):
    samples = (
        "windows 11.2,win 7,macos 14.1,mac os 9,os x 10,ios 17,ipados,android 14,ubuntu 22.04,debian,fedora 40,centos,chrome os,chromeos,linux mint 21,firefox 120,chrome 1.2,chromium,safari,edge 3,visual studio code,vs code,"
        "vscode,microsoft office,office 365,excel,word,outlook,powerpoint,teams,slack,discord,zoom,skype,docker 1,kubernetes,k8s,node.js 20,nodejs,python 3.13,java,photoshop,illustrator,premiere,lightroom,spotify,netflix,"
        "whatsapp,telegram,signal,openssl 3.0,openssh,nginx,apache,linux kernel,kernel 6,git,curl,bash,github,gitlab,bitbucket,npm,yarn,pip,gradle,maven,terraform,ansible,jenkins,prometheus,grafana,react,vue,angular,"
        "next.js,nextjs,express,postgres,postgresql 16,mysql,mongodb,redis,sqlite,ipad,iphone,macbook,imac,pixel 8,galaxy s,surface pro"
    ).split(",")
    for x in samples:
        tried = {p for _, ps, _ in E.GROUPS for p in ps if re.search(p, x)}
        assert tried and all(any(h in x for h in E.HOLDS[p]) for p in tried), x
    # each alternative of each pattern has a sample
    assert {p for p in E.HOLDS} == {p for x in samples for p in E.HOLDS if re.search(p, x)}
    rows = spark.createDataFrame([(i, x.upper()) for i, x in enumerate(samples)] + [(999, None), (1000, "nothing here")], "id long, text string")
    got = {(r.id, r.name) for r in E.in_texts(rows, "id", "text").where("sure > 0.6").collect()}
    assert got == {(i, m.strip()) for i, x in enumerate(samples) for p in E.HOLDS for m in re.findall(p, x)}
