"""Sources and sinks, and the memory that a stream of findings fills."""

import json
import os
import time

from pyspark.sql import functions as F

from sigmill.operators import records as R
from sigmill.sources import files as S
from sigmill.sources import paged as P
from sigmill.streaming import memory as M


def test_pages_and_lists(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"data": [{"title": "a\nb", "n": 1}, {"postTitle": "c"}]}))
    (tmp_path / "p2.json").write_text(json.dumps({"data": {"no": "list"}}))
    rows = S.payloads(spark, str(tmp_path / "p*.json"))
    assert sorted(r[0] for r in rows.select(R.alias(F.col("record"), "title")).collect()) == ["a\nb", "c"]
    (tmp_path / "list.json").write_text(json.dumps([{"title": "x"}, {"name": "y"}]))
    assert S.records(spark, str(tmp_path / "list.json")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi", you', 1), ("b", None, 2)], "k string, t string, n int")
    S.write_csv(df, str(tmp_path / "out"), ["n", "k", "t"])
    back = S.csv_text(spark, str(tmp_path / "out"))
    assert back.dtypes == [("n", "string"), ("k", "string"), ("t", "string")]
    assert sorted(tuple(r) for r in back.collect()) == [("1", "a", 'say "hi", you'), ("2", "b", None)]


def test_json_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", "x" * 9000)], "k string, raw string")
    S.write_json(df, str(tmp_path / "j"), {"kind": "test"})
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "j/about")).select("kind", "rows").collect()] == [("test", 1)]
    for _ in range(2):
        S.append(df, str(tmp_path / "t"), {"raw": 8000})
    assert [len(r.raw) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [8000, 8000]


def test_source_tree(spark, tmp_path):
    for name in ("a.py", "pkg/b.py", "venv/c.py", "pkg/node_modules/d.py", "e.txt"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("x = 1\n")
    assert sorted(r.path for r in S.sources(spark, str(tmp_path / "tree")).collect()) == ["a.py", "pkg/b.py"]


def test_merged_sources(spark):
    frames = {k: spark.createDataFrame([(n, f"{k}{n}" * 200) for n in range(5)], "n int, title string") for k in ("news", "cve")}
    got = S.merged(frames, "n", {"news": 2, "cve": 3}).collect()
    assert [r.kind for r in got].count("news") == 2 and len(got) == 5 and all(len(r.title) == 500 for r in got)


def test_memory_grows_by_batches(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    rows = [{"id": i, "repo": "r", "pr": 100 - i, "pattern_key": f"k{i % 3}", "detail": f"d{i}" * 300} for i in range(30)]
    for part in (rows[:11], rows[11:20], rows[20:]):
        (land / f"{len(os.listdir(land))}.json").write_text("\n".join(map(json.dumps, part)))
        M.remember(spark, str(land), str(tmp_path / "memory"), str(tmp_path / "state"))
        M.remember(spark, str(land), str(tmp_path / "memory"), str(tmp_path / "state"))  # nothing new
    want = M.summary(spark.createDataFrame([(r["id"], r["repo"], r["pr"], r["pattern_key"], r["detail"]) for r in rows], M.FINDINGS))
    assert sorted(map(tuple, M.recalled(spark, str(tmp_path / "memory")).collect())) == sorted(map(tuple, want.collect()))


def test_memory_after_compaction_and_repeated_batches(spark, tmp_path):
    land, memory, state = tmp_path / "land", str(tmp_path / "memory"), str(tmp_path / "state")
    land.mkdir()
    rows = [{"id": i, "repo": "r", "pr": 100 - i, "pattern_key": f"k{i % 3}", "detail": f"d{i}"} for i in range(30)]
    assert M.recalled(spark, memory).count() == 0 and M.compact(spark, memory) is None
    for k, part in enumerate((rows[:11], rows[11:20], rows[20:])):
        (land / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        M.remember(spark, str(land), memory, state)
        if k < 2:
            assert M.compact(spark, memory) == k and M.compact(spark, memory) is None
    want = sorted(map(tuple, M.summary(spark.createDataFrame([(r["id"], r["repo"], r["pr"], r["pattern_key"], r["detail"]) for r in rows], M.FINDINGS)).collect()))
    assert sorted(map(tuple, M.recalled(spark, memory).collect())) == want
    # a batch of the compaction runs again; a compaction stops half way
    M.summary(spark.createDataFrame([(0, "r", 100, "k0", "d0")], M.FINDINGS)).write.mode("overwrite").parquet(f"{memory}/batches/batch=1")
    spark.range(3).write.parquet(f"{memory}/compacted/upto=2")
    os.remove(f"{memory}/compacted/upto=2/_SUCCESS")
    assert sorted(map(tuple, M.recalled(spark, memory).collect())) == want
    assert M.compact(spark, memory) == 2 and sorted(map(tuple, M.recalled(spark, memory).collect())) == want


def test_refresh_where_the_last_result_is_old(spark, tmp_path):
    made, path = [], str(tmp_path / "result")

    def make():
        made.append(1)
        return spark.range(len(made))

    assert M.refreshed(spark, path, "2026-02-01 12:00:00", make) and not M.refreshed(spark, path, "2026-02-09 11:59:59", make)
    assert M.current(spark, path).count() == 1
    assert M.refreshed(spark, path, "2026-02-09 12:00:00", make) and M.current(spark, path).count() == 2 and len(made) == 2


def test_paged_source(spark, tmp_path):
    P.register(spark)
    full = lambda n: json.dumps({"data": [{"n": n, "k": k, "t": "é\n"} for k in range(3)]})
    for n in range(1, 5):
        (tmp_path / f"page-{n}.json").write_text(full(n))
    (tmp_path / "page-5.json").write_text('{"data": [1')
    (tmp_path / "page-6.json").write_text('{"data": {"no": "list"}}')
    (tmp_path / "page-7.json").write_text('{"data": ["only one"]}')
    (tmp_path / "notes.txt").write_text("x")
    df = spark.read.format("paged").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 7
    got = df.collect()
    assert [r.page for r in got if r.problem is None] == [n for n in range(1, 5) for _ in range(3)] + [7] and [r.page for r in got if r.problem] == [5]
    assert json.loads(got[0].record) == {"n": 1, "k": 0, "t": "é\n"}


def test_paged_source_as_a_stream(spark, tmp_path):
    P.register(spark)
    land, out = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    put = lambda n, k: (land / f"{n}.json").write_text(json.dumps({"data": [f"{n}:{i}" for i in range(k)]}))

    def run():
        stream = spark.readStream.format("paged").option("limit", "2").load(str(land))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(json.loads(r.record) for r in spark.read.schema(P.SCHEMA).parquet(out).collect())

    put(1, 2)
    put(2, 1)
    assert run() == ["1:0", "1:1"]  # the second page may still grow
    put(2, 2)
    put(4, 2)
    assert run() == ["1:0", "1:1", "2:0", "2:1"]  # the third is missing
    put(3, 1)
    assert run() == sorted(["1:0", "1:1", "2:0", "2:1", "3:0", "4:0", "4:1"]) == run()


def test_stale_files(spark, tmp_path):
    for name, days in (("new", 1), ("old", 9)):
        (tmp_path / name).write_text("x")
        at = time.time() - days * 86400 - 60
        os.utime(tmp_path / name, (at, at))
    now = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
    assert [r.path.rsplit("/", 1)[-1] for r in M.stale(spark, str(tmp_path), now).collect()] == ["old"]
