"""Each stage of the pipeline against a plain version of its own input, and the registered queries through table reading."""

import random

import pytest
from test_line_dedup import brute as lines_brute
from test_ngram_join import brute as near_brute
from test_packing import check as pieces_check
from test_toxicity import BAD, WORDS

import __spark_entry__ as entry
import corpus_pipeline
from sigmill.llm import pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _gone int, toxic_score string"


def corpus():
    random.seed(9)
    texts = []
    for i in range(260):
        toxic = i % 6 == 0
        words = random.choices(WORDS, k=40) + [f"own{i}x{k}" for k in range(20)] + (random.choices(BAD, k=3) if toxic else [])
        random.shuffle(words)
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    shared = " ".join(f"shared{k}" for k in range(30))
    rows += [(300 + i, f"intro{i} a b c\n{shared}\nrest{i} " + " ".join(f"r{i}q{k}" for k in range(12))) for i in range(5)]
    rows += [(400 + i, " ".join([f"near{k}" for k in range(120)] + [f"end{i}"])) for i in range(4)]
    rows += [(500, "write to bob@example.com or bob at example.com now"), (501, None), (502, ""), (503, rows[1][1]), (504, "word " * 20000), (505, "again twice"), (505, "again twice")]
    return rows + [(None, "no id at all"), (None, None)], {i: int(i % 6 == 0) for i in range(0, 240)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    spark.createDataFrame([(i, t, "en", "x", len(t) if t is not None else None, 7, "z") for i, t in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(k, rows[k][1]) for k in range(4)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_each_stage_on_its_own_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "toxicity":
            score = toxicity.scorer(toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
            assert pairs(after) == sorted(((i, t) for i, t in before if score(t or "") < toxicity.THRESHOLD), key=str)
            assert len(before) * 0.7 < after.count() < len(before)
        elif name == "line dedup":
            left = lines_brute(before)
            want = [(i, t) if i is None or t is None else (i, left[i]) for i, t in before]
            assert pairs(after) == sorted(((i, t) for (i, t), (_, old) in zip(want, before) if t is None or t == old or t.strip()), key=str)
        elif name == "near duplicates":
            gone = {i for i, _, c in near_brute(before, 5, 80) if i is not None and c < i}
            assert gone and pairs(after) == sorted(((i, t) for i, t in before if i not in gone), key=str)
        elif name == "personal data":
            by = dict(pairs(after))
            assert by[500] == "write to [EMAIL] or [EMAIL] now" and after.count() == len(before)
            assert pairs(after) == sorted(((i, by[500] if i == 500 else t) for i, t in before), key=str) and not pii.base_spans(by[500])
        else:
            pieces_check(before, after.collect(), 4096)
            continue
        assert after.columns == columns
        assert all(r.n_chars == len(r.text) for r in after.where("text is not null").collect())
        seen[name] = after.count()
        docs = after
    assert list(seen.values()) == sorted(seen.values(), reverse=True)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered_queries(spark, folder):
    """Names and types of the contract, through table reading."""
    want = {
        "op1_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op2_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op6_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op9_line_dedup": {"doc_id": "bigint", "text": "string"},
        "op12_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op13_importance_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    }
    rows = len(corpus()[0])
    queries = entry.queries()
    for name, columns in want.items():
        df = queries[name](spark, folder)
        assert columns.items() <= dict(df.dtypes).items(), name
        assert df.count() >= rows if name == "op5_packing" else df.count() == rows, name
    ranked = queries["op11_ranked_search"](spark, folder)
    assert {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}.items() <= dict(ranked.dtypes).items() and ranked.count() > 0
    assert {f"op{k}" for k in range(1, 14)} <= {n.split("_")[0] for n in queries} and "pipeline" in queries
