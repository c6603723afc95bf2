import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sigmill.llm import packing


def plain(texts):
    t = packing._words("word_bpe_49k.json").tokenizer
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n'resdlTM1a.,\x1c\x85é́ΣİKſ"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_words_equal_whole_texts(texts):
    got = packing._words("word_bpe_49k.json").encode(texts)
    assert [np.frombuffer(x, packing._words("word_bpe_49k.json").dtype).tolist() for x in got] == plain(texts)


def test_hilbert_neighbours_touch():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check(spark_rows, pieces, size):
    want = defaultdict(list)
    for i, t in spark_rows:
        want[i].append(plain([t or ""])[0] + [2])
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and at & (at - 1) == 0
    assert by_doc.keys() == want.keys()
    for i, docs in want.items():
        assert sum(n for _, n, _, _ in by_doc[i]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for start, n, crc, total in sorted(by_doc[i]):
                assert start == at and total == len(docs[0])
                assert crc == zlib.crc32(np.array(docs[0][start : start + n], "<u4").tobytes())
                at += n


def test_pieces(documents):
    rows = [(i, f"Some words number {i}, again. " * (i % 40)) for i in range(150)] + [(500, None), (501, ""), (502, "long text here " * 20000), (7, "twice"), (None, "x")]
    for ranges, size in ((1, 4096), (6, 64), (40, 4096)):
        check(rows, packing.pack(documents(rows), ranges, size=size).collect(), size)
    same = [(i, "the same text") for i in range(300)]
    check(same, packing.pack(documents(same), 8).collect(), 4096)
    assert packing.pack(documents([]), 4).count() == 0
