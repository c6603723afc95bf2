import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sigmill.llm import byte_bpe

PLAIN, OF, _ = byte_bpe._codec(byte_bpe._path("byte_bpe_50k.tiktoken"))
ODD = ["", " ", "\n", "'re", "don't we'll", "a" * 300, " \n \t x  y", "日本語のテキスト、 長い", "x\x1c y\x85z  q", "12 34.5 '" * 40, "🎉 ok"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'resdltvm1a.\x1c\x85　é日"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_tree_equals_whole(text):
    ids = byte_bpe.encode_text(text, PLAIN, leaf_chars=3)
    assert ids == PLAIN(text)
    assert byte_bpe.decode_ids(ids, OF, leaf_ids=2) == text.encode()


def test_query_rows(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "'re"), (99, None), (100, "word and more " * 9000)]
    got = sorted(byte_bpe.round_trip(documents(rows)).collect(), key=str)
    want = []
    for i, t in rows:
        ids = PLAIN(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    enc = byte_bpe.encode(documents(rows))
    back = {(r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(enc).collect()}
    assert back == {(i, (t or "").encode()) for i, t in rows}
    assert byte_bpe.round_trip(documents([])).count() == 0
