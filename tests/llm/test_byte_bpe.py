import hashlib
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import byte_bpe
from gaugeworks.llm.queries import vocabulary_file

from fixtures import awkward

WORDS = byte_bpe.Vocabulary(vocabulary_file())
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=WORDS.ranks, special_tokens={})
PARTS = ["'", "s", "t", "re", "r", "ve", "l", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "٣", "!", "　", "漢", "😀", "\x85", "­", "́"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=5))
def test_encodes_as_the_library_does_and_decodes(texts):
    for text, ids in zip(texts, WORDS.encode(texts)):
        assert ids == THEIRS.encode_ordinary(text) and WORDS.decode(ids) == text.encode()


def test_every_code_point_has_the_right_class():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[j : j + 500]) for j in range(i, min(i + 20_000, len(points)), 500)]
        assert WORDS.encode(texts) == [THEIRS.encode_ordinary(t) for t in texts]


def test_long_pieces_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    for text in ("a" * 9000, "='" * 400 + " " * 700, "'re" * 60, "x y z " * 50):
        assert WORDS.encode([text])[0] == THEIRS.encode_ordinary(text)


def test_digests(spark):
    docs = awkward(spark)
    found = byte_bpe.digests(docs, vocabulary_file()).collect()
    texts = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert len(found) == len(texts)
    expected = []
    for i, text in texts:
        ids = THEIRS.encode_ordinary(text)
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, *r[1:]) for r in found) == sorted(expected)
    assert byte_bpe.digests(docs.limit(0), vocabulary_file()).count() == 0
    assert byte_bpe.with_ids(docs, vocabulary_file()).where("doc_id = 9").first().ids == THEIRS.encode_ordinary("one")


def test_merging_ties_go_left():
    pieces = [b"abab", b"aaa", b"a"]
    assert WORDS.merge_many(pieces) == [WORDS.merge_long(p) for p in pieces]
    assert pytest.approx(len(WORDS.tokens)) == 50256


def test_decoding_a_column_of_ids(spark):
    docs = awkward(spark, [(70, "naïve 😀 漢字 'll x"), (71, "a" * 9000)])
    tokens = byte_bpe.with_ids(docs, vocabulary_file()).cache()
    for r in tokens.collect():
        raw = [WORDS.tokens[i] for i in r.ids]
        assert r.offsets == [sum(map(len, raw[:k])) for k in range(len(raw))]
    found = byte_bpe.decode(tokens, vocabulary_file()).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in found) == sorted((r.doc_id or -1, (r.text or "").encode()) for r in docs.collect())
    odd = spark.createDataFrame([(1, None, None), (2, [], []), (3, [10**6], [0]), (4, [-1], [0])], "doc_id long, ids array<int>, offsets array<long>")
    assert {r.doc_id: r.bytes for r in byte_bpe.decode(odd, vocabulary_file()).collect()} == {1: b"", 2: b"", 3: None, 4: None}
    assert byte_bpe.decode(tokens.limit(0), vocabulary_file()).count() == 0
