"""Word BPE against the library, and the lexicon automaton against a dictionary."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import word_bpe as W
from gaugeworks.llm.queries import QUERIES, vocabulary_file
from gaugeworks.llm.transducer import Lexicon, compile_lexicon

from fixtures import awkward, prose

FILE = vocabulary_file(name="word_bpe_49k.json")
OURS = W.WordBpe(FILE)
THEIRS = Tokenizer.from_str(FILE.decode())
PARTS = ["'s", "'ll", "'", " ", "\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "a", "The", "Σ", "ΑΣ ", "İ", "É", "é", " ́", "9", "٣", "Ⅷ", "!?", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "漢字", "한", "😀", "▁", "\x00", "\x7f", "ﬁ", "가", "ß"]


def theirs(text):
    found = THEIRS.encode(text, add_special_tokens=False)
    return found.ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=4))
def test_encodes_and_decodes_as_the_library_does(texts):
    for text, ids in zip(texts, OURS.encode(texts)):
        assert ids.tolist() == theirs(text)
        assert OURS.decode(ids) == THEIRS.decode(ids.tolist(), skip_special_tokens=False)


def test_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 100_000):
        texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[j : j + 1000]) for j in range(i, min(i + 100_000, len(points)), 1000)]
        for text, ids in zip(texts, OURS.encode(texts)):
            assert ids.tolist() == theirs(text)


def test_long_words():
    for text in ("a" * 9000, "ab" * 24, "ab" * 25, "=;" * 3000, "'re" * 60, "x" + "́" * 500, prose(500, 1) * 3):
        assert OURS.encode([text])[0].tolist() == theirs(text)


def looked(lexicon, words):
    found, numbers, bounds = lexicon.look_up(words)
    return [tuple(numbers[a:b].tolist()) if ok else None for ok, a, b in zip(found, bounds, bounds[1:])]


@pytest.mark.parametrize("seed", range(5))
def test_lexicon_holds_what_was_put_in_and_shares_endings(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choices(b"abc\xc3", k=rng.randint(1, 7))) for _ in range(600)} | {b"", b"a", b"aa"})
    entries = {w: tuple(rng.choices(range(9), k=rng.randint(0, 4))) for w in words}
    lexicon = Lexicon(compile_lexicon(entries.items()))
    asked = words + [bytes(rng.choices(b"abcd", k=rng.randint(0, 8))) for _ in range(600)]
    rng.shuffle(asked)
    assert looked(lexicon, asked) == [entries.get(w) for w in asked]


def test_automaton_is_minimal():
    stems = [f"{a}{b}".encode() for a in "abcdefgh" for b in "klmnop"]
    entries = [(s + e, (i,)) for i, s in enumerate(stems) for e in (b"ed", b"ing", b"s")]
    lexicon = Lexicon(compile_lexicon(entries))
    # ed, ing and s end alike: 8 arcs for first letters, 48 for second ones, then e, i, s, d, n, g and the mark behind s, d, g
    assert len(lexicon.keys) == 8 + 48 + 3 + 3 + 1 and lexicon.root == 8 + 6
    assert looked(Lexicon(compile_lexicon([])), [b"a", b""]) == [None, None]
    with pytest.raises(ValueError):
        compile_lexicon([(b"a", (1,)), (b"a", (2,))])


def test_lexicon_never_changes_ids(spark, tmp_path):
    texts = [prose(400, s, "abcde") + " It's <|endoftext|>ÉTÉ 12" for s in range(4)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    file = tmp_path / "lexicon"
    for words in (0, 1, 50, 100_000):
        file.write_bytes(W.lexicon_block(docs, FILE, words=words))
        assert [i.tolist() for i in OURS.encode(texts, Lexicon.mapped(str(file)))] == list(map(theirs, texts))


def row(doc_id, text):
    ids = theirs(text or "")
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_on_the_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op12_word_bpe"](spark, small).collect())) == sorted(row(*r) for r in docs)


def test_awkward_documents(spark):
    docs = awkward(spark, [(70, "naïve 😀 漢字 'll x"), (71, "a" * 9000), (72, "<|startoftext|>b")])
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, W.digests(docs, FILE, words=40).collect()), key=key) == sorted((row(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert W.digests(docs.limit(0), FILE).count() == 0
    tokens = W.with_ids(docs.where("doc_id in (9, 70, 72)"), FILE, words=40)
    decoded = {r.doc_id: r.text for r in W.decode(tokens, FILE).collect()}
    assert decoded == {9: "one</w>", 70: OURS.decode(theirs("naïve 😀 漢字 'll x")), 72: "<|startoftext|> b</w>"}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6]), (4, [-1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in W.decode(odd, FILE).collect()} == {1: "", 2: "", 3: None, 4: None}
