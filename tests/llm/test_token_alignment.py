"""Alignment against both libraries on whole texts and a plain walk over all tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import token_alignment as T
from gaugeworks.llm.queries import QUERIES, vocabulary_file

from fixtures import awkward, prose

FILES = vocabulary_file(name="byte_bpe_50k.json"), vocabulary_file(name="piece_bpe_32k.model"), P.PATTERN
SIDES = T.Sides(*FILES)
A = Tokenizer.from_str(FILES[0].decode())
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=FILES[1])
LETTERS = {c: bytes([b]) for c, b in T.byte_letters().items()}
PARTS = ["'s", " ", "  ", "\n", "\n ", "\r", "{\r", "\t", "\x85", "\xa0", "　", "a", "The", "é", "٣", "1", "<|endoftext|>", "<s>", "<0x41>", "漢字", "😀", "▁", "\x00", "ﬁ", "; ", "int main() {\r\n"]


def spelled(text):
    """Both sides' tokens as (id, bytes), or none."""
    if not text:
        return [], []
    a = [(i, b"".join(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])


def plain_groups(a, b):
    ends = []
    for side in (a, b):
        at, out = 0, []
        for _, raw in side:
            at += len(raw)
            out.append(at)
        ends.append(out)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = [], []
        while i < len(a) and ends[0][i] <= cut:
            group[0].append(a[i][0])
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            group[1].append(b[j][0])
            j += 1
        groups.append(group)
    return groups


def plain_rows(docs):
    linked, counts = [], Counter()
    for doc_id, text in docs:
        a, b = spelled(text)
        groups = plain_groups(a, b)
        times = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(times.keys())
        listed = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        linked.append((doc_id, len(a), len(b), len(groups), times, hashlib.sha256(listed.encode()).hexdigest() if groups else ""))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return [
        (doc_id, n_a, n_b, n_groups, sum(times.values()), sum(n for (x, y), n in times.items() if counts[x, y] == highest[x]), sum(n * counts[p] for p, n in times.items()), digest)
        for doc_id, n_a, n_b, n_groups, times, digest in linked
    ]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=4))
def test_parts_have_the_ids_that_whole_texts_have(texts):
    for text, found in zip(texts, SIDES.encode(texts)):
        a, b = spelled(text)
        assert (found is None and not a) or (found[0].tolist(), found[1].tolist()) == ([i for i, _ in a], [i for i, _ in b])


def test_tokens_begin_anew_when_too_many_are_known(monkeypatch):
    sides = T.Sides(*FILES)
    monkeypatch.setattr(T, "KNOWN_PARTS", 5)
    for seed in range(5):
        text = prose(60, seed)
        (found,) = sides.encode([text])
        assert found[0].tolist() == [i for i, _ in spelled(text)[0]]


@pytest.mark.parametrize("seed", range(6))
def test_the_machine_may_stop_anywhere(seed, monkeypatch):
    """Events in one piece, in many, and with groups that are large: the same groups and links."""
    rng = random.Random(seed)
    text = prose(150, seed) + " naïve 漢字 " * 5 + "\n" * rng.randint(1, 40) + "😀" * 30
    a, b = spelled(text)
    ids = [np.array([i for i, _ in side], np.int64) for side in (a, b)]
    groups = plain_groups(a, b)
    links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
    if seed % 2:
        monkeypatch.setattr(T, "LARGE_GROUP", 3)
        monkeypatch.setattr(T, "HELD_PAIRS", 40)
    ends = [np.cumsum(SIDES.sizes[k][ids[k]]) for k in (0, 1)]
    cuts = sorted(rng.sample(range(1, int(ends[0][-1])), rng.randint(0, 30)))
    machine = T.Sweep(SIDES)
    before = [0, 0]
    for cut in [*cuts, int(ends[0][-1])]:
        now = [int(np.searchsorted(e, cut, "right")) for e in ends]
        machine.events(*(ids[k][before[k] : now[k]] for k in (0, 1)))
        before = now
    pairs, times = machine.links()
    assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times)} == links
    assert (machine.n_groups, machine.n_links) == (len(groups), sum(links.values()))
    listed = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
    assert machine.hash.hexdigest() == hashlib.sha256(listed.encode()).hexdigest()


def strict(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_query_on_the_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op11_token_alignment"](spark, small)
    assert sorted(map(tuple, found.collect())) == sorted(plain_rows(docs))


@pytest.mark.parametrize("broadcast_pairs", [0, 60, 1 << 20])
def test_awkward_documents(spark, broadcast_pairs):
    docs = awkward(spark, [(70, "naïve 😀 漢字 'll x"), (71, "a" * 9000), (72, "<|endoftext|>b <s>"), (73, "x▁y"), (74, prose(20_000, 5)), (75, " lead and trail "), (76, " ")])
    expected = plain_rows([(r.doc_id, r.text) for r in docs.collect()])
    found = T.align(docs, *FILES, broadcast_pairs=broadcast_pairs)
    assert sorted((tuple(r) for r in found.collect()), key=strict) == sorted(expected, key=strict)


def test_empty_table_and_links(spark):
    docs = awkward(spark)
    assert T.align(docs.limit(0), *FILES).count() == 0
    (r,) = T.links(docs.where("doc_id = 9"), *FILES).collect()
    a, b = spelled("one")
    assert (r.doc_id, r.a, r.b, r.times) == (9, a[0][0], b[0][0], 1)
    assert T.frequent_from(spark.createDataFrame([(1, 8), (2, 8), (3, 7), (4, 1)], "pair long, n long"), 3) == 4


def test_packed_ids():
    ids = np.array([0, 1, 255, 256, 65535, 65536, 50256, 2**31], np.int64)
    assert T.unpack(T.pack(ids)).tolist() == ids.tolist() and T.unpack(T.pack(ids[:0])).tolist() == []
