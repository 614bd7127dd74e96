"""The registered queries that SQL can't express, over whole small tables, against plain versions."""

import hashlib
import re
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken

from gaugeworks.llm.byte_bpe import Vocabulary
from gaugeworks.llm.queries import QUERIES, vocabulary_file

from fixtures import source_targets
from test_substring_dedup import brute


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").collect()


def test_op3(spark, small, docs):
    words = Vocabulary(vocabulary_file())
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    found = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, small).collect()}
    assert len(found) == len(docs)
    for r in docs:
        ids = theirs.encode_ordinary(r.text)
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_op4(spark, small, docs):
    found = QUERIES["op4_mixing"](spark, small).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
    targets = source_targets(dict(sizes))
    assert len(found) == len(docs) and sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in found:
        taken[source[r.doc_id]] += r.taken
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(targets[source[r.doc_id]])
    assert all(abs(taken[s] - targets[s]) <= 0.02 * targets[s] for s in sizes)


def test_op5(spark, small, docs):
    found = QUERIES["op5_substring_dedup"](spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == brute([(r.doc_id, r.text) for r in docs])


def test_op6(spark, small, docs):
    bags = {}
    for r in docs:
        words = r.text.lower().split()
        bags[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    found = {r.doc_id: r.class_id for r in QUERIES["op6_minhash_dedup"](spark, small).collect()}
    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            same = len(bags[a] & bags[b]) / len(bags[a] | bags[b])
            if same >= 0.85:
                assert found[a] == found[b]
    assert len({*found.values()}) >= len({frozenset(b) for b in bags.values()}) * 0.9


def test_op7_and_op8_and_op1_cover_their_tables(spark, small, docs):
    assert QUERIES["op7_quality_classifier"](spark, small).count() == len(docs)
    assert {r.doc_id for r in QUERIES["op8_language_id"](spark, small).collect()} == {r.doc_id for r in docs}
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    assert QUERIES["op1_additive_quantisation"](spark, small).count() == 20 * vectors.where("vec_id % 20 = 0").count()
