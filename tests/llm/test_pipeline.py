import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from gaugeworks.llm import minhash_dedup as M
from gaugeworks.llm.byte_bpe import Vocabulary
from gaugeworks.llm.common import NO_ID, written
from gaugeworks.llm.queries import vocabulary_file

from fixtures import awkward, source_targets
from test_minhash_dedup import bag, brute_classes
from test_models import plain_language_id


def plain_stages(docs):
    """The rows (doc_id, text, lang, source) that each of the first three stages should keep, one after the other."""
    found = plain_language_id([(r.doc_id, r.text, r.lang) for r in docs])
    kept = [r for r, (lang, score) in zip(docs, found) if lang != "und" and score >= 0.4]
    yield kept
    last = {}
    for r in kept:
        last[r.text] = max(last.get(r.text, NO_ID), NO_ID if r.doc_id is None else r.doc_id)
    once = {r.text: r for r in kept if (NO_ID if r.doc_id is None else r.doc_id) == last[r.text]}
    yield list(once.values())
    rows = sorted(once.values(), key=lambda r: NO_ID if r.doc_id is None else r.doc_id)
    counts = Counter(s for r in rows for s in bag(r.text))
    assert counts
    yield rows


def key(r):
    return NO_ID if r.doc_id is None else r.doc_id, r.text


@pytest.mark.parametrize("kind", ["table", "awkward"])
def test_every_stage_by_brute_force(spark, small, kind):
    if kind == "table":
        docs = spark.read.parquet(f"{small}/documents.parquet")
    else:
        docs = awkward(spark, [(1, "one more text of these words here", ), (1, "one more text of these words here"), (2, "naïve 😀 words of a text")])
    columns, frame, stages = docs.columns, docs, iter(plain_stages(docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:2]:
        frame = written(stage(spark, frame, small), "test")
        assert frame.columns == columns
        assert sorted(map(key, frame.collect())) == sorted(map(key, next(stages))), name
    before = next(stages)
    idf = M.idf_table(*M.document_frequencies(frame))
    classes = brute_classes([r.text for r in before], idf)
    frame = written(corpus_pipeline.STAGES[2][1](spark, frame, small), "test")
    assert frame.columns == columns and sorted(map(key, frame.collect())) == sorted(key(r) for i, r in enumerate(before) if classes[i] == i)
    left = frame.collect()
    frame = written(corpus_pipeline.STAGES[3][1](spark, frame, small), "test")
    times, sizes, taken = Counter(map(key, frame.collect())), defaultdict(int), defaultdict(int)
    assert frame.columns == columns and set(times) <= set(map(key, left)) and max(times.values(), default=0) <= 2
    for r in left:
        n = len(r.text.split())
        sizes[r.source] += n
        taken[r.source] += n * times[key(r)]
    targets = source_targets(dict(sizes))
    longest = max(len(r.text.split()) for r in left)
    assert all(targets[s] - longest <= taken[s] <= targets[s] + 1 for s in sizes)
    words = Vocabulary(vocabulary_file())
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    tokens = corpus_pipeline.STAGES[4][1](spark, frame, small).collect()
    expected = Counter()
    for (i, text), n in times.items():
        expected[i, tuple(theirs.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest()] += n
    assert Counter((NO_ID if r.doc_id is None else r.doc_id, tuple(r.ids), r.decoded_sha256) for r in tokens) == expected
    if kind == "table":
        assert corpus_pipeline.run(spark, small).count() == len(tokens)


def test_a_named_run_is_taken_up_again(spark, small, monkeypatch):
    calls = []

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if name == "c" and calls.count("c") == 1:
                raise RuntimeError("lost")
            return stage(docs)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, lambda d: d.limit(5)) for n in "abc"] + [counted("d", lambda d: d)])
    name = hashlib.sha256(str(id(calls)).encode()).hexdigest()
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, small, resume=name)
    assert corpus_pipeline.run(spark, small, resume=name).count() == 5
    assert calls == ["a", "b", "c", "c", "d"]


def test_awkward_documents_go_through(spark):
    none = awkward(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, ""), "test")
    assert none.count() == 0
