import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import substring_dedup as S
from gaugeworks.llm import suffix_array as SA
from gaugeworks.llm.common import NO_ID

from fixtures import awkward, prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.booleans())
def test_suffix_array_and_prefixes(values, singly):
    text = np.append(np.array(values, np.int64), 0)
    before = SA.WAVE_ALPHABET
    try:
        SA.WAVE_ALPHABET = 0 if singly else before
        array = SA.suffix_array(text)
    finally:
        SA.WAVE_ALPHABET = before
    assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    prefixes = SA.permuted_prefixes(text, array, np.array([0]), 6)
    for a, b in zip(array[1:], array[:-1]):
        n = 0
        while n < 6 and a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert prefixes[a] == n


def brute(rows):
    first = {}
    raws = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in sorted(raws):
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((None if i == NO_ID else i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part,hot,block", [(512, 20_000, 1 << 16), (1, 20_000, 1 << 16), (3, 4, 64), (512, 2, 1 << 16)])
def test_substring_dedup_by_brute_force(spark, monkeypatch, part, hot, block):
    rng = random.Random(5)
    shared = [prose(20, 100 + i) for i in range(4)]
    extra = [(50 + i, " ".join(rng.choice(shared)[rng.randint(0, 30) :] + prose(3, i) for _ in range(4))) for i in range(40)]
    # one anchor in every document, with other bytes on either side or on both
    extra += [(100 + i, prose(4, 300 + i) + shared[0][: 20 + i] + prose(6, 400 + i)) for i in range(30)]
    extra += [(140 + i, shared[1][i : i + 75] + prose(6, 500 + i)) for i in range(30)]
    extra += [(200 + i, "=" * (40 + i * 7)) for i in range(4)] + [(300, "é" * 60), (301, "é" * 61)]
    docs = awkward(spark, extra)
    monkeypatch.setattr(S, "BLOCK", block)
    found = sorted((tuple(r[:4]) + (hashlib.sha256(r.kept).hexdigest(),) for r in S.substring_dedup(docs, part_passages=part, hot_docs=hot).collect()), key=repr)
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert S.substring_dedup(awkward(spark).limit(0)).count() == 0
