"""Runs of words against a plain search of every period, on documents of all sorts and on the whole small table."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gaugeworks.llm import periodic_runs as P
from gaugeworks.llm.queries import QUERIES

from fixtures import awkward, prose


def plain_runs(words, least=24, exponent=3):
    """Every period in turn: stretches of words that equal the word a period later, unless a smaller period does as well."""
    n, found = len(words), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                stretch = words[i : i + length]
                if not any(stretch[q:] == stretch[: length - q] for q in range(1, p)):
                    found.append((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(8))
def test_refinement_finds_what_a_plain_search_finds(seed):
    rng = random.Random(seed)
    for _ in range(30):
        documents = []
        for _ in range(rng.randint(1, 6)):
            letters, n = rng.choice([1, 2, 3, 50]), rng.randint(0, 90)
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            documents.append(words)
        for least, exponent in ((24, 3), (1, 2), (4, 3)):
            found = P.runs([np.array(d, np.int64) for d in documents], least, exponent)
            assert found == [plain_runs(d, least, exponent) for d in documents]


def test_long_documents():
    rng = random.Random(3)
    root = [rng.randrange(5) for _ in range(700)]
    words = [9, *root * 4, 7, *[1] * 5000, *[2, 3] * 900]
    assert P.runs([np.array(words, np.int64)]) == [[(1, 2800, 700), (2801 + 1, 5000, 1), (7802, 1800, 2)]]


def _strict(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_query_on_the_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, small).collect()]
    assert sorted(found) == sorted(plain_row(*r) for r in docs)
    assert any(r[1] for r in found)


def test_awkward_documents(spark, tmp_path):
    loops = [(i, prose(30, i) + " " + (prose(7, 50 + i, "ab") + " \t") * 9 + "\x1cend\xa0end " * 40) for i in range(100, 140)]
    docs = awkward(spark, loops)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted((plain_row(r.doc_id, r.text) for r in docs.collect()), key=_strict)
    found = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.collect()), key=_strict) == expected
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_documents_side_by_side(spark):
    """No class has members of two documents."""
    rows = [(i, prose(60, i, "ab") + " x y z" * i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, P.periodic_runs(docs).select("doc_id", "n_runs", "start", "period").collect()))
    assert whole == sorted((i, *((len(f := plain_runs(t.split())), *((b[0], b[2]) if (b := P.strongest(f)) else (None, None))))) for i, t in rows)
