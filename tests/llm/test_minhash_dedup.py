from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeworks.llm import minhash_dedup as M

from fixtures import awkward, prose


def bag(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def test_shingles_are_runs_of_five_words():
    texts = ["a b c d e f", "", "x", "A  b\tc d e\nf", "a b c d e f a b c d e"]
    hashes, counts, sizes = M.bags(texts)
    assert sizes.tolist() == [len(bag(t) or ()) for t in texts]
    parts = np.split(hashes, np.cumsum(sizes)[:-1])
    assert parts[0].tolist() == parts[3].tolist() and counts.sum() == sum(sum((bag(t) or {}).values()) for t in texts)


def test_samples_agree_as_often_as_bags_do():
    a = prose(400, 1).split()
    b = list(a)
    b[50], b[200] = "x", "y"
    texts = [" ".join(a), " ".join(b)]
    hashes, counts, sizes = M.bags(texts)
    samples = M.icws(hashes, np.log(counts), sizes, 600)
    x, y = map(bag, texts)
    assert np.mean(samples[0] == samples[1]) == pytest.approx(sum((x & y).values()) / sum((x | y).values()), abs=0.05)


def near(seed, changes):
    words = prose(300, seed).split()
    for i in changes:
        words[i] = f"new{i}"
    return " ".join(words)


def test_classes_by_brute_force(spark):
    extra = [(100 + 10 * s + k, near(s, range(k * 7, k * 70, 70))) for s in range(8) for k in range(5)]
    extra += [(500 + i, prose(50, 77) + " " + prose(200, 1000 + i)) for i in range(60)]
    docs = awkward(spark, extra)
    rows = docs.collect()
    found = M.near_dedup(docs).collect()
    assert len(found) == len(rows)
    idf = M.idf_table(*M.document_frequencies(docs))
    texts = [r.text for r in rows if bag(r.text)]
    ids = [M.NO_ID if r.doc_id is None else r.doc_id for r in rows if bag(r.text)]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for s, j in zip(M._similarities([texts[i]] * i, texts[:i], idf) if i else [], range(i)):
            if s >= 0.8:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[top(i)].append(ids[i])
    expected = sorted((i, min(g)) for g in groups.values() for i in g)
    without = [r.doc_id for r in rows if not bag(r.text)]
    got = sorted((M.NO_ID if r.doc_id is None else r.doc_id, M.NO_ID if r.class_id is None else r.class_id) for r in found)
    expected = sorted(expected + [(M.NO_ID if i is None else i,) * 2 for i in without])
    assert got == expected
    kept = M.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups) + len(without)


def test_large_buckets_lose_no_class(spark):
    docs = spark.createDataFrame([(i, near(1, [i % 290])) for i in range(290)] + [(1000 + i, near(1, [i % 290])) for i in range(30)], "doc_id long, text string")
    assert {r.class_id for r in M.near_dedup(docs).collect()} == {0}


def brute_classes(texts, idf):
    """The smallest index that each text is linked to, directly or not."""
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(1, len(texts)):
        for j, s in enumerate(M._similarities([texts[i]] * i, texts[:i], idf)):
            if s >= 0.8:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def templates(n):
    """Texts of one template, most pairs of which are below the threshold; some chains reach it."""
    rng = np.random.default_rng(5)
    return [near_words(i, rng.choice(280, 4 if i % 3 else 3, replace=False) + 5) for i in range(n)]


def near_words(i, places):
    words = prose(300, 1).split()
    for k in places:
        words[k] = f"n{i}x{k}"
    return " ".join(words)


def test_templates_below_the_threshold_lose_no_link(spark):
    texts = templates(200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_classes(texts, M.idf_table(*M.document_frequencies(docs)))
    assert 1 < len(set(expected)) < len(texts)
    assert [r.class_id for r in M.near_dedup(docs).orderBy("doc_id").collect()] == expected


@pytest.mark.parametrize("common", [14, 26])
def test_pairs_in_a_crowd_lose_no_link(spark, common):
    texts = []
    for i in range(200):
        own = prose(300, 1) + " " + prose(common, 1000 + i // 2, "ijklmnop") + " " + prose(20, 5000 + i, "qrstuvwx")
        texts.append(own)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_classes(texts, M.idf_table(*M.document_frequencies(docs)))
    assert [r.class_id for r in M.near_dedup(docs).orderBy("doc_id").collect()] == expected


def test_weights_do_not_depend_on_the_size_of_the_table():
    rng = np.random.default_rng(1)
    tables = []
    for total in (50_000, 5_000_000):
        counts = rng.poisson(total * 300 / M.DF_BUCKETS, M.DF_BUCKETS).astype(float)
        counts[7] += total / 3
        counts[9] += total / 100
        tables.append(M.idf_table(counts, total))
        assert np.median(tables[-1]) == tables[-1].max() == 1 + M.IDF_RANGE
    assert tables[0][[7, 9]] == pytest.approx(tables[1][[7, 9]], abs=0.01) and 1 < tables[0][7] < tables[0][9] < 1 + M.IDF_RANGE


@pytest.mark.parametrize("split", [0, 40])
def test_blocks_join_what_brute_force_joins(split):
    texts = templates(99) + ["", "a b a b a b a b a b a b", "a b a b a b a b a b a b a"]
    idf = np.linspace(1, 2, M.DF_BUCKETS)
    links = {tuple(sorted(p)) for p in M.block_links(texts, list(range(len(texts))), split, idf, 0.8)}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if bag(texts[i]) and bag(texts[j]) and (not split or i < split <= j)]
    good = {p for p, s in zip(pairs, M._similarities([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs], idf)) if s >= 0.8}

    def joined(edges):
        label = list(range(len(texts)))
        for _ in texts:
            for i, j in edges:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert links <= good and joined(links) == joined(good)


def test_empty(spark):
    assert M.near_dedup(awkward(spark).limit(0)).count() == 0 and M.drop_near_copies(awkward(spark).limit(0)).count() == 0


def test_later_links_join_classes(spark):
    """The smallest digest names a class, whether its links come at once or later; only the classes they join are looked at."""
    name = lambda i: i.to_bytes(2, "big")
    chains = [(i, i + 1) for n in range(0, 90, 30) for i in range(n, n + 29)]
    frame = lambda rows: spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in rows], "a binary, b binary")
    found = {bytes(r.digest): bytes(r.label) for r in M.components(frame(chains)).collect()}
    assert found == {name(i): name(i // 30 * 30) for i in range(90)}
    labels = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in found.items()] + [(bytearray(name(99)),) * 2], "digest binary, label binary")
    more = {bytes(r.digest): bytes(r.label) for r in M.joined(labels, frame([(70, 45), (62, 61)])).collect()}
    assert more == {name(i): name(0 if i < 30 else 30) for i in range(90)} | {name(99): name(99)}
    none = {bytes(r.digest): bytes(r.label) for r in M.joined(labels, frame([])).collect()}
    assert none == found | {name(99): name(99)}
