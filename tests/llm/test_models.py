import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from gaugeworks.llm import additive_quantisation as Q
from gaugeworks.llm import language_id, quality_classifier, url_filter

from fixtures import awkward, prose


def test_language_by_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    score = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert score[0] >= 0.95 and 0 <= score[1] <= score[2] <= 1


def test_language_of_awkward_texts(spark):
    docs = awkward(spark, [(60 + i, prose(60, i, "mnopqr")) for i in range(8)] + [(90, "123 ²³ !!")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") >= 60, "zz").otherwise(F.col("lang")))
    found = language_id.language_id(docs).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 8, 90))
    assert by[1].lang_pred == "en" and by[62].lang_pred == "zz"
    kept = language_id.keep_languages(docs)
    assert kept.columns == docs.columns and {4, 5, 8, 90}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_language_id(rows):
    """(lang, score) of each (doc_id, text, lang), by the docstring: counts of all, then one text after the other."""
    words, size, letters = defaultdict(Counter), defaultdict(Counter), regex.compile(r"\p{L}+")
    learned = [(t, lang) for i, t, lang in rows if t and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    for text, lang in learned:
        words[lang].update(letters.findall(text.lower()))
    langs = sorted(lang for lang in words if words[lang])
    table = {0: words}
    for k in language_id.ORDERS:
        table[k] = defaultdict(Counter)
        for lang in langs:
            for w, n in words[lang].items():
                for i in range(len(w) + 3 - k):
                    table[k][lang][f" {w} "[i : i + k]] += n
    total = {k: {lang: sum(t[lang].values()) for lang in langs} for k, t in table.items()}
    kept = {k: {x for lang in langs for x in t[lang]} for k, t in table.items()}

    def logs(k, token):
        seen = [(table[k][lang][token], total[k][lang]) for lang in langs]
        return np.array([math.log(n / of if n else 0.5 / max(total[k].values())) for n, of in seen])

    def score(word):
        if word in kept[0]:
            return logs(0, word)
        for k in reversed(language_id.ORDERS):
            found = [g for i in range(len(word) + 3 - k) if (g := f" {word} "[i : i + k]) in kept[k]]
            if found:
                return np.mean([logs(k, g) for g in found], 0)
        return np.zeros(len(langs))

    out, known = [], {}
    for _, text, _ in rows:
        found = letters.findall((text or "").lower())
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        sums = sum(known[w] if w in known else known.setdefault(w, score(w)) for w in found)
        weights = np.exp(sums - sums.max())
        out.append((langs[int(np.argmax(sums))], weights.max() / weights.sum()))
    return out


def test_language_by_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(90_001 + i, t, "en") for i, t in enumerate(["m² İstanbul ΟΔΟΣ Ⅷ x½y", "", None, "12 !", "日本語 テスト", "b"])] + [(90100, "b", "zz")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = docs.collect()
    found = {(r.doc_id, r.text): r for r in language_id.language_id(docs).join(docs, "doc_id").collect()}
    for (i, text, _), (lang, score) in zip(rows, plain_language_id(rows)):
        assert found[i, text].lang_pred == lang and found[i, text].score == pytest.approx(score, abs=1e-3)


def test_ties_go_to_the_smallest_language(spark):
    rows = [(0, "same words", "b"), (3, "same words", "a"), (1, "same words", None)]
    assert {zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows[:2]} == {False}
    found = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("a", 0.5)}


@pytest.mark.parametrize("cached", [0, 3])
def test_what_is_cached_changes_nothing(spark, small, monkeypatch, cached):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = {tuple(r) for r in language_id.language_id(docs).collect()}
    kept = sorted(r.doc_id for r in language_id.keep_languages(docs).collect())
    monkeypatch.setattr(language_id, "CACHED_WORDS", cached)
    assert {tuple(r) for r in language_id.language_id(docs).collect()} == whole
    assert sorted(r.doc_id for r in language_id.keep_languages(docs).collect()) == kept


def test_a_word_seen_once_has_its_counts_in_all_languages(spark):
    rows = [("zed " * 15 + "alpha " * 85, "a"), ("zed " * 5 + "once " + "beta " * 94, "b")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    words = {(model.langs[r.lang], r.token): np.exp(r.gain / language_id.UNIT) for r in model.tokens.where("size = 0").collect()}
    assert words == {k: pytest.approx(2 * n) for k, n in {("a", "zed"): 15, ("a", "alpha"): 85, ("b", "zed"): 5, ("b", "once"): 1, ("b", "beta"): 94}.items()}


def test_cached_words_come_to_the_driver_as_columns(spark):
    docs = spark.range(20).selectExpr("transform(sequence(0, 1999), i -> translate(format_number(id * 2000 + i, 0), '0123456789,', 'abcdefghij')) AS w", "concat('l', id % 4) AS lang")
    docs = docs.selectExpr("array_join(w, ' ') AS text", "lang").unionByName(docs.selectExpr("array_join(w, ' ') AS text", "'l9' AS lang"))
    language_id.train(docs.limit(0))  # imports
    tracemalloc.start()
    words, gains = language_id.train(docs).known
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words.split("\n")) == len(gains) == 40_000 and ((gains != 0).sum(1) == 2).all()
    assert most < 300 * len(gains)  # bytes of Python objects; row objects take over 1,000


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CACHED_CELLS", 20_000)  # 100 words of 200 languages
    rows = [(200 * j + i, " ".join(f"{chr(0x4E00 + i)}{c}" for c in "abcdefgh"), f"l{i:03}") for i in range(200) for j in range(4)]
    found = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    by = {r.doc_id: r.lang_pred for r in found.collect()}
    assert len(by) == 800 and all(by[i] == lang for i, _, lang in rows if lang in learned)


def test_a_frequent_unseen_word_is_looked_up_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HEAVY", 4)
    rows = [(i, "plain words here", "a") for i in range(20)] + [(20 + i, "autres mots ici", "b") for i in range(20)]
    rows += [(100 + i, "motsici wort" if i % 3 else "hereplain", None) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.language_id(table).collect()}
    for (i, *_), (lang, score) in zip(rows, plain_language_id(rows)):
        assert found[i].lang_pred == lang and found[i].score == pytest.approx(score, abs=1e-6)


def test_quality_by_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier.quality(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    right = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right >= 0.9


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    found = quality_classifier.quality(docs, labels).collect()
    assert len(found) == docs.count() and {r.score for r in found} == {1.0}
    assert {r.score for r in quality_classifier.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality(docs.limit(0), labels).count() == 0
    many = spark.range(40).selectExpr("id as doc_id", "if(id % 2 = 0, 'good words ', 'bad thing ') as text", "'x' as t", "1 as y", "2 as handed")
    many = many.unionByName(many)  # ties, repeated rows, clashing columns, no fields beside the text
    judged = many.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality").distinct().where("doc_id < 30")
    found = quality_classifier.quality(many, judged).collect()
    assert len(found) == 80 and all(r.kept == (r.doc_id % 2 == 0) for r in found)


def plain_co_training(rows, labels, rounds, per_round, labelled):
    """The score of each row (doc_id, text, source, lang, n_chars), by the docstring, with every row at hand."""
    C = quality_classifier
    votes = defaultdict(list)
    for i, q in labels:
        votes[i].append(q)
    known = {i: int(np.mean(v) >= 0.5) for i, v in votes.items()}
    share = np.mean(list(known.values()))
    views = C._views(*zip(*(r[1:] for r in rows)))
    place = {r[0]: n for n, r in enumerate(rows)}
    assert len(place) == len(rows) and len(known) <= labelled
    first = sorted(i for i in known if i in place)
    handed, shares = {0: {}, 1: {}}, (1 - share, share)

    def fit():
        ids, y, h = list(first), [known[i] for i in first], [-1] * len(first)
        for v in (0, 1):
            for i, c in sorted(handed[v].items()):
                ids, y, h = [*ids, i], [*y, c], [*h, v]
        at = [place[i] for i in ids]
        return C.fit_views([x[at] for x in views], np.array(y), np.array(h), shares)

    model = fit()
    for _ in range(rounds):
        sure, new = C.sureness(views, model), {0: {}, 1: {}}
        for v in (0, 1):
            for c in (0, 1):
                free = [(-sure[v][c][n], i) for i, n in place.items() if i not in known and i not in handed[1 - v]]
                best = sorted(x for x in free if -x[0] >= C.SURE)[: max(1, round(per_round * shares[c]))]
                new[1 - v] |= {i: c for _, i in best}
        if not any(new.values()):
            break
        for v in (0, 1):
            handed[v] |= new[v]
        model = fit()
    return C.score({"share": share} | model, *views)[0], handed


def test_quality_by_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id % 3 <> 0").select("doc_id", "quality")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang", "n_chars").collect()]
    expected, handed = plain_co_training(rows, [tuple(r) for r in labels.collect()], 2, 40, 8000)
    assert handed[1] and not set(handed[0]) - {r[0] for r in rows}
    found = {r.doc_id: r.score for r in quality_classifier.quality(docs, labels, rounds=2, per_round=40).collect()}
    assert [found[r[0]] for r in rows] == pytest.approx(expected.tolist(), abs=2e-3)


def test_views_see_their_own_side_only():
    C = quality_classifier
    one, two = C._views(["a text", "another"], ["s", "s"], ["en", "en"], [5, 5]), C._views(["a text", "a text"], ["s", None], ["en", None], [5, None])
    assert (one[1][0] == one[1][1]).all() and (one[0][0] != one[0][1]).any()
    assert (two[0][0] == two[0][1]).all() and (two[1][0] != two[1][1]).any()


@pytest.mark.parametrize("table,block,groups", [("sf0.001", Q.BLOCK, Q.QUERIES), ("sf0.1", 2048, 256)])
def test_recall_of_additive_quantisation(spark, small, monkeypatch, table, block, groups):
    monkeypatch.setattr(Q, "BLOCK", block)
    monkeypatch.setattr(Q, "QUERIES", groups)
    rows = spark.read.parquet(f"{small}/../{table}/embeddings.parquet")
    found = defaultdict(list)
    for r in Q.nearest(rows).collect():
        found[r.query_id].append(r)
    v = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids = np.array(sorted(v))
    every = np.array([v[i] for i in ids])
    hits = total = 0
    for q in (i for i in ids if i % 20 == 0):
        score = every @ v[q]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        ours = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in ours] == list(range(1, 21)) and all(r.score == pytest.approx(v[q] @ v[r.vec_id]) for r in ours)
        assert [r.vec_id for r in sorted(ours, key=lambda r: (-r.score, r.vec_id))] == [r.vec_id for r in ours]
        hits += len(set(best) & {r.vec_id for r in ours})
        total += 20
    assert hits / total >= 0.98


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.5, 0.5]), (21, [0.5, 0.5]), (22, None), (23, [0.0, 0.0]), (24, [float("nan"), 1.0]), (40, [1.0, None]), (None, [1.0, 1.0]), (25, []), (26, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 1.0, 1, b"x") for r in rows], "vec_id long, embedding array<float>, score double, row int, code binary")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in Q.nearest(df).collect())
    assert found == [(0, 1, 20, 0.5), (0, 2, 21, 0.5), (0, 3, 21, 0.5), (20, 1, 0, 0.5), (20, 2, 21, 0.5), (20, 3, 21, 0.5)]
    same = spark.range(3000).selectExpr("id % 1500 as vec_id", "array(1.0, if(id = 3, 2.0, 1.0)) as embedding")
    best = Q.nearest(same).where("query_id = 40").groupBy("rank").agg(F.collect_set("vec_id").alias("ids"), F.count("*").alias("n")).orderBy("rank").collect()
    others = [0, 0, 1, 1, 2, 2, 3, *(i // 2 for i in range(8, 20))]
    assert [r.ids for r in best] == [[3], *([i] for i in others)] and {r.n for r in best} == {2}
    assert Q.nearest(df.limit(0)).count() == 0


def test_url_intervals(spark):
    log = [("host", "a.com", 1, "add"), ("host", "a.com", 5, "remove"), ("host", "a.com", 9, "add"), ("host", "a.com", 9, "remove"), ("domain", "b.org", 3, "add"),
           ("host", None, 1, "add"), ("host", "c.com", 2, "remove"), ("prefix", "d.com/x", 0, "add"), ("host", "a.com", 2, "add")]
    entries = spark.createDataFrame(log, "kind string, key string, day int, action string")
    urls = [(1, "http://www.A.com:80/p", 1), (2, "http://a.com", 4), (3, "http://a.com", 5), (4, "http://a.com", 9), (5, "https://u@x.y.b.org/", 3), (6, "https://b.org", 2),
            (7, None, 3), (8, "no url", 3), (9, "http://d.com/x/y?z", 0), (10, "http://d.com/xx", 0), (11, "http://a.com", None), (2, "http://a.com", 4)]
    captures = spark.createDataFrame([(*u, "clash") for u in urls], "page_id int, url string, day int, key string")
    for rows, heavy in ((200_000, 10_000), (0, 10_000), (200_000, 1)):
        found = url_filter.url_filter(captures, entries, "page_id", "url", "day", broadcast_rows=rows, heavy_rows=heavy).collect()
        assert sorted((r.id, r.first_match) for r in found if r.blocked) == [(1, "host a.com"), (2, "host a.com"), (2, "host a.com"), (5, "domain b.org"), (9, "prefix d.com/x")]
        assert len(found) == 12
    assert url_filter.url_filter(captures, entries.limit(0), "page_id", "url", "day").where("blocked").count() == 0
    assert url_filter.url_filter(captures.limit(0), entries, "page_id", "url", "day").count() == 0


def test_url_filter_of_one_key_with_a_long_log(spark):
    entries = spark.range(20_000).selectExpr("'host' as kind", "'a.com' as key", "id * 3 as day", "if(id % 2 = 0, 'add', 'remove') as action")
    captures = spark.range(10_000).selectExpr("id as row", "'http://a.com/x' as time", "id * 6 % 60013 as id")
    found = url_filter.url_filter(captures, entries, "row", "time", "id", heavy_rows=1500).collect()
    assert len(found) == 10_000 and all(r.blocked == (r.time // 3 % 2 == 0) for r in found if r.time < 59_997)


@pytest.mark.parametrize("power", [0, 150, 200, -150, -200, None])
def test_search_takes_components_of_any_size(spark, power):
    """Every finite vector takes part; scores are those of a plain double product, and the order is theirs."""
    rng = np.random.default_rng(7)
    points = rng.normal(size=(200, 12))
    size = np.full(200, 10.0**power) if power is not None else 10.0 ** rng.choice([-150, 0, 140], 200)
    points *= size[:, None]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = Q.nearest(df).collect()
    assert len(found) == 200  # ten queries of twenty
    for q in range(0, 200, 20):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        scores = {}
        for i, p in enumerate(points):
            total = 0.0
            for x, y in zip(p.tolist(), points[q].tolist()):
                total += x * y
            scores[i] = total
        assert all(r.score == scores[r.vec_id] or math.isnan(r.score) and math.isnan(scores[r.vec_id]) for r in mine)
        if power != 200:  # there products are infinite
            best = sorted((i for i in scores if i != q), key=lambda i: (-scores[i], i))[:20]
            assert [r.vec_id for r in mine] == best


def test_tokens_send_nothing_again(spark, small):
    """What turns counts into gains is part of the expression: no use of the tokens sends a table of scales to all tasks."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    assert "Broadcast" not in model.tokens._jdf.queryExecution().executedPlan().toString()
    rows = [(1, None, "en"), (2, "12 34", "aa"), (3, "words of a text", "fr"), (4, "other words", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = language_id.train(frame)
    assert some.langs == ["fr"] and {r.lang for r in some.tokens.select("lang").distinct().collect()} == {0}
    none = language_id.train(frame.where("doc_id < 3"))
    assert none.langs == [] and none.tokens.count() == 0
