import hashlib
import string
import uuid
from collections import Counter, defaultdict

import pytest

from gaugeworks.llm import exact_dedup, line_dedup
from gaugeworks.llm.common import NO_ID

from fixtures import awkward


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_dedup_by_brute_force(spark):
    docs = awkward(spark)
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[sha(r.text)].append(r.doc_id)
    found = exact_dedup.exact_dedup(docs).collect()
    expected = Counter((r.doc_id, max(groups[sha(r.text)], key=lambda x: NO_ID if x is None else x), len(groups[sha(r.text)]), sha(r.text)) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_heavy_groups_give_the_same(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'copy' else cast(id as string) end as text")
    found = exact_dedup.exact_dedup(docs).where("group_size > 1").collect()
    assert len(found) == 1500 and {(r.keep_id, r.group_size) for r in found} == {(2998, 1500)} and sum(r.kept for r in found) == 1
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_BITS", 0)
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 1501
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_BITS", exact_dedup.BLOCK_BITS)
    more = docs.unionByName(docs.selectExpr("doc_id", "concat('again ', doc_id % 1400) as text"))
    kept = exact_dedup.drop_exact_copies(more).collect()
    assert len(kept) == len({r.text for r in kept}) == 1501 + 1400
    assert {r.doc_id for r in kept if r.text == "copy"} == {2998} and {r.doc_id for r in kept if r.text == "again 3"} == {2803}


def test_ties_are_settled_alike(spark):
    rows = [(1, "same", i) for i in range(20)] + [(1, "same", 3)] * 3 + [(None, None, 5), (None, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    found = {tuple(r) for n in (1, 7) for r in exact_dedup.drop_exact_copies(docs.repartition(n)).collect()}
    assert len(found) == 2 and exact_dedup.drop_exact_copies(docs).count() == 2


def test_drop_exact_copies_keeps_columns(spark):
    docs = awkward(spark)
    found = exact_dedup.drop_exact_copies(docs)
    assert found.columns == docs.columns
    assert sorted(sha(r.text) for r in found.collect()) == sorted({sha(r.text) for r in docs.collect()})


def test_empty_tables(spark):
    none = awkward(spark).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0


def brute_lines(rows, least_docs=3, least_chars=20):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(NO_ID if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == (NO_ID if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup_by_brute_force(spark, batches):
    common = "Licensed to everybody in the world"
    extra = [(20 + i, f"{common}{' ' * (i % 3)}\nonly here {i} and nowhere else\n{common.upper() if i % 2 else common}\nshort") for i in range(9)]
    extra += [(40, "twice in two documents, not three"), (41, "twice in two documents, not three"), (42, "É" * 20), (43, "É" * 20), (44, "é" * 20), (45, "É" * 20)]
    docs = awkward(spark, extra)
    found = line_dedup.line_dedup(docs, batches=batches).collect()
    assert Counter(map(tuple, found)) == brute_lines([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_runs_are_kept_under_their_name(spark):
    name = uuid.uuid4().hex
    lines = [(i, 100 + i % k, k) for k in (2, 3, 7) for i in range(40)]
    rows = spark.createDataFrame(lines, "id long, h1 long, h2 long").cache()
    for b in range(5):
        runs = line_dedup.LineRuns(spark, name)
        assert runs.version == b
        runs.append(rows.where(f"id % 5 = {b}"))
        runs.close()
    again = line_dedup.LineRuns(spark, name)
    assert [len(level) for level in again.levels] == [1, 0, 1]
    found = {(r.h1, r.h2): (r.n, r.last) for r in again.repeated(6).collect()}
    holders = defaultdict(set)
    for i, a, b in lines:
        holders[a, b].add(i)
    assert found == {k: (len(v), max(v)) for k, v in holders.items() if len(v) >= 6}
    again.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_a_text_in_half_of_the_rows_is_dealt_out_evenly(spark):
    """No task that builds the filter gets the copies of one text."""
    from pyspark.sql import functions as F

    from gaugeworks.llm import exact_dedup

    keys = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("digest"))
    blocks = exact_dedup._blocks(40_000)
    bits = exact_dedup.filter_bits(keys, "digest", blocks, 2)
    plan = bits._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "partial_count" in first  # counted before the first exchange
    assert bits.count() > 0
    held = exact_dedup.possibly_held(keys, "digest", bits, blocks)
    assert held.where("digest = 'same' and not _maybe").count() == 0
