import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import mixing

from fixtures import awkward, source_targets


def test_targets(spark):
    assert source_targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200, "b": 500 / 3, None: 250 / 3})
    rng = random.Random(2)
    tables = [{"a": 100, "b": 100, None: 100}, {"a": 0, "b": 10}, {"only": 7}, {None: 0}, {}]
    tables.append({f"s{i}": rng.choice((0, 3, 50, 1000, 10**9)) for i in range(40)} | {None: 5, "é": 9, "Z": 9})
    for sizes in tables:
        rows = [("null" if s is None else f"={s}", s, n, 1) for s, n in sizes.items()]
        plan, n = mixing.source_plan(spark.createDataFrame(rows, "skey string, source string, size long, n long"))
        expected = source_targets(sizes)
        found = {r.skey: r for r in plan.collect()}
        assert n == len(found) == len(sizes)
        for s, size in sizes.items():
            r = found["null" if s is None else f"={s}"]
            assert r.target == pytest.approx(expected[s]) and r.source_size == size
            assert 0 <= r.budget <= max(size, 1) and r.whole * size + r.budget == pytest.approx(expected[s], abs=0.51)


@pytest.mark.parametrize("seed", range(30))
def test_budget_fits_as_well_as_brute_force(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 40), rng.randint(1, 6))
    counts = [rng.randint(1, 4) for _ in lengths]
    budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts)) + 5)
    take = mixing.fit_budget(lengths, counts, budget)
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert all(0 <= t <= c for t, c in zip(take, counts))
    assert sum(n * t for n, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


def test_large_budgets_are_met():
    rng = random.Random(1)
    lengths = sorted(rng.sample(range(1, 5000), 800))
    counts = [rng.randint(1, 3000) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    for share in (0.001, 0.3, 0.77, 0.999):
        take = mixing.fit_budget(lengths, counts, int(total * share))
        assert sum(n * t for n, t in zip(lengths, take)) == int(total * share) and all(0 <= t <= c for t, c in zip(take, counts))


def test_mix(spark):
    docs = awkward(spark)
    found = mixing.mix(docs, keep_source=True).collect()
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted(
        (r.doc_id or -1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()
    )
    sizes = {s: sum(r.size for r in found if r.source == s) for s in {r.source for r in found}}
    targets = source_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and r.taken in (0, r.size, 2 * r.size)
    for s, size in sizes.items():
        taken = sum(r.taken for r in found if r.source == s)
        assert taken <= targets[s] + 1 and taken >= targets[s] - max(r.size for r in found if r.source == s)
    again = mixing.mix(docs, keep_source=True).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r.times for r in found)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_choosing_within_a_hot_group(spark):
    rows = spark.range(2000).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("k").alias("skey"), F.lit(3).cast("long").alias("size"), F.xxhash64("id").alias("r"))
    quota = spark.createDataFrame([("k", 3, 777)], "skey string, size long, extra long")
    one, two = (mixing.choose(rows, quota, edge_rows=n).where("pick = 1") for n in (10_000, 4))
    assert one.count() == 777 and {r.row for r in one.collect()} == {r.row for r in two.collect()}


def test_many_sources_are_not_broadcast(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "concat('h', id % 90) as source")
    few = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == few


def test_no_row_of_a_hot_id_is_lost(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.col("id").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("k").alias("skey"),
        F.lit(3).cast("long").alias("size"), F.xxhash64(F.lit(1), F.lit(None).cast("long")).alias("r"),
    )
    quota = spark.createDataFrame([("k", 3, 777)], "skey string, size long, extra long")
    found = mixing.choose(rows, quota, edge_rows=50).collect()
    assert sorted(r.row for r in found) == list(range(3000)) and sum(r.pick for r in found) == 777
    monkeypatch.setattr(mixing.choose, "__defaults__", (50,))
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"), "id")
    out = mixing.mix(docs).collect()
    assert len(out) == 900
    kept = mixing.mixed(docs).collect()
    assert len(kept) == sum(r.times for r in out) and {r.id for r in kept} <= set(range(900))
