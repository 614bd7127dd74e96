"""Runs of masks are never sent to the driver, however small Spark takes the rings they come from."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeworks.operators import masks, sequential
from gaugeworks.session import written


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_no_runs_of_rings_are_broadcast(spark, small):
    frame = entry.queries()["ring_iou"](spark, small)
    assert "BroadcastExchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in final_plan(frame)


@pytest.mark.parametrize("within", [[], ["image"]])
def test_overlaps_of_stored_runs_need_no_broadcast(spark, tmp_path, within):
    """A line of 40 pixels in each of 50 images, and one of 30 that begins 20 pixels further on."""
    n = spark.range(100)
    lines = n.select(F.floor(F.col("id") / 2).alias("image"), "id", F.lit(7).cast("long").alias("y"), (F.col("id") % 2 * 20).alias("x0"))
    runs = lines.withColumn("x1", F.when(F.col("id") % 2 == 0, 39).otherwise(49).cast("long"))
    runs = runs.withColumn("y", F.col("y") + F.col("image"))
    runs.write.parquet(f"{tmp_path}/runs")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    found = masks.run_overlaps(runs, runs, within).where("a < b")
    assert "BroadcastExchange" not in final_plan(found)
    assert {(r.a, r.b): (r.common, r.iou) for r in found.collect()} == {(2 * i, 2 * i + 1): (20, pytest.approx(0.4)) for i in range(50)}


def test_greedy_rounds_over_shapes_send_nothing(spark, small, monkeypatch):
    """Neither the shapes' own tables nor the pairs and rows of a round, all of which grow with the input."""
    seen = []
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sequential, "written", lambda frame, name: seen.append(plan(frame)) or written(frame, name))
    kept = entry.queries()["suppress_shapes"](spark, small)
    seen.append(plan(kept))
    assert len(seen) > 5 and not any("BroadcastExchange" in p for p in seen)
    seen.clear()
    rows = spark.range(25).withColumn("name", F.col("id"))
    kept = sequential.greedy_kept(rows, spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
    assert not any("BroadcastExchange" in p for p in [*seen, final_plan(kept)])
    assert sorted(r.name for r in kept.collect()) == [*range(0, 20, 2), 20, 21, 22, 23, 24]
