"""Halves that binary numbers hide, and presets that repeat."""

from pyspark.sql import functions as F

from gaugeworks.functions import values as V
from gaugeworks.operators import lookup


def test_rounded_as_sql_does(spark):
    frame = spark.createDataFrame([(47.3705 + 27,), (-47.3705 - 27,), (1.0,), (None,)], "v double")
    assert [r[0] for r in frame.select(V.rounded("v", 3)).collect()] == [74.371, -74.371, 1.0, None]


def test_a_calibration_meets_few_presets_however_often_they_repeat(spark):
    presets = spark.range(5000).select(F.col("id").alias("preset_pos"), F.concat(F.lit("n"), F.col("id") % 9).alias("name"), F.lit("um").alias("unit"), F.lit(2.0).alias("ppu"))
    cal = spark.createDataFrame([(i, f"n{i}", "um", 2.0 + 1e-12) for i in range(12)] + [(12, "n1", "px", 2.0)], "id long, name string, unit string, ppu double")
    found = lookup.match_preset(cal, presets, "id")
    assert {r.id: (r.preset_pos, r.preset_name) for r in found.collect()} == {i: (i, f"n{i}") if i < 9 else (0, "n0") for i in range(12)} | {12: (None, None)}
    # presets are reduced before they are joined
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")
