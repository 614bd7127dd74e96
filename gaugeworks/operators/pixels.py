"""Measures of images whose pixels are rows (id, x, y, value)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, many


def frame_measures(pixels: DataFrame) -> DataFrame:
    """(id, mean, deviation) of each image's pixels."""
    return pixels.groupBy("id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def edge_pair(pixels: DataFrame, lines: DataFrame, band: int = 2) -> DataFrame:
    """(id, status, left, right): the two edges of a dark strip that a horizontal line (id, x0, x1, y) crosses.

    Rows within ``band`` are averaged, smoothed by five binomial taps and differentiated; the left edge is where the
    grey value falls fastest, the right one where it rises fastest, each placed between pixels by a parabola.
    """
    near = pixels.join(few(lines), "id").where(f"abs(y - floor(line_y)) <= {band} and x between line_x0 and line_x1")
    w = Window.partitionBy("id").orderBy("x")

    def beside(column: str, k: int):
        """The value ``k`` places on; the ends repeat."""
        value = F.lag(column, -k).over(w) if k < 0 else F.lead(column, k).over(w)
        last = Window.partitionBy("id").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(F.lag(column, -k).over(w) if k < 0 else value, (F.first if k < 0 else F.last)(column).over(last))

    profile = near.groupBy("id", "x").agg(F.avg("value").alias("grey"))
    smooth = reduce(lambda a, b: a + b, (beside("grey", k) * c for k, c in zip(range(-2, 3), (1, 4, 6, 4, 1)))) / 16
    slope = profile.withColumn("soft", smooth).withColumn("slope", (beside("soft", 1) - beside("soft", -1)) / 2)
    before, after = beside("slope", -1), beside("slope", 1)
    bend = before - 2 * F.col("slope") + after
    shift = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (before - after) / 2 / F.nullif(bend, F.lit(0.0)))), F.lit(0.0))
    placed = slope.withColumn("place", F.col("x") + shift)
    found = placed.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("slope")).alias("steep"), (F.max("grey") - F.min("grey")).alias("contrast"),
        F.min_by("place", F.struct("slope", "x")).alias("left"), F.max_by("place", F.struct(F.col("slope"), -F.col("x"))).alias("right"),
    )
    flat = (F.col("steep") < 3) & (F.col("contrast") < 4)
    status = F.when(F.col("n") < 4, "line_too_short").when(flat, "profile_too_flat").when(F.col("right") <= F.col("left"), "edge_pair_not_found").otherwise("snapped")
    return lines.select("id").join(many(found), "id", "left").select("id", F.coalesce(status, F.lit("line_too_short")).alias("status"), "left", "right")


def mask_measures(pixels: DataFrame) -> DataFrame:
    """(id, area, parts, min_x, max_x) of the pixels of each image that are not 0; parts touch by a side or a corner.

    Pixels are reduced to runs in each row; only an image's runs meet, to be joined from row to row.
    """
    run = F.col("x") - F.row_number().over(Window.partitionBy("id", "y").orderBy("x"))
    runs = pixels.where("value <> 0").withColumn("run", run).groupBy("id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["y", "x0"])[["y", "x0", "x1"]].values.tolist()
        top, start = list(range(len(rows))), 0

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for i, (y, x0, x1) in enumerate(rows):
            while rows[start][0] < y - 1:
                start += 1
            j = start
            while rows[j][0] == y - 1:
                if rows[j][1] <= x1 + 1 and rows[j][2] >= x0 - 1:
                    top[find(i)] = find(j)
                j += 1
        parts = sum(t == i for i, t in enumerate(top))
        area = int((pdf["x1"] - pdf["x0"] + 1).sum())
        return pd.DataFrame([(pdf["id"].iloc[0], area, parts, pdf["x0"].min(), pdf["x1"].max())], columns=["id", "area", "parts", "min_x", "max_x"])

    return runs.groupBy("id").applyInPandas(count, "id long, area long, parts int, min_x int, max_x int")
