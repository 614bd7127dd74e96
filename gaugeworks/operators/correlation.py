"""How well two images agree when one is shifted over the other; pixels are rows (keys, x, y, value), places whole from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, many

IMAGE = ("id",)


def summed_area(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, x, y, s, s2): sums of values and of their squares over all pixels up to (x, y), by a prefix sum along lines and one
    along columns. Each image has a pixel at every place of its rectangle."""
    v = F.col("value").cast("double")
    up_to = lambda part, order: Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    along = pixels.select(*keys, "x", "y", F.sum(v).over(up_to("y", "x")).alias("s"), F.sum(v * v).over(up_to("y", "x")).alias("s2"))
    return along.select(*keys, "x", "y", F.sum("s").over(up_to("x", "y")).alias("s"), F.sum("s2").over(up_to("x", "y")).alias("s2"))


def rectangle_sums(table: DataFrame, rectangles: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, rectangle, s, s2) of rectangles (keys, rectangle, x0, y0, x1, y1), ends included: four look-ups each in
    :func:`summed_area`'s table."""
    def corner(x: str, y: str) -> Column:
        """The table's place for an end of a rectangle; what lies before its first line and column is taken off."""
        first = (x == "x0", y == "y0")
        at = [(F.col(c) - int(f)).cast("long") for c, f in zip((x, y), first)]
        return F.struct(at[0].alias("x"), at[1].alias("y"), F.lit(1.0 if first[0] == first[1] else -1.0).alias("sign"))

    corners = F.array(*(corner(x, y) for x in ("x0", "x1") for y in ("y0", "y1")))
    wanted = rectangles.select(*keys, "rectangle", F.explode(corners).alias("c")).select(*keys, "rectangle", "c.x", "c.y", "c.sign")
    known = table.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "s", "s2")
    met = wanted.join(many(known), [*keys, "x", "y"], "left")  # before the first line or column there is nothing to take off
    return met.groupBy(*keys, "rectangle").agg(*(F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0.0)).alias(c) for c in ("s", "s2")))


def overlap_ratio(width_a: Column, height_a: Column, width_b: Column, height_b: Column, dx: Column, dy: Column) -> Column:
    """The shared part of two frames, the second one shifted, of the smaller frame."""
    w = F.greatest(F.lit(0.0), F.least(width_a, dx + width_b) - F.greatest(F.lit(0.0), dx))
    h = F.greatest(F.lit(0.0), F.least(height_a, dy + height_b) - F.greatest(F.lit(0.0), dy))
    return w * h / F.greatest(F.lit(1.0), F.least(width_a * height_a, width_b * height_b))


def shifted_agreement(a: DataFrame, b: DataFrame, sizes: DataFrame, shifts: DataFrame, keys: Sequence[str] = IMAGE, least: int = 1) -> DataFrame:
    """(keys, dx, dy, ratio, ncc, texture) for each of ``shifts`` (keys, dx, dy) of the images ``b`` over ``a``.

    ``sizes`` has (keys, width_a, height_a, width_b, height_b). ``ncc`` is the correlation of what overlaps, -1 where one side has
    no contrast, ``texture`` the deviation of ``a`` there; both are null where less than ``least`` lines or columns overlap.
    Shifts are rounded half to even. Sums of one image come from its summed-area table; only products meet pixel by pixel.
    """
    keys = list(keys)
    sized = shifts.join(few(sizes), keys).withColumns({"ix": F.bround("dx").cast("long"), "iy": F.bround("dy").cast("long")})
    ratio = overlap_ratio(F.col("width_a"), F.col("height_a"), F.col("width_b"), F.col("height_b"), F.col("dx"), F.col("dy"))
    ax, ay = F.greatest(F.lit(0), F.col("ix")), F.greatest(F.lit(0), F.col("iy"))
    bx, by = F.greatest(F.lit(0), -F.col("ix")), F.greatest(F.lit(0), -F.col("iy"))
    w, h = F.least(F.col("width_a") - ax, F.col("width_b") - bx), F.least(F.col("height_a") - ay, F.col("height_b") - by)
    cut = sized.select(*keys, "dx", "dy", "ix", "iy", ratio.alias("ratio"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), w.alias("w"), h.alias("h"))
    some = cut.where((F.col("w") >= max(1, least)) & (F.col("h") >= max(1, least)))
    name = F.struct("dx", "dy")

    def sums(pixels: DataFrame, side: str) -> DataFrame:
        x, y = F.col(f"{side}x"), F.col(f"{side}y")
        boxes = some.select(*keys, name.alias("rectangle"), x.alias("x0"), y.alias("y0"), (x + F.col("w") - 1).alias("x1"), (y + F.col("h") - 1).alias("y1"))
        found = rectangle_sums(summed_area(pixels, keys), boxes, keys)
        return found.select(*keys, "rectangle.dx", "rectangle.dy", F.col("s").alias(f"s_{side}"), F.col("s2").alias(f"q_{side}"))

    pixel = lambda df, v: df.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("value").cast("double").alias(v))
    laid = pixel(b, "v").join(many(some.select(*keys, "dx", "dy", "ix", "iy")), keys).select(*keys, "dx", "dy", (F.col("x") + F.col("ix")).alias("x"), (F.col("y") + F.col("iy")).alias("y"), "v")
    products = laid.join(many(pixel(a, "u")), [*keys, "x", "y"]).groupBy(*keys, "dx", "dy").agg(F.sum(F.col("u") * F.col("v")).alias("p"))
    at = [*keys, "dx", "dy"]
    met = cut.join(sums(a, "a"), at, "left").join(sums(b, "b"), at, "left").join(products, at, "left")
    n = F.col("w") * F.col("h")
    spread = {s: F.greatest(F.lit(0.0), F.col(f"q_{s}") - F.col(f"s_{s}") * F.col(f"s_{s}") / n) for s in "ab"}
    size = F.sqrt(spread["a"] * spread["b"])
    ncc = F.when(size <= 1e-6, -1.0).otherwise((F.col("p") - F.col("s_a") * F.col("s_b") / n) / F.nullif(size, F.lit(0.0)))
    return met.select(*at, "ratio", F.when(F.col("s_a").isNotNull(), ncc).alias("ncc"), F.when(F.col("s_a").isNotNull(), F.sqrt(spread["a"] / n)).alias("texture"))
