"""Measuring lines moved onto the two edges of what they cross, in images whose pixels are rows (id, x, y, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import few, many

#: Distance of samples along a line, and how many lines of samples lie on either side of it.
STEP, BAND = 0.5, 2
#: Binomial taps that smooth a profile, in sixteenths.
TAPS = (1, 4, 6, 4, 1)
#: What can come of it.
TOO_SHORT, FLAT, NO_PAIR, REVIEW, SNAPPED = "line_too_short", "profile_too_flat", "edge_pair_not_found", "manual_review", "snapped"


def grey(red: Column, green: Column, blue: Column) -> Column:
    return red * 0.299 + green * 0.587 + blue * 0.114


def profiles(pixels: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, length, profile) of lines (line, id, ax, ay, bx, by, width, height) of three pixels or more: grey values along
    each, sampled between pixels and averaged over its band. Samples beyond the image take its border's value; pixels that
    have no row are 255.

    Each sample meets the four pixels around it in one join, to which no image brings more than its lines' box; a line's samples
    come back as one array.
    """
    length = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    n = F.greatest(F.lit(7), F.ceil(F.col("length") / STEP).cast("int") + 1)
    long = lines.withColumn("length", length).where("length >= 3").withColumn("n", n)
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("length"), (F.col("by") - F.col("ay")) / F.col("length")
    at = F.col("i") * F.col("length") / (F.col("n") - 1)
    bands = F.explode(F.sequence(F.lit(-BAND), F.lit(BAND))).alias("off")
    each = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("*", bands)
    inside = lambda v, size: F.greatest(F.lit(0.0), F.least(v, F.col(size) - 1.0))
    each = each.select(
        "line", "id", "length", "n", "i", "width", "height", inside(F.col("ax") + at * ux - F.col("off") * uy, "width").alias("sx"),
        inside(F.col("ay") + at * uy + F.col("off") * ux, "height").alias("sy"),
    )
    x0, y0 = F.floor("sx"), F.floor("sy")
    wx, wy = F.col("sx") - x0, F.col("sy") - y0
    x1, y1 = F.least(x0 + 1, F.col("width") - 1), F.least(y0 + 1, F.col("height") - 1)
    corners = [(x0, y0, (1 - wx) * (1 - wy)), (x1, y0, wx * (1 - wy)), (x0, y1, (1 - wx) * wy), (x1, y1, wx * wy)]
    around = F.explode(F.array(*(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.alias("w")) for x, y, w in corners))).alias("c")
    wanted = each.select("line", "id", "length", "i", around).select("line", "id", "length", "i", "c.x", "c.y", "c.w").where("w > 0")
    # of each image only the pixels of its lines' box are dealt out
    ends = lambda c: F.array(F.col(f"a{c}"), F.col(f"b{c}"))
    low = lambda c, size: F.min(F.least(F.col(size) - 1.0, F.array_min(ends(c)) - BAND - 1))
    high = lambda c: F.max(F.greatest(F.lit(0.0), F.array_max(ends(c)) + BAND + 1))
    box = long.groupBy("id").agg(low("x", "width").alias("_x0"), high("x").alias("_x1"), low("y", "height").alias("_y0"), high("y").alias("_y1"))
    near = pixels.select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value").join(few(box), "id")
    near = near.where("x between _x0 and _x1 and y between _y0 and _y1").select("id", "x", "y", "value")
    met = wanted.join(many(near), ["id", "x", "y"], "left")
    samples = met.groupBy("line", "length", "i").agg((F.sum(F.col("w") * F.coalesce(F.col("value").cast("double"), F.lit(255.0))) / (2 * BAND + 1)).alias("v"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return samples.groupBy("line", "length").agg(whole.alias("profile"))


def smooth(profile: Column) -> Column:
    """Five binomial taps; the ends repeat."""
    n = F.size(profile)
    tap = lambda i, k: F.get(profile, F.greatest(F.lit(0), F.least(i + k, n - 1))) * TAPS[k + 2]
    return F.transform(profile, lambda v, i: (tap(i, -2) + tap(i, -1) + tap(i, 0) + tap(i, 1) + tap(i, 2)) / 16)


def slope(values: Column, step: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(values)
    before, after = (lambda i: F.greatest(i - 1, F.lit(0))), (lambda i: F.least(i + 1, n - 1))
    return F.transform(values, lambda v, i: (F.get(values, after(i)) - F.get(values, before(i))) / ((after(i) - before(i)) * step))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def middle_and_ends(profile: Column) -> Column:
    """Mean of the middle 30 % of a profile less that of the 15 % at either end."""
    n = F.size(profile)
    ends, centre = F.greatest(F.lit(1), F.floor(n * 0.15).cast("int")), F.greatest(F.lit(1), F.floor(n * 0.3).cast("int"))
    outside = F.concat(F.slice(profile, 1, ends), F.slice(profile, n - ends + 1, ends))
    return _mean(F.slice(profile, F.floor((n - centre) / 2).cast("int") + 1, centre)) - _mean(outside)


def edge_pair(g: Column, threshold: Column, sign: Column) -> Column:
    """struct (left, right, fallback): where a slope ``g`` has the two edges of a strip; null if it has none.

    The left one is sought in the first half of the slope, with the sign given, the right one in the second half with the
    other, both away from the ends: the outermost peaks that reach ``threshold``; else the steepest places that do; else the
    steepest of any sign, if they differ in it.
    """
    n = F.size(g)
    centre = F.floor(n / 2).cast("int")
    guard = F.greatest(F.lit(2), F.least(centre - 1, F.bround(n * 0.05).cast("int")))
    halves = ((guard, centre, sign), (centre + 1, F.greatest(centre + 1, n - guard), -sign))

    def places(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))

    def at(j: Column) -> Column:
        return F.get(g, j)

    def steep(j: Column) -> Column:
        return F.struct(F.abs(at(j)).alias("v"), (-j).alias("back"), j.alias("j"))

    def sought(first: Column, end: Column, s: Column) -> tuple[Column, Column, Column]:
        """All peaks, the steepest place of the right sign, and the steepest of any."""
        peaks = F.filter(places(first + 1, end - 1), lambda j: (s * at(j) >= threshold) & (s * at(j) >= s * at(j - 1)) & (s * at(j) >= s * at(j + 1)))
        signed = F.array_max(F.transform(F.filter(places(first, end), lambda j: s * at(j) >= threshold), steep))["j"]
        most = F.array_max(F.transform(places(first, end), steep))
        return peaks, signed, F.when(most["v"] >= threshold, most["j"])

    peaks, strongest, any_sign = zip(*(sought(*half) for half in halves))
    pair = lambda a, b, fallback: F.struct(a.alias("left"), b.alias("right"), F.lit(fallback).alias("fallback"))
    outermost = [F.get(peaks[0], F.lit(0)), F.get(peaks[1], F.size(peaks[1]) - 1)]
    differ = at(any_sign[0]) * at(any_sign[1]) < 0
    return (
        F.when((F.size(peaks[0]) > 0) & (F.size(peaks[1]) > 0), pair(*outermost, False))
        .when(strongest[0].isNotNull() & strongest[1].isNotNull(), pair(*strongest, True))
        .when(any_sign[0].isNotNull() & any_sign[1].isNotNull() & differ, pair(*any_sign, True))
    )


def peak_place(g: Column, j: Column, step: Column) -> Column:
    """Where a peak of ``g`` lies between samples, by a parabola through it and its neighbours."""
    a, b, c = F.get(g, j - 1), F.get(g, j), F.get(g, j + 1)
    bend = a - 2 * b + c
    shift = F.when(F.abs(bend) < 1e-9, 0.0).otherwise(G.clamp((a - c) / 2 / F.nullif(bend, F.lit(0.0)), -1.0, 1.0))
    return (j + F.when((j <= 0) | (j >= F.size(g) - 1), 0.0).otherwise(shift)) * step


def snapped_lines(pixels: DataFrame, lines: DataFrame, review: float = 0.45) -> DataFrame:
    """(line, status, ax, ay, bx, by, diameter, confidence, polarity, fallback) of lines (line, id, ax, ay, bx, by, width, height).

    ``status`` says why a line stays, or whether its new place should be looked at: one whose confidence, of the steepness of
    both edges, their contrast and how well they lie about the line's middle, is below ``review``.
    """
    found = profiles(pixels, lines)
    step = F.col("length") / (F.size("profile") - 1)
    found = found.select("line", "length", step.alias("step"), smooth(F.col("profile")).alias("soft"))
    found = found.withColumn("g", slope(F.col("soft"), F.col("step"))).withColumn("inner", middle_and_ends(F.col("soft")))
    found = found.withColumn("steep", F.array_max(F.transform("g", lambda v: F.abs(v))))
    sign = F.when(F.col("inner") < 0, -1).otherwise(1)
    found = found.withColumn("pair", edge_pair(F.col("g"), F.greatest(F.lit(3.0), F.col("steep") * 0.25), sign))
    ends = {side: peak_place(F.col("g"), F.col(f"pair.{side}"), F.col("step")) for side in ("left", "right")}
    found = found.withColumns({"from": ends["left"], "to": ends["right"]})
    strength = (F.abs(F.get("g", F.col("pair.left"))) + F.abs(F.get("g", F.col("pair.right")))) / 2
    half = F.col("length") / 2
    symmetry = F.greatest(F.lit(0.0), 1 - F.abs((F.col("from") + F.col("to")) / 2 - half) / F.greatest(half, F.lit(1.0)))
    contrast = F.abs("inner")
    sure = F.least(F.lit(1.0), strength / 20) * 0.45 + symmetry * 0.25 + F.least(F.lit(1.0), contrast / 24) * 0.3
    joined = lines.join(many(found.withColumns({"sure": G.clamp(sure, 0.01, 0.99), "contrast": contrast})), "line", "left")
    status = (
        F.when(F.col("length").isNull(), TOO_SHORT)
        .when((F.col("steep") < 3) & (F.col("contrast") < 4), FLAT)
        .when(F.col("pair").isNull() | (F.col("from") >= F.col("to")), NO_PAIR)
        .when(F.col("sure") < review, REVIEW)
        .otherwise(SNAPPED)
    )
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("length"), (F.col("by") - F.col("ay")) / F.col("length")
    placed = {
        f"_{end}{axis}": G.clamp(F.col(f"a{axis}") + F.col(where) * u, F.lit(0.0), F.col(size) - 1.0)
        for end, where in (("a", "from"), ("b", "to"))
        for axis, u, size in (("x", ux, "width"), ("y", uy, "height"))
    }
    moved = joined.withColumn("status", status).withColumns(placed)
    done = F.col("status").isin(REVIEW, SNAPPED)
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    return moved.select(
        "line", "status", *(F.when(done, F.col(f"_{c}")).alias(c) for c in ("ax", "ay", "bx", "by")), F.when(done, F.sqrt(dx * dx + dy * dy)).alias("diameter"),
        F.when(done, F.col("sure")).otherwise(0.0).alias("confidence"),
        F.when(F.col("inner") < 0, "dark_on_light").when(F.col("inner").isNotNull(), "light_on_dark").alias("polarity"),
        F.when(done, F.col("pair.fallback")).alias("fallback"),
    )
