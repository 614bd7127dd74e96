"""Sharpness of images and fusion of frames, by stencils over lines of pixels.

An image is rows (keys, y, v): one array of grey values for each line. Along lines a stencil works within the array; across
lines it looks at the rows before and after. Lines are dealt out in bands, each with the lines beyond its ends that a
stencil reaches, so no task holds an image. Beyond its border an image is mirrored, the border itself not repeated; images
have more lines and columns than a stencil reaches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that one task works on at a time.
BAND = 64
IMAGE = ("id",)
#: Stencils of three places: mean (unscaled), difference, second difference.
MEAN, SLOPE, BEND = (1, 2, 1), (-1, 0, 1), (1, -2, 1)
#: What the gradient counts beside the second derivatives.
GRADIENT_SHARE = 0.35
#: Of each profile of fusion: the widths of its blurs, the power of sharpness, the share of the sharpest frame alone.
PROFILES = {"sharp": ((0.8, 1.6, 3.0), 1.65, 0.72), "balanced": ((1.0, 2.5, 5.0), 1.2, 0.42), "soft": ((1.8, 4.0, 7.0), 0.9, 0.15)}


def gaussian(sigma: float, reach: float = 4.0) -> tuple[float, ...]:
    """Taps of a blur whose width is twice ``reach`` sigmas, rounded to an odd number, and which add up to 1."""
    half = (round(sigma * reach * 2 + 1) | 1) // 2
    taps = [math.exp(-((i / sigma) ** 2) / 2) for i in range(-half, half + 1)]
    return tuple(t / sum(taps) for t in taps)


def image_lines(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, y, v) of images whose pixels (keys, x, y, value) are rows, one for every place from 0 on."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("v"))))
    return pixels.groupBy(*keys, F.col("y").cast("int").alias("y")).agg(F.transform(ordered, lambda p: p["v"]).alias("v"))


def image_pixels(lines: DataFrame, keys: Sequence[str] = IMAGE, values: str = "v") -> DataFrame:
    return lines.select(*keys, "y", F.posexplode(values).alias("x", "value"))


def _along(values: Column, taps: Sequence[float]) -> Column:
    """A stencil along an array."""
    n, half = F.size(values), len(taps) // 2

    def mirrored(i: Column) -> Column:
        i = F.abs(i)
        return F.least(F.greatest(F.when(i >= n, 2 * (n - 1) - i).otherwise(i), F.lit(0)), n - 1)

    def one(_: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, tap in enumerate(taps):
            if tap:
                total = total + F.get(values, mirrored(i + (k - half))) * float(tap)
        return total

    return F.transform(values, one)


def stencils(lines: DataFrame, wanted: dict[str, Sequence[tuple[str, Sequence[float], Sequence[float]]]], keys: Sequence[str] = IMAGE, band: int = BAND) -> DataFrame:
    """``lines`` with an array for each name of ``wanted``: the sum of separable stencils (column, along, across) of it."""
    keys = list(keys)
    along = list(dict.fromkeys((column, tuple(a)) for terms in wanted.values() for column, a, _ in terms))
    name = {key: f"_s{i}" for i, key in enumerate(along)}
    reach = max(len(across) // 2 for terms in wanted.values() for *_, across in terms)
    height = lines.groupBy(*keys).agg((F.max("y") + 1).alias("_height"))
    sums = lines.join(height, keys).withColumns({name[c, a]: _along(F.col(c), a) for c, a in along})
    # where each line is needed: at its own place, mirrored beyond the borders, and in the bands beside its own
    y, last = F.col("y"), F.col("_height") - 1
    places = F.array_distinct(F.filter(F.array(y, -y, 2 * last - y), lambda p: (p >= -reach) & (p <= last + reach)))
    placed = sums.withColumn("_at", F.explode(places))
    at = F.col("_at")
    bands = F.sequence(F.floor((at - reach) / band), F.floor((at + reach) / band))
    placed = placed.withColumn("_band", F.explode(bands))
    w = Window.partitionBy(*keys, "_band").orderBy("_at")
    out = placed
    for target, terms in wanted.items():
        total = None
        parts = []
        for column, a, across in terms:
            half = len(across) // 2
            for k, tap in enumerate(across):
                if tap:
                    source = F.col(name[column, tuple(a)])
                    shift = k - half
                    parts.append((F.lead(source, shift).over(w) if shift > 0 else F.lag(source, -shift).over(w) if shift < 0 else source, float(tap)))
        columns = {f"_{target}{i}": c for i, (c, _) in enumerate(parts)}
        out = out.withColumns(columns)
        for i, (_, tap) in enumerate(parts):
            line = F.col(f"_{target}{i}")
            total = _scaled(line, tap) if total is None else F.zip_with(total, line, _adder(tap))
        out = out.withColumn(target, total).drop(*columns)
    own = (at == y) & (F.floor(at / band) == F.col("_band"))
    return out.where(own).select(*lines.columns, *wanted)


def _scaled(values: Column, tap: float) -> Column:
    return F.transform(values, lambda v: v * tap)


def _adder(tap: float):
    return lambda total, v: total + v * tap


def sharpness(lines: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """``lines`` with ``focus``: second derivatives and a share of the gradient, both by stencils of 3 x 3, then blurred."""
    keys = list(keys)
    derived = stencils(lines, {"_gx": [("v", SLOPE, MEAN)], "_gy": [("v", MEAN, SLOPE)], "_lap": [("v", BEND, MEAN), ("v", MEAN, BEND)]}, keys)
    gradient = F.zip_with("_gx", "_gy", lambda a, b: F.sqrt(a * a + b * b))
    score = F.zip_with("_lap", gradient, lambda a, g: F.abs(a) + g * GRADIENT_SHARE)
    blur = gaussian(1.0)
    found = stencils(derived.withColumn("_score", score), {"focus": [("_score", blur, blur)]}, keys)
    return found.drop("_gx", "_gy", "_lap", "_score")


def fused(frames: DataFrame, keys: Sequence[str] = IMAGE, order: str = "frame", profile: str = "balanced") -> DataFrame:
    """(keys, y, v) of one image of each stack of frames (keys, ``order``, y, v, focus).

    The sharpest frame of each pixel, the first of equal ones, is mixed with the mean of all frames weighted by their blurred
    sharpness; values are whole numbers from 0 to 255, rounded down.
    """
    keys = list(keys)
    sigmas, power, share = PROFILES[profile]
    blurs = {f"_b{i}": [("focus", gaussian(s), gaussian(s))] for i, s in enumerate(sigmas)}
    blurred = stencils(frames, blurs, [*keys, order])
    stack = F.sort_array(F.collect_list(F.struct(order, "v", "focus", *blurs)))
    stacked = blurred.groupBy(*keys, "y").agg(stack.alias("f"))
    f, n = F.col("f"), F.size(F.get("f", F.lit(0))["v"])
    clipped = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)))

    def pixel(i: Column) -> Column:
        def weight(name: str, frame: Column) -> Column:
            return F.pow(F.greatest(F.get(frame[name], i), F.lit(1e-6)), F.lit(power)) + 1e-6

        def summed(value) -> Column:
            return F.aggregate(f, F.lit(0.0), lambda total, frame: total + value(frame))

        totals = F.array(*(summed(_weigher(weight, name)) for name in blurs))

        def with_totals(t: Column) -> Column:
            def share_of(frame: Column) -> Column:
                shares = F.lit(0.0)
                for k, name in enumerate(blurs):
                    shares = shares + weight(name, frame) / F.get(t, F.lit(k))
                return shares / len(blurs)

            soft = summed(lambda frame: F.get(frame["v"], i) * share_of(frame)) / summed(share_of)
            best = F.array_max(F.transform(f, lambda frame, k: F.struct(F.get(frame["focus"], i).alias("s"), (-k).alias("k"), F.get(frame["v"], i).alias("v"))))["v"]
            return clipped(clipped(soft) * (1 - share) + best * share)

        return F.get(F.transform(F.array(totals), with_totals), F.lit(0))

    return stacked.select(*keys, "y", F.transform(F.sequence(F.lit(0), n - 1), pixel).alias("v"))


def _weigher(weight, name: str):
    return lambda frame: weight(name, frame)


def sharpened(lines: DataFrame, strength: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, y, v) with what a blur takes from each pixel added by ``strength`` percent, 120 at most; 0 leaves an image as it is."""
    amount = max(0.0, min(1.2, strength / 100))
    whole = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("double")
    if amount <= 0:
        return lines.select(*keys, "y", F.transform("v", whole).alias("v"))
    blur = gaussian(1.1, 3.0)
    found = stencils(lines.select(*keys, "y", "v"), {"_soft": [("v", blur, blur)]}, keys)
    return found.select(*keys, "y", F.zip_with("v", "_soft", lambda v, s: whole(v * (1 + amount) - F.round(s) * amount)).alias("v"))
