"""Masks as runs: rows (keys, y, x0, x1), each a stretch of set pixels in one line of an image.

Set algebra, measures, holes and components work on runs, never on images: lines meet by (image, line), and what must be joined
over lines is joined in bands of lines first and over the bands' borders after. Runs of a mask neither overlap nor touch
within a line; :func:`merged` makes any runs so.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import many, safe_unions, written
from .graph import connected

#: Lines that one task joins at a time.
BAND = 64
IMAGE = ("id",)


def _line(keys: Sequence[str]):
    return Window.partitionBy(*keys, "y")


def merged(runs: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The same pixels as runs that neither overlap nor touch."""
    before = _line(keys).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    marked = runs.withColumn("_new", F.coalesce((F.col("x0") > F.max("x1").over(before) + 1).cast("int"), F.lit(1)))
    marked = marked.withColumn("_run", F.sum("_new").over(_line(keys).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def runs_of(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The runs of set pixels (keys, x, y); a pixel that repeats counts once."""
    run = F.col("x") - F.dense_rank().over(_line(keys).orderBy("x"))
    found = pixels.withColumn("_run", run).groupBy(*keys, "y", "_run").agg(F.min("x").cast("long").alias("x0"), F.max("x").cast("long").alias("x1"))
    return found.select(*keys, F.col("y").cast("long").alias("y"), "x0", "x1")


def _swept(left: DataFrame, right: DataFrame, keep: Column, keys: Sequence[str]) -> DataFrame:
    """Pixels for which ``keep`` holds of how many runs of either side cover them (a, b): a sweep over the ends of runs."""

    def ends(runs: DataFrame, a: int) -> DataFrame:
        both = F.array(F.struct("y", F.col("x0").alias("x"), F.lit(1).alias("by")), F.struct("y", (F.col("x1") + 1).alias("x"), F.lit(-1).alias("by")))
        return runs.select(*keys, F.explode(both).alias("e")).select(*keys, "e.y", "e.x", (F.col("e.by") * a).alias("a"), (F.col("e.by") * (1 - a)).alias("b"))

    w = _line(keys).orderBy("x")
    so_far = w.rangeBetween(Window.unboundedPreceding, 0)  # all ends at the same place together
    safe_unions(left.sparkSession)
    swept = ends(left, 1).unionByName(ends(right, 0)).select(*keys, "y", "x", F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"), F.lead("x").over(w).alias("next"))
    return merged(swept.where((F.col("next") > F.col("x")) & keep).select(*keys, "y", F.col("x").alias("x0"), (F.col("next") - 1).alias("x1")), keys)


def union(left: DataFrame, right: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    return _swept(left, right, F.expr("a > 0 or b > 0"), keys)


def intersection(left: DataFrame, right: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    return _swept(left, right, F.expr("a > 0 and b > 0"), keys)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    return _swept(left, right, F.expr("a > 0 and b = 0"), keys)


def measures(runs: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, area, min_x, min_y, max_x, max_y, center_x, center_y): pixels, bounds with the far ends outside, mean place."""
    n = F.col("x1") - F.col("x0") + 1
    area = F.sum(n)
    return runs.groupBy(*keys).agg(
        area.alias("area"), F.min("x0").alias("min_x"), F.min("y").alias("min_y"), (F.max("x1") + 1).alias("max_x"), (F.max("y") + 1).alias("max_y"),
        (F.sum(n * (F.col("x0") + F.col("x1"))) / 2 / area).alias("center_x"), (F.sum(n * F.col("y")) / area).alias("center_y"),
    )


def _joined(pdf: pd.DataFrame, group: np.ndarray, reach: int) -> np.ndarray:
    """For each run the number of the first run of its part; runs come by group, line and place. Runs of neighbouring
    lines are of one part if they overlap, or with ``reach`` 1 touch by a corner."""
    y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    x0, x1 = x0 - x0.min() + 1, x1 - x0.min() + 1
    line = (group * (y.max() - y.min() + 2) + y - y.min() + 1) * (x1.max() + 3)
    first = np.searchsorted(line + x1, line - (x1.max() + 3) + x0 - reach)
    last = np.searchsorted(line + x0, line - (x1.max() + 3) + x1 + reach, "right")
    count = np.maximum(last - first, 0)
    down = np.repeat(np.arange(len(y)), count)
    up = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
    top = np.arange(len(y))
    while len(up):  # the larger root of each pair that touches is hung below the smaller one
        a, b = top[up], top[down]
        open_ = a != b
        up, down, a, b = up[open_], down[open_], a[open_], b[open_]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(top, top[top]):
            top = top[top]
    return top


def whole_groups(columns: list[str], use):
    """A step for ``mapInPandas`` over rows sorted by ``columns``: ``use`` gets whole groups, as many as a batch ends."""

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[columns] == pdf[columns].iloc[-1]).all(axis=1).to_numpy()
            start = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # of the group that may go on
            if start:
                yield use(pdf.iloc[:start].reset_index(drop=True))
            held = pdf.iloc[start:].reset_index(drop=True)
        if held is not None and len(held):
            yield use(held)

    return run


def components(runs: DataFrame, keys: Sequence[str] = IMAGE, corners: bool = True, band: int = BAND) -> DataFrame:
    """``runs`` with (part_y, part_x): the place of the first pixel, by line, of the connected part each run is of.

    Lines are joined within bands, each with the first line of the next band; what a run of such a line is called in both
    bands are the edges of a small graph, whose components name the parts. A task holds one band, whatever an image's size.
    """
    keys = list(keys)
    at = F.floor(F.col("y") / band)
    bands = F.when(F.pmod(F.col("y"), F.lit(band)) == 0, F.array(at, at - 1)).otherwise(F.array(at))
    placed = runs.select(*keys, "y", "x0", "x1").withColumn("_band", F.explode(bands))
    placed = placed.repartition(*keys, "_band").sortWithinPartitions(*keys, "_band", "y", "x0")
    schema = StructType([*placed.schema.fields, StructField("part_y", LongType()), StructField("part_x", LongType())])

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        group = (pdf[[*keys, "_band"]] != pdf[[*keys, "_band"]].shift()).any(axis=1).to_numpy().cumsum() - 1
        top = _joined(pdf, group, 1 if corners else 0)
        return pdf.assign(part_y=pdf["y"].to_numpy()[top], part_x=pdf["x0"].to_numpy()[top])

    run = whole_groups([*keys, "_band"], named)
    local = written(placed.mapInPandas(run, schema), "bands")
    name = F.struct(*keys, "part_y", "part_x")
    border = local.where(F.pmod(F.col("y"), F.lit(band)) == 0).groupBy(*keys, "y", "x0").agg(F.min(name).alias("a"), F.max(name).alias("b"))
    roots = connected(border.select("a", "b"))
    own = local.where(F.col("_band") == at).drop("_band").withColumn("_name", name)
    found = own.join(roots, own["_name"] == roots["node"], "left")
    return found.select(*keys, "y", "x0", "x1", *(F.coalesce(F.col(f"root.{c}"), F.col(c)).alias(c) for c in ("part_y", "part_x")))


PART = ("part_y", "part_x")


def part_measures(parts: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    return measures(parts, [*keys, *PART])


def largest_part(runs: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, y, x0, x1, discarded): the runs of each image's largest part, the first by line of equal ones; whether there were others."""
    keys = list(keys)
    parts = written(components(runs, keys), "parts")
    order = F.struct(F.col("area"), -F.col("part_y"), -F.col("part_x"))
    best = part_measures(parts, keys).groupBy(*keys).agg(F.max_by(F.struct(*PART), order).alias("best"), (F.count(F.lit(1)) > 1).alias("discarded"))
    best = best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in PART), "discarded")
    return parts.join(best, [*keys, *PART]).select(*keys, "y", "x0", "x1", "discarded")


def prompted_part(runs: DataFrame, prompts: DataFrame, sizes: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, part_y, part_x, parts, positive_hits, negative_hits): the part of each image that most positive prompts hit,
    then fewest negative ones, then the nearest to the positive prompts' centre, then the largest, then the first by line.

    Prompts (keys, x, y, positive) are rounded half to even and moved into the image; ``sizes`` has (keys, width, height).
    """
    keys = list(keys)
    parts = written(components(runs, keys), "parts")

    def pixel(c: str, size: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.bround(c).cast("long"), F.col(size) - 1))

    points = prompts.join(sizes, keys).select(*keys, pixel("x", "width").alias("_x"), pixel("y", "height").alias("y"), "positive")
    hits = points.join(parts, [*keys, "y"]).where("_x between x0 and x1").groupBy(*keys, *PART)
    hits = hits.agg(F.count_if("positive").alias("positive_hits"), F.count_if(~F.col("positive")).alias("negative_hits"))
    middle = prompts.where("positive").groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    found = part_measures(parts, keys).join(hits, [*keys, *PART], "left").join(middle, keys, "left").fillna(0, ["positive_hits", "negative_hits"])
    dx, dy = F.col("center_x") - F.col("_mx"), F.col("center_y") - F.col("_my")
    away = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    order = F.struct("positive_hits", -F.col("negative_hits"), -away, "area", -F.col("part_y"), -F.col("part_x"))
    out = [*PART, "positive_hits", "negative_hits"]
    best = found.groupBy(*keys).agg(F.max_by(F.struct(*out), order).alias("best"), F.count(F.lit(1)).alias("parts"))
    return best.select(*keys, "parts", *(F.col(f"best.{c}").alias(c) for c in out))


def filled(runs: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The mask with its holes set: background that doesn't reach the border by steps along lines and columns."""
    keys = list(keys)
    runs = written(runs.select(*keys, "y", "x0", "x1"), "runs")
    return union(runs, holes(runs, keys), keys)


def holes(runs: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The runs of a mask's holes, with the part (part_y, part_x) of the background each is of."""
    keys = list(keys)
    box = measures(runs, keys).select(*keys, F.col("min_x").alias("_x0"), F.col("max_x").alias("_x1"), F.col("min_y").alias("_y0"), F.col("max_y").alias("_y1"))
    frame = box.select(*keys, F.explode(F.sequence(F.col("_y0") - 1, F.col("_y1"))).alias("y"), (F.col("_x0") - 1).alias("x0"), F.col("_x1").alias("x1"))
    parts = components(difference(frame, runs.select(*keys, "y", "x0", "x1"), keys), keys, corners=False)
    outside = box.select(*keys, (F.col("_y0") - 1).alias("part_y"), (F.col("_x0") - 1).alias("part_x"))
    return parts.join(outside, [*keys, *PART], "left_anti")


#: What can come of taking an area off a mask.
SUBTRACTED, NO_SHAPE, APART, EMPTY, SPLIT = "subtracted", "no_shape", "no_intersection", "empty", "split"


def subtract_edit(masks: DataFrame, cut: DataFrame, keys: Sequence[str] = IMAGE) -> tuple[DataFrame, DataFrame]:
    """(outcomes, masks): ``cut`` taken off each mask where that leaves one part; other masks stay as they are.

    Outcomes are (keys, outcome, area): ``no_shape`` without anything to cut, ``no_intersection``, ``empty`` and ``split`` are
    refused; ``area`` is the pixels of what holds afterwards.
    """
    keys = list(keys)
    masks, cut = written(masks, "runs"), written(cut, "runs")
    common = measures(intersection(masks, cut, keys), keys).select(*keys, F.col("area").alias("_common"))
    left = written(difference(masks, cut, keys), "runs")
    parts = components(left, keys).groupBy(*keys).agg(F.count_distinct(F.struct(*PART)).alias("_parts"), F.sum(F.expr("x1 - x0 + 1")).alias("_left"))
    cuts = cut.select(*keys).distinct().withColumn("_cut", F.lit(True))
    known = measures(masks, keys).select(*keys, "area").join(cuts, keys, "left").join(common, keys, "left").join(parts, keys, "left")
    outcome = F.when(F.col("_cut").isNull(), NO_SHAPE).when(F.col("_common").isNull(), APART).when(F.col("_parts").isNull(), EMPTY)
    outcome = outcome.when(F.col("_parts") > 1, SPLIT).otherwise(SUBTRACTED)
    outcomes = known.select(*keys, outcome.alias("outcome"), F.when(outcome == SUBTRACTED, F.col("_left")).otherwise(F.col("area")).alias("area"))
    outcomes = written(outcomes, "outcomes")
    done = outcomes.where(F.col("outcome") == SUBTRACTED).select(*keys)
    columns = [*keys, "y", "x0", "x1"]
    return outcomes, left.join(done, keys, "left_semi").select(*columns).unionByName(masks.join(done, keys, "left_anti").select(*columns))


def final_mask(masks: DataFrame, cut: DataFrame, keys: Sequence[str] = IMAGE) -> tuple[DataFrame, DataFrame]:
    """(statistics, masks): ``cut`` (shapes of each image, which may overlap) taken off each mask, of what is left the largest part.

    Statistics are (keys, had_intersection, result_empty, discarded_fragments, area).
    """
    keys = list(keys)
    masks, cut = written(masks, "runs"), written(merged(cut, keys), "runs")
    common = written(intersection(masks, cut, keys).select(*keys).distinct().withColumn("_common", F.lit(True)), "touched")
    touched = masks.join(common, keys, "left_semi")
    kept = written(largest_part(difference(touched, cut, keys), keys), "runs")
    columns = [*keys, "y", "x0", "x1"]
    out = kept.select(*columns).unionByName(masks.join(common, keys, "left_anti").select(*columns))
    seen = kept.groupBy(*keys).agg(F.first("discarded").alias("_discarded"))
    area = measures(out, keys).select(*keys, "area")
    found = masks.select(*keys).distinct().join(common, keys, "left").join(seen, keys, "left").join(area, keys, "left")
    no = F.lit(False)
    return found.select(
        *keys, F.coalesce("_common", no).alias("had_intersection"), F.col("area").isNull().alias("result_empty"),
        F.coalesce("_discarded", no).alias("discarded_fragments"), F.coalesce("area", F.lit(0)).alias("area"),
    ), out


def ring_runs(rings: DataFrame, keys: Sequence[str] = IMAGE, points: str = "points") -> DataFrame:
    """The runs of filled rings (keys, points): pixels within by the even-odd rule, and those on the outline's lines.

    Vertices are rounded half to even. A line of the image is cut by the edges that cross it; from each odd cut to the next
    one all pixels are set. An edge itself sets one pixel for each step along its longer axis, the one nearest to it (of two
    equally near ones that nearer to its left end). Rings of fewer than three points have none.
    """
    return shape_runs(rings.select(*keys, F.array(points).alias("rings")), keys)


def shape_runs(shapes: DataFrame, keys: Sequence[str] = IMAGE, rings: str = "rings", band: int = BAND) -> DataFrame:
    """The runs of shapes (keys, rings): the first ring filled as by :func:`ring_runs`, less the fillings of the others.

    What meets are the edges of a shape that reach into a band of lines; no task holds more of a shape than a band.
    """
    keys = list(keys)
    vertex = lambda v: F.struct(F.bround(v["x"]).cast("long").alias("x"), F.bround(v["y"]).cast("long").alias("y"))
    each = shapes.select(*keys, F.posexplode(rings).alias("_ring", "p")).where(F.size("p") >= 3).select(*keys, "_ring", F.transform("p", vertex).alias("p"))
    pairs = F.transform("p", lambda a, i: F.struct(a.alias("a"), F.get(F.col("p"), (i + 1) % F.size("p")).alias("b")))
    edge = F.struct(F.col("_ring").cast("long").alias("ring"), *(F.col(f"e.{v}.{c}").alias(f"{v}{c}") for v in "ab" for c in "xy"))
    bands = F.sequence(F.floor(F.least("e.a.y", "e.b.y") / band), F.floor(F.greatest("e.a.y", "e.b.y") / band))
    edges = each.select(*keys, "_ring", F.explode(pairs).alias("e")).select(*keys, F.explode(bands).alias("_band"), edge.alias("e"))
    held = edges.groupBy(*keys, "_band").agg(F.collect_list("e").alias("e"))
    out = ["y", "x0", "x1"]

    def runs(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                lists = batch.column(len(keys) + 1)
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                parts = lists.flatten().flatten()
                if any(c.null_count for c in parts):  # edges of points without a place
                    good = ~np.any([c.is_null().to_numpy(zero_copy_only=False) for c in parts], axis=0)
                    owner, parts = owner[good], [c.filter(pa.array(good)) for c in parts]
                low = batch.column(len(keys)).to_numpy(zero_copy_only=False)[owner] * band
                at, *found = _shape_runs(owner, *(c.to_numpy(zero_copy_only=False) for c in parts), low, low + band - 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(len(keys))), *map(pa.array, found)], [*keys, *out])

    schema = StructType([*(shapes.schema[k] for k in keys), *(StructField(c, LongType()) for c in out)])
    return held.mapInArrow(runs, schema)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all whole numbers from each ``first`` to its ``last``."""
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]


def _shape_runs(owner, ring, ax, ay, bx, by, low, high) -> tuple[np.ndarray, ...]:
    """(owner, y, x0, x1) of the filled shapes whose edges these are, within their lines ``low`` to ``high``."""
    # from each odd cut of a line to the next one; an edge's lower end is left out
    which, y = _spread(np.where(ay == by, high + 1, np.maximum(np.minimum(ay, by), low)), np.minimum(np.maximum(ay, by) - 1, high))
    cut = ax[which] + (y - ay[which]) * (bx - ax)[which] / (by - ay)[which]
    of, turn = owner[which], ring[which]
    order = np.lexsort((cut, y, turn, of))
    cut, y, of, turn = cut[order], y[order], of[order], turn[order]
    new = np.ones(len(cut), bool)
    new[1:] = (np.diff(of) != 0) | (np.diff(turn) != 0) | (np.diff(y) != 0)
    place = np.arange(len(cut)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(cut) else np.empty(0, np.int64)
    odd = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:])
    found = [(of[odd], turn[odd], y[odd], np.ceil(cut[odd]).astype(np.int64), np.floor(cut[odd + 1]).astype(np.int64))]
    # the outline's pixels, from each edge's left end: k * short / long, halves down
    back = (bx < ax) | (bx == ax) & (by < ay)
    x, top, dx, dy = np.where(back, bx, ax), np.where(back, by, ay), np.abs(bx - ax), np.where(back, ay - by, by - ay)
    up, size = np.sign(dy), np.abs(dy)
    first = np.where(up < 0, top - high, low - top)  # lines from the left end on that are in the band
    last = np.where(up < 0, top - low, high - top)
    first, last = np.where(up == 0, np.where((low <= top) & (top <= high), 0, 1), np.maximum(first, 0)), np.where(up == 0, 0, np.minimum(last, size))
    which, line = _spread(first, last)
    long, short, flat = dx[which], size[which], (dx >= size)[which]
    twice = np.maximum(2 * short, 1)
    begin = np.where(flat, np.where(short == 0, 0, np.maximum(long * (2 * line - 1) // twice + 1, 0)), -((short - 2 * line * long) // twice))
    end = np.where(flat, np.where(short == 0, long, np.minimum(long * (2 * line + 1) // twice, long)), begin)
    found.append((owner[which], ring[which], top[which] + up[which] * line, x[which] + begin, x[which] + end))
    of, turn, y, x0, x1 = map(np.concatenate, zip(*found))
    good = x0 <= x1
    of, turn, y, x0, x1 = of[good], turn[good], y[good], x0[good], x1[good]
    # set where the first ring covers and no other: a sweep over the ends of runs
    by_a = np.where(turn == 0, 1, 0)
    of, y, x, a, b = np.tile(of, 2), np.tile(y, 2), np.concatenate([x0, x1 + 1]), np.concatenate([by_a, -by_a]), np.concatenate([1 - by_a, by_a - 1])
    order = np.lexsort((x, y, of))
    of, y, x, a, b = of[order], y[order], x[order], np.cumsum(a[order]), np.cumsum(b[order])
    final = np.ones(len(x), bool)  # of the ends at a place
    final[:-1] = (np.diff(of) != 0) | (np.diff(y) != 0) | (np.diff(x) != 0)
    of, y, x, on = of[final], y[final], x[final], ((a > 0) & (b == 0))[final]
    before = np.concatenate([[False], on[:-1]])
    start, stop = np.flatnonzero(on & ~before), np.flatnonzero(~on & before)
    return of[start], y[start], x[start], x[stop] - 1


def run_overlaps(left: DataFrame, right: DataFrame, within: Sequence[str] = (), cell: int = 256) -> DataFrame:
    """(within, a, b, common, iou) of the masks (within, id, y, x0, x1) of both sides that share a pixel.

    Runs of a line meet in cells of ``cell`` pixels; a pair of runs is counted in the cell where what they share begins.
    """
    within = list(within)

    def put(runs: DataFrame, side: str) -> DataFrame:
        cells = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))
        return runs.select(*within, "y", cells.alias("_cell"), F.col("id").alias(side), F.col("x0").alias(f"{side}0"), F.col("x1").alias(f"{side}1"))

    start, end = F.greatest("a0", "b0"), F.least("a1", "b1")
    met = put(left, "a").join(many(put(right, "b")), [*within, "y", "_cell"]).where((start <= end) & (F.floor(start / cell) == F.col("_cell")))
    common = met.groupBy(*within, "a", "b").agg(F.sum(end - start + 1).alias("common"))
    areas = [r.groupBy(*within, F.col("id").alias(side)).agg(F.sum(F.expr("x1 - x0 + 1")).alias(f"{side}_area")) for r, side in ((left, "a"), (right, "b"))]
    found = common.join(many(areas[0]), [*within, "a"]).join(many(areas[1]), [*within, "b"])
    return found.select(*within, "a", "b", "common", (F.col("common") / (F.col("a_area") + F.col("b_area") - F.col("common"))).alias("iou"))


def dilated(runs: DataFrame, sizes: DataFrame, along: int, across: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The mask and all within ``along`` columns and ``across`` lines of it, inside the image; ``sizes`` has (keys, width, height)."""
    keys = list(keys)
    lines = F.explode(F.sequence(F.greatest(F.col("y") - across, F.lit(0)), F.least(F.col("y") + across, F.col("height") - 1)))
    x0, x1 = F.greatest(F.col("x0") - along, F.lit(0)), F.least(F.col("x1") + along, F.col("width") - 1)
    wide = runs.join(sizes, keys).select(*keys, lines.alias("y"), x0.cast("long").alias("x0"), x1.cast("long").alias("x1"))
    return merged(wide, keys)


def eroded(runs: DataFrame, sizes: DataFrame, along: int, across: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The pixels of a mask that has all within ``along`` columns and ``across`` lines of them, as far as the image goes.

    Each line's runs are shortened and laid over the lines beside it; a pixel stays where as many lines cover it as there are.
    """
    keys = list(keys)
    safe_unions(runs.sparkSession)
    x0 = F.when(F.col("x0") <= 0, F.lit(0)).otherwise(F.col("x0") + along)
    x1 = F.when(F.col("x1") >= F.col("width") - 1, F.col("width") - 1).otherwise(F.col("x1") - along)
    lines = F.explode(F.sequence(F.greatest(F.col("y") - across, F.lit(0)), F.least(F.col("y") + across, F.col("height") - 1)))
    short = runs.join(sizes, keys).select(*keys, "height", lines.alias("y"), x0.cast("long").alias("x0"), x1.cast("long").alias("x1")).where("x0 <= x1")
    there = F.least(F.col("y") + across, F.col("height") - 1) - F.greatest(F.col("y") - across, F.lit(0)) + 1
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("by")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("by")))
    each = short.select(*keys, "y", there.alias("_there"), F.explode(ends).alias("e")).select(*keys, "y", "_there", "e.x", "e.by")
    w = _line(keys).orderBy("x")
    depth = each.select(*keys, "y", "_there", "x", F.sum("by").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("_deep"), F.lead("x").over(w).alias("_next"))
    kept = depth.where((F.col("_next") > F.col("x")) & (F.col("_deep") == F.col("_there")))
    return merged(kept.select(*keys, "y", F.col("x").alias("x0"), (F.col("_next") - 1).alias("x1")), keys)


def closed(runs: DataFrame, sizes: DataFrame, reach: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Gaps up to twice ``reach`` wide closed: dilated, then eroded by squares."""
    return eroded(dilated(runs, sizes, reach, reach, keys), sizes, reach, reach, keys)


def opened(runs: DataFrame, sizes: DataFrame, reach: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """What is narrower than twice ``reach`` and one taken away: eroded, then dilated by squares."""
    return dilated(eroded(runs, sizes, reach, reach, keys), sizes, reach, reach, keys)


def tidy(runs: DataFrame, sizes: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """A mask closed by 5 x 5 and opened by 3 x 3, without holes, of which the largest part is kept."""
    return largest_part(filled(opened(closed(runs, sizes, 2, keys), sizes, 1, keys), keys), keys).select(*keys, "y", "x0", "x1")


def distances(runs: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """(keys, x, y, square): the square of each set pixel's distance to the nearest one that isn't set; beyond the image none is.

    A run gives the distance along its line. Then each column's stretches of set pixels are one array each, in which a pixel
    looks at the lines that may be nearer, as many as its distance along the line.
    """
    keys = list(keys)
    flat = F.least(F.col("x") - F.col("x0"), F.col("x1") - F.col("x")) + 1
    pixels = runs.select(*keys, "y", "x0", "x1", F.explode(F.sequence("x0", "x1")).alias("x")).select(*keys, "x", "y", flat.alias("g"))
    stretch = F.col("y") - F.row_number().over(Window.partitionBy(*keys, "x").orderBy("y"))
    columns = pixels.withColumn("_run", stretch).groupBy(*keys, "x", "_run").agg(F.min("y").alias("_y"), F.transform(F.sort_array(F.collect_list(F.struct("y", "g"))), lambda p: p["g"]).alias("_g"))
    n = F.size("_g")

    def nearest(g: Column, i: Column) -> Column:
        free = F.least(i + 1, n - i)  # to the pixels beyond the stretch
        reach = F.least(g, free.cast("long"))
        low, high = F.greatest(i - reach, F.lit(0)), F.least(i + reach, n - 1)
        beside = F.transform(F.sequence(low, high), lambda j: F.get(F.col("_g"), j.cast("int")) * F.get(F.col("_g"), j.cast("int")) + (i - j) * (i - j))
        return F.least(free.cast("long") * free, F.array_min(beside))

    each = columns.select(*keys, "x", "_y", F.posexplode(F.transform("_g", nearest)).alias("_i", "square"))
    return each.select(*keys, "x", (F.col("_y") + F.col("_i")).alias("y"), "square")
