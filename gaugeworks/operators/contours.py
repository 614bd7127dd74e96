"""Outlines: rings traced around masks, and rings with fewer vertices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..session import safe_unions, written
from .masks import BAND, IMAGE, PART, _spread, components, whole_groups

#: Directions of an edge: right, down, left, up; the mask lies on its right.
RIGHT, DOWN, LEFT, UP = range(4)


def _edges(group, base, y, x0, x1, band: int) -> tuple[np.ndarray, ...]:
    """(group, y, x, turn, pixel's y, pixel's x) of the unit edges between masks and background that begin in the ``band`` lines
    from each group's ``base`` on, sorted. Runs come by group, line and place, those of the line above the band included."""
    found = [(group, y + 1, x0, np.full_like(y, UP), y, x0), (group, y, x1 + 1, np.full_like(y, DOWN), y, x1)]
    wide = x1.max() - x0.min() + 3
    line = (group * (band + 4) + y - base[group] + 2) * wide - x0.min()
    for by, turn in ((-1, RIGHT), (1, LEFT)):
        # what the next line's runs leave free of a run lies before, between and after those that meet it
        first = np.searchsorted(line + x1, line + by * wide + x0)
        met = np.maximum(np.searchsorted(line + x0, line + by * wide + x1, "right") - first, 0)
        of, k = _spread(np.zeros_like(met), met)
        beside = first[of] + k
        left = np.where(k == 0, x0[of], x1[np.maximum(beside - 1, 0)] + 1)
        right = np.where(k == met[of], x1[of], x0[np.minimum(beside, len(y) - 1)] - 1)
        at, x = _spread(left, right)
        at = of[at]
        found.append((group[at], y[at] + (turn == LEFT), x + (turn == LEFT), np.full_like(x, turn), y[at], x))
    edges = np.array([np.concatenate(c) for c in zip(*found)])
    edges = edges[:, (edges[1] >= base[edges[0]]) & (edges[1] < base[edges[0]] + band)]
    return tuple(edges[:, np.lexsort(edges[3::-1])])


def _pieces(group, base, y, x0, x1, band: int) -> tuple:
    """(edges, ends, order, first, closed): the edges and where they end, their order by pieces of lines, where each piece begins
    in it, and whether it is a whole closed line. That begins with its first edge; others are cut before their first edge."""
    g, sy, sx, turn, *_ = edges = _edges(group, base, y, x0, x1, band)
    n = len(g)
    ey, ex = sy + (turn == DOWN) - (turn == UP), sx + (turn == RIGHT) - (turn == LEFT)
    wide = x1.max() - x0.min() + 3
    code = lambda y, x: (g * (band + 4) + y - base[g] + 2) * wide + x - x0.min()
    starts, stops = code(sy, sx), code(ey, ex)
    one, beyond = np.searchsorted(starts, stops), np.searchsorted(starts, stops, "right")
    follower = np.where(beyond > one, one, n)
    two = np.flatnonzero(beyond - one == 2)
    sharper = (turn[one[two] + 1] - turn[two] + 1) % 4 < (turn[one[two]] - turn[two] + 1) % 4  # left 0, straight 1, right 2
    follower[two[sharper]] += 1
    # the first edge among those ahead, twice as many in each round; n stands for what lies in other bands
    best, ahead = np.arange(n + 1), np.append(follower, n)
    while True:
        better, further = np.minimum(best, best[ahead]), ahead[ahead]
        done = np.array_equal(better, best) and np.count_nonzero(further == n) == np.count_nonzero(ahead == n)
        best, ahead = better, further
        if done:
            break
    closed, before = ahead[:n] != n, np.full(n + 1, -1)
    before[follower] = np.arange(n)
    before = before[:n]
    before[best[:n][closed | (before < 0)]] = -1
    root, away = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64)
    while not np.array_equal(root, root[root]):
        root, away = root[root], away + away[root]
    order = np.lexsort((away, root))
    first = np.flatnonzero(away[order] == 0)
    return edges, (ey, ex), order, first, closed[order[first]]


def pieces(runs: DataFrame, keys: Sequence[str] = IMAGE, band: int = BAND) -> DataFrame:
    """(keys, closed, e, end, n, area, p): the lines around masks, which lie on their right, cut where they leave a band of lines.

    ``e`` is struct (y, x, turn), where the first edge begins and its direction, ``end`` where the last one ends and its direction,
    ``n`` the number of edges, ``area`` their share of twice the signed area and ``p`` the mask's pixels along them. An edge is
    followed by one that begins where it ends; where two do, by the one to the left, which joins pixels that touch by a corner.
    A task holds one band and the line above it, whatever a mask's size. Runs without a key give none.
    """
    keys = list(keys)
    y = F.col("y")
    bands = F.explode(F.array_distinct(F.array(F.floor(y / band), F.floor((y + 1) / band))))
    placed = runs.dropna(subset=keys).select(*keys, bands.alias("_band"), *(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")))
    own = [*keys, "_band"]
    placed = placed.repartition(*own).sortWithinPartitions(*own, "y", "x0")
    corner = pa.struct([("y", pa.int64()), ("x", pa.int64()), ("turn", pa.int32())])

    def drawn(pdf: pd.DataFrame) -> pa.RecordBatch:
        new = (pdf[own] != pdf[own].shift()).any(axis=1).to_numpy()
        start = np.flatnonzero(new)
        base = pdf["_band"].to_numpy(np.int64)[start] * band
        (g, sy, sx, turn, py, px), (ey, ex), order, first, closed = _pieces(new.cumsum() - 1, base, *(pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1")), band)
        bounds = np.append(first, len(order))
        head, tail = order[first], order[bounds[1:] - 1]
        struct = lambda at, y, x: pa.StructArray.from_arrays([pa.array(y[at]), pa.array(x[at]), pa.array(turn[at].astype(np.int32))], fields=list(corner))
        part = np.where(turn == RIGHT, -sy, np.where(turn == LEFT, sy, 0))[order]
        py, px = py[order], px[order]
        walked = np.ones(len(order), bool)
        walked[1:] = (np.diff(py) != 0) | (np.diff(px) != 0)
        walked[first] = True
        pixels = pa.StructArray.from_arrays([pa.array(py[walked]), pa.array(px[walked])], ["y", "x"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, walked.cumsum())[bounds], pa.int32()), pixels)
        of = pa.RecordBatch.from_pandas(pdf[keys].iloc[start[g[head]]], preserve_index=False).columns
        found = [pa.array(closed), struct(head, sy, sx), struct(tail, ey, ex), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(part, first)), lists]
        return pa.RecordBatch.from_arrays([*of, *found], [*keys, "closed", "e", "end", "n", "area", "p"])

    place = "struct<y: bigint, x: bigint, turn: int>"
    shape = StructType.fromDDL(f"closed boolean, e {place}, end {place}, n bigint, area bigint, p array<struct<y: bigint, x: bigint>>")
    shape = StructType([*(placed.schema[k] for k in keys), *shape.fields])
    return placed.mapInArrow(lambda batches: whole_groups(own, drawn)(b.to_pandas() for b in batches), shape)


def _lines(open_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, e, loop, away): for each piece the first edge of its closed line, and how many edges on that is. Places come from
    pointer doubling: in each round a piece learns the first edge among twice as many pieces, so no line is gathered."""
    begins = open_.select(*keys, F.struct("e.y", "e.x").alias("_at"), F.col("e").alias("next"))
    ends = open_.select(*keys, F.struct("end.y", "end.x").alias("_at"), "e", "end.turn", "n")
    turn = F.pmod(F.col("next.turn") - F.col("turn") + 1, F.lit(4))
    linked = ends.join(begins, [*keys, "_at"]).groupBy(*keys, "e").agg(F.min_by("next", turn).alias("next"), F.first("n").alias("n"))
    known = written(linked.select(*keys, "e", "next", "n", F.col("e").alias("loop"), F.lit(0).cast("long").alias("away")), "lines")
    while True:
        ahead = known.select(*keys, F.col("e").alias("next"), *(F.col(c).alias(f"_{c}") for c in ("next", "n", "loop", "away")))
        better = F.col("_loop") < F.col("loop")
        known = written(
            known.join(ahead, [*keys, "next"]).select(
                *keys, "e", F.col("_next").alias("next"), (F.col("n") + F.col("_n")).alias("n"), F.when(better, F.col("_loop")).otherwise(F.col("loop")).alias("loop"),
                F.when(better, F.col("n") + F.col("_away")).otherwise(F.col("away")).alias("away"), better.alias("_moved"),
            ), "lines",
        )
        if known.where("_moved").isEmpty():
            return known.select(*keys, "e", "loop", "away")
        known = known.drop("_moved")


def contours(runs: DataFrame, keys: Sequence[str] = IMAGE, band: int = BAND) -> DataFrame:
    """(keys, loop, hole, n_edges, points): each closed line as the centres of the mask's pixels along it, in order from the
    first by line; outer ones clockwise (y down), those around holes the other way. ``loop`` is struct (y, x, turn), its first edge."""
    keys = list(keys)
    safe_unions(runs.sparkSession)
    drawn = written(pieces(runs, keys, band), "pieces")
    found, open_ = drawn.where("closed").select(*keys, F.col("e").alias("loop"), "area", "n", "p"), drawn.where("not closed")
    if not open_.isEmpty():
        parts = F.sort_array(F.collect_list(F.struct((F.col("away") > 0).alias("later"), (-F.col("away")).alias("place"), "p")))
        joined = open_.join(_lines(open_, keys), [*keys, "e"]).groupBy(*keys, "loop")
        joined = joined.agg(F.sum("area").alias("area"), F.sum("n").alias("n"), F.flatten(F.transform(parts, lambda v: v["p"])).alias("p"))
        found = found.unionByName(joined)
    before = lambda i: F.get(F.col("p"), i - 1)
    walked = F.filter("p", lambda v, i: (i == 0) | (v != before(i)))
    # edges at the end may be of the first pixel again
    again = G.bound(walked, lambda w: F.when((F.size(w) > 1) & (F.element_at(w, -1) == F.get(w, F.lit(0))), F.slice(w, 1, F.size(w) - 1)).otherwise(w))
    points = F.transform(again, lambda v: G.point(v["x"], v["y"]))
    # holes enclose negative areas
    return found.select(*keys, "loop", (F.col("area") < 0).alias("hole"), F.col("n").alias("n_edges"), points.alias("points"))


def mask_rings(runs: DataFrame, keys: Sequence[str] = IMAGE, epsilon: float = 1e-4) -> DataFrame:
    """(keys, rings): of each mask the outer ring that encloses most, then the rings of its holes of one pixel² or more, by
    line; vertices on straight lines left out, outer rings turning one way and holes the other. Masks whose largest ring
    has fewer than three vertices have no row."""
    keys = list(keys)
    runs = written(runs.select(*keys, "y", "x0", "x1"), "runs")
    drawn = written(contours(runs, keys), "contours")
    # a line belongs to the part of the pixel beside its first edge
    leader = drawn.select(*keys, "loop", "hole", "points", F.get("points", F.lit(0)).alias("p"))
    parts = components(runs, keys)
    at = leader.withColumn("y", F.col("p.y").cast("long")).join(parts, [*keys, "y"]).where("p.x between x0 and x1")
    ring = G.clean_ring(F.col("points"), epsilon)
    rings = at.select(*keys, *PART, "loop", "hole", ring.alias("ring"), G.polygon_area(F.col("points")).alias("area"))
    best = rings.where("not hole").groupBy(*keys).agg(F.max_by(F.struct(*PART, "ring"), F.struct("area", -F.col("part_y"), -F.col("part_x"))).alias("best"))
    best = best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in PART), F.col("best.ring").alias("outer")).where(F.size("outer") >= 3)
    inner = rings.where(F.col("hole") & (F.size("ring") >= 3) & (F.col("area") >= 1)).groupBy(*keys, *PART)
    inner = inner.agg(F.transform(F.sort_array(F.collect_list(F.struct("loop", "ring"))), lambda v: v["ring"]).alias("inner"))
    whole = F.concat(F.array("outer"), F.coalesce("inner", F.slice(F.array("outer"), 1, 0)))
    return best.join(inner, [*keys, *PART], "left").select(*keys, G.oriented(whole).alias("rings"))


def display_epsilon(points: Column) -> Column:
    """How far a drawn ring may be off: 0.35 % of its length, one pixel at least."""
    return F.greatest(F.lit(1.0), _around(points) * 0.0035)


def outline_epsilon(points: Column) -> Column:
    """How far the outline of a mask may be off: 0.045 % of its length, 0.35 pixels at least."""
    return F.greatest(F.lit(0.35), _around(points) * 0.00045)


def _around(points: Column) -> Column:
    return G.polyline_length(F.concat(points, F.slice(points, 1, 1)))


def _farthest(points: Column, start: Column) -> Column:
    """struct (d, i): the point farthest from the one at ``start``, the first such after it around the ring; d squared."""
    n, p = F.greatest(F.size(points), F.lit(1)), F.get(points, start)

    def away(j: Column) -> Column:
        q = F.get(points, F.pmod(start + j, n))
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        return F.struct((dx * dx + dy * dy).alias("d"), (-j).alias("back"), F.pmod(start + j, n).alias("i"))

    return F.array_max(F.transform(F.sequence(F.lit(0), n - 1), away))


def simplified(rings: DataFrame, keys: Sequence[str], epsilon: Column, points: str = "points", clean: float = 1e-4) -> DataFrame:
    """(keys, points): rings (keys, points) without the vertices that lie within ``epsilon``, an expression over the cleaned
    ring in ``points``, of what is left.

    The ring is cut at two points far from each other. Then, stretch by stretch, the vertex farthest from the straight line
    becomes a cut of its own where it is farther than ``epsilon``. Stretches of all rings are rows and are cut level by level.
    A ring that would keep fewer than three vertices stays as it is. Null rings give null.
    """
    keys = list(keys)
    safe_unions(rings.sparkSession)
    cleaned = written(rings.select(*keys, G.clean_ring(F.col(points), clean).alias("points")), "rings")
    n = F.greatest(F.size("points"), F.lit(1))
    # the point farthest from the point that is farthest from the first one, and the one farthest from that; each is worked
    # out once and the table written, as a filter would repeat them for every vertex of every vertex
    pts = F.col("points")

    def turned(one: Column, two: Column) -> Column:
        from_one = F.transform(F.sequence(F.lit(0), n), lambda j: F.get(pts, F.pmod(j + one, n)))
        return F.struct(two["d"].alias("d"), F.pmod(two["i"] - one, n).alias("m"), from_one.alias("p"))

    cut = G.bound(_farthest(pts, F.lit(0)), lambda a: G.bound(_farthest(pts, a["i"])["i"], lambda one: G.bound(_farthest(pts, one), lambda two: turned(one, two))))
    far = written(cleaned.where(n >= 3).select(*keys, epsilon.alias("_eps"), cut.alias("_cut")), "turned-rings")
    far = far.where(F.col("_cut.d") > F.col("_eps") * F.col("_eps")).select(*keys, "_eps", "_cut.p", "_cut.m")
    ends = [F.struct(F.lit(0).alias("i"), F.get("p", F.lit(0)).alias("p")), F.struct(F.col("m").alias("i"), F.get("p", F.col("m")).alias("p"))]
    cuts = [written(far.select(*keys, F.explode(F.array(*ends)).alias("v")).select(*keys, "v.i", "v.p"), "cuts")]
    open_ = far.select(*keys, "_eps", "m", "p", F.posexplode("p").alias("i", "v")).where((F.col("i") > 0) & (F.col("i") < F.size("p") - 1) & (F.col("i") != F.col("m")))
    early = F.col("i") < F.col("m")
    begin, middle, end = F.get("p", F.lit(0)), F.get("p", F.col("m")), F.element_at("p", -1)
    rows = open_.select(
        *keys, "_eps", "i", "v", F.when(early, 0).otherwise(F.col("m")).alias("a"),
        F.when(early, begin).otherwise(middle).alias("va"), F.when(early, middle).otherwise(end).alias("vb"),
    )
    dx, dy = F.col("vb.x") - F.col("va.x"), F.col("vb.y") - F.col("va.y")
    off = F.abs((F.col("v.y") - F.col("va.y")) * dx - (F.col("v.x") - F.col("va.x")) * dy)
    stretch = Window.partitionBy(*keys, "a")
    while True:
        top = F.max(F.struct(off.alias("d"), (-F.col("i")).alias("back"), F.col("v").alias("v"))).over(stretch)
        split = rows.withColumn("_top", top).where(F.col("_top.d") * F.col("_top.d") > F.col("_eps") * F.col("_eps") * (dx * dx + dy * dy))
        split = written(split.withColumn("_m", -F.col("_top.back")), "stretches")
        found = split.where("i = _m")
        if found.isEmpty():
            break
        cuts.append(found.select(*keys, "i", F.col("v").alias("p")))
        early = F.col("i") < F.col("_m")
        rows = split.where("i <> _m").select(
            *keys, "_eps", "i", "v", F.when(early, F.col("a")).otherwise(F.col("_m")).alias("a"),
            F.when(early, F.col("va")).otherwise(F.col("_top.v")).alias("va"), F.when(early, F.col("_top.v")).otherwise(F.col("vb")).alias("vb"),
        )
    vertices = cuts[0]
    for more in cuts[1:]:
        vertices = vertices.unionByName(more)
    kept = vertices.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda v: v["p"]).alias("_kept"))
    use = F.when(F.size("_kept") >= 3, F.col("_kept")).otherwise(F.col("points"))
    return cleaned.join(kept, keys, "left").select(*keys, G.clean_ring(use, clean).alias("points"))
