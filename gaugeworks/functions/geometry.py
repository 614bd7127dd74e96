"""Planar geometry over points (struct x, y), paths and rings (arrays of points), as column expressions.

Everything here is a composition of higher-order functions, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
TINY = 1e-9


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    """Length of a segment; sqrt of squares, which every engine rounds alike."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def line_length(line: Column) -> Column:
    return distance(line["start"], line["end"])


def midpoint(a: Column, b: Column) -> Column:
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def scale(a: Column, by) -> Column:
    return point(a["x"] * by, a["y"] * by)


def normalize(a: Column) -> Column:
    """Unit vector; the zero vector becomes (1, 0)."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, point(F.lit(1), F.lit(0))).otherwise(point(a["x"] / F.nullif(n, F.lit(0.0)), a["y"] / F.nullif(n, F.lit(0.0))))


def clamp(value: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, value))


def pixel_center(p: Column) -> Column:
    return point(F.floor(p["x"]) + 0.5, F.floor(p["y"]) + 0.5)


def _edges(points: Column, closed: bool) -> Column:
    """Pairs (a, b) of neighbouring vertices; ``closed`` adds the edge from the last to the first."""
    n = F.size(points)
    last = n if closed else n - 1
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))),
        lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, (i + 1) % F.greatest(n, F.lit(1))).alias("b")),
    )
    return F.slice(pairs, 1, F.greatest(last, F.lit(0)))


def _sum(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + value(e))


def cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def polyline_length(points: Column) -> Column:
    """0 for fewer than two points."""
    return _sum(_edges(points, False), lambda e: distance(e["a"], e["b"]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ring_moments(points: Column) -> Column:
    """struct (a, cx, cy) in one pass: twice the signed area and, times three of it, the centroid's offset from the
    first vertex. Taken from there, so that flat rings far from the origin keep their digits."""
    first = F.get(points, F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        x, y = p["x"] - first["x"], p["y"] - first["y"]
        c = acc["x"] * y - x * acc["y"]
        return F.struct(
            x.alias("x"), y.alias("y"), (acc["a"] + c).alias("a"), (acc["cx"] + (acc["x"] + x) * c).alias("cx"), (acc["cy"] + (acc["y"] + y) * c).alias("cy")
        )

    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("x", "y", "a", "cx", "cy")))
    return F.aggregate(points, zero, step)


def ring_signed_area(points: Column) -> Column:
    """Shoelace sum, the ring closed by itself; 0 for fewer than three points."""
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(_sum(_edges(points, True), cross) / 2)


def polygon_area(points: Column) -> Column:
    return F.abs(ring_signed_area(points))


def bounds(points: Column) -> Column:
    """struct min_x, min_y, max_x, max_y; zeros without points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    zero = F.lit(0.0)
    return F.struct(
        F.coalesce(F.array_min(xs), zero).alias("min_x"),
        F.coalesce(F.array_min(ys), zero).alias("min_y"),
        F.coalesce(F.array_max(xs), zero).alias("max_x"),
        F.coalesce(F.array_max(ys), zero).alias("max_y"),
    )


def bounds_center(points: Column) -> Column:
    b = bounds(points)
    return point((b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2)


def _centroid(points: Column, m: Column) -> Column:
    first, safe = F.get(points, F.lit(0)), F.nullif(m["a"], F.lit(0.0)) * 3
    whole = point(first["x"] + m["cx"] / safe, first["y"] + m["cy"] / safe)
    return F.when((F.size(points) == 0) | (F.abs(m["a"]) < TINY), bounds_center(points)).otherwise(whole)


def polygon_centroid(points: Column) -> Column:
    """Area-weighted; the centre of the bounds when the area vanishes."""
    return bound(ring_moments(points), lambda m: _centroid(points, m))


def polyline_centroid(points: Column) -> Column:
    """Midpoints weighted by length; a single point is itself."""
    edges = F.filter(_edges(points, False), lambda e: distance(e["a"], e["b"]) > TINY)
    total = _sum(edges, lambda e: distance(e["a"], e["b"]))
    cx = _sum(edges, lambda e: (e["a"]["x"] + e["b"]["x"]) / 2 * distance(e["a"], e["b"]))
    cy = _sum(edges, lambda e: (e["a"]["y"] + e["b"]["y"]) / 2 * distance(e["a"], e["b"]))
    safe = F.nullif(total, F.lit(0.0))
    return F.when(total <= TINY, bounds_center(points)).otherwise(point(cx / safe, cy / safe))


def rings_hole_area(rings: Column) -> Column:
    holes = F.filter(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), lambda r: F.size(r) >= 3)
    return F.when(F.size(rings) <= 1, F.lit(0.0)).otherwise(_sum(holes, polygon_area))


def rings_area(rings: Column) -> Column:
    """Outer ring less holes, not below 0; 0 without a proper outer ring."""
    outer = F.get(rings, F.lit(0))
    return F.when((F.size(rings) == 0) | (F.size(outer) < 3), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), polygon_area(outer) - rings_hole_area(rings))
    )


def rings_centroid(rings: Column) -> Column:
    """Centroids weighted by area, holes negative; the centre of all points' bounds when weights vanish."""

    def weigh(r: Column, i: Column) -> Column:
        sign = F.when(i == 0, 1.0).otherwise(-1.0)
        return bound(ring_moments(r), lambda m: F.struct((F.abs(m["a"]) / 2 * sign).alias("w"), _centroid(r, m).alias("c"), F.size(r).alias("n")))

    def sums(acc: Column, e: Column) -> Column:
        w = F.when((e["n"] >= 3) & (F.abs(e["w"]) > TINY), e["w"]).otherwise(0.0)
        return F.struct((acc["w"] + w).alias("w"), (acc["x"] + e["c"]["x"] * w).alias("x"), (acc["y"] + e["c"]["y"] * w).alias("y"))

    total = F.aggregate(F.transform(rings, weigh), F.struct(*(F.lit(0.0).alias(n) for n in ("w", "x", "y"))), sums)
    return bound(
        total,
        lambda t: F.when(F.abs(t["w"]) < TINY, bounds_center(F.flatten(rings))).otherwise(
            point(t["x"] / F.nullif(t["w"], F.lit(0.0)), t["y"] / F.nullif(t["w"], F.lit(0.0)))
        ),
    )


def near_bounds(p: Column, b: Column, tolerance) -> Column:
    return (
        (p["x"] >= b["min_x"] - tolerance) & (p["x"] <= b["max_x"] + tolerance) & (p["y"] >= b["min_y"] - tolerance) & (p["y"] <= b["max_y"] + tolerance)
    )


def point_in_polygon(p: Column, points: Column) -> Column:
    """Even-odd ray casting; false for fewer than three points."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dy = b["y"] - a["y"]
        dy = F.when(dy == 0, F.lit(TINY)).otherwise(dy)
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / dy + a["x"])

    hits = F.size(F.filter(_edges(points, True), crosses))
    return (F.size(points) >= 3) & (hits % 2 == 1)


def point_in_rings(p: Column, rings: Column) -> Column:
    """Inside the outer ring and in no hole."""
    outer = F.get(rings, F.lit(0))
    holes = F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1)))
    in_hole = F.exists(holes, lambda r: (F.size(r) >= 3) & point_in_polygon(p, r))
    return (F.size(rings) > 0) & point_in_polygon(p, outer) & ~in_hole


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """To the nearest point of the segment; a degenerate one is its start."""
    vx, vy = b["x"] - a["x"], b["y"] - a["y"]
    square = vx * vx + vy * vy
    along = clamp(((p["x"] - a["x"]) * vx + (p["y"] - a["y"]) * vy) / F.nullif(square, F.lit(0.0)), 0.0, 1.0)
    along = F.when(square == 0, F.lit(0.0)).otherwise(along)
    return distance(p, point(a["x"] + along * vx, a["y"] + along * vy))


def _least(distances: Column) -> Column:
    return F.coalesce(F.array_min(distances), F.lit(float("inf")))


def polyline_distance(p: Column, points: Column) -> Column:
    """To the path; to the point if there is one only; infinite without points."""
    single = F.when(F.size(points) == 1, distance(p, F.get(points, F.lit(0))))
    return F.coalesce(single, _least(F.transform(_edges(points, False), lambda e: segment_distance(p, e["a"], e["b"]))))


def polygon_edge_distance(p: Column, points: Column) -> Column:
    return F.when(F.size(points) < 2, F.lit(float("inf"))).otherwise(
        _least(F.transform(_edges(points, True), lambda e: segment_distance(p, e["a"], e["b"])))
    )


def rings_edge_distance(p: Column, rings: Column) -> Column:
    return _least(F.transform(F.filter(rings, lambda r: F.size(r) >= 2), lambda r: polygon_edge_distance(p, r)))


def translate(points: Column, dx, dy) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def nearest_endpoint(line: Column, p: Column) -> Column:
    """struct (name, distance); the start on a tie."""
    start, end = distance(line["start"], p), distance(line["end"], p)
    return F.when(start <= end, F.struct(F.lit("start").alias("name"), start.alias("distance"))).otherwise(
        F.struct(F.lit("end").alias("name"), end.alias("distance"))
    )


def oriented(rings: Column) -> Column:
    """Outer ring with a non-negative signed area, holes with a non-positive one."""

    def turned(r: Column, i: Column) -> Column:
        wrong = lambda a: ((i == 0) & (a < 0)) | ((i > 0) & (a > 0))
        return bound(ring_signed_area(r), lambda a: F.when(wrong(a), F.reverse(r)).otherwise(r))

    return F.transform(rings, turned)


def clean_ring(points: Column, epsilon: float = 1e-6) -> Column:
    """A ring without vertices that repeat the last kept one, that close it, or that lie on the line between their
    neighbours, by the area they span and by their distance; if fewer than three would be left, without repeats only."""

    def neighbour(ring: Column, i: Column, by: int) -> Column:
        n = F.greatest(F.size(ring), F.lit(1))
        return F.get(ring, F.pmod(i + by, n).cast("int"))

    def take(kept: Column, p: Column) -> Column:
        """``p`` after the points kept so far, unless it repeats the last of them."""
        near = (F.size(kept) > 0) & (distance(F.get(kept, F.size(kept) - 1), p) <= epsilon)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p)))

    repeats = F.exists(_edges(points, False), lambda e: distance(e["a"], e["b"]) <= epsilon)
    apart = F.when(repeats, F.aggregate(points, F.slice(points, 1, 0), take)).otherwise(points)
    closes = lambda r: (F.size(r) >= 2) & (distance(F.get(r, F.lit(0)), F.element_at(r, -1)) <= epsilon)
    opened = bound(apart, lambda r: F.when(closes(r), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r))

    def straight(r: Column, p: Column, i: Column) -> Column:
        before, after = neighbour(r, i, -1), neighbour(r, i, 1)
        cross = (p["x"] - before["x"]) * (after["y"] - p["y"]) - (p["y"] - before["y"]) * (after["x"] - p["x"])
        return (F.abs(cross) <= epsilon) & (segment_distance(p, before, after) <= epsilon)

    def bends(r: Column) -> Column:
        return F.filter(r, lambda p, i: ~straight(r, p, i))

    return bound(opened, lambda r: bound(bends(r), lambda b: F.when((F.size(r) < 3) | (F.size(b) < 3), r).otherwise(b)))


def segments_cross(a: Column, b: Column, c: Column, d: Column, epsilon: float = 1e-6) -> Column:
    """Whether two segments share a point: they cross, or an end of one lies on the other."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def opposite(s: Column, t: Column) -> Column:
        return ((s > epsilon) & (t < -epsilon)) | ((s < -epsilon) & (t > epsilon))

    touch = [segment_distance(c, a, b), segment_distance(d, a, b), segment_distance(a, c, d), segment_distance(b, c, d)]
    proper = opposite(side(a, b, c), side(a, b, d)) & opposite(side(c, d, a), side(c, d, b))
    return proper | (F.least(*touch) <= epsilon)


def self_intersects(points: Column) -> Column:
    """Whether two edges of a ring that have no vertex in common share a point."""
    edges = F.transform(_edges(points, True), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))
    n = F.size(points)

    def meets(e: Column, f: Column) -> Column:
        apart = (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
        ends = [distance(p, q) for p in (e["a"], e["b"]) for q in (f["a"], f["b"])]
        return apart & (F.least(*ends) > 1e-6) & segments_cross(e["a"], e["b"], f["a"], f["b"])

    return (n >= 4) & bound(edges, lambda es: F.exists(es, lambda e: F.exists(es, lambda f: meets(e, f))))


def geometry_center(kind: Column, line: Column, polyline: Column, at: Column, rings: Column, polygon: Column) -> Column:
    """The centre of a measurement by its kind: of its rings or polygon, its path, its point, or its line."""
    origin = point(F.lit(0.0), F.lit(0.0))
    area = F.when(F.coalesce(F.size(rings), F.lit(0)) > 0, rings_centroid(rings)).otherwise(polygon_centroid(polygon))
    found = F.when(kind == "area", area).when(kind == "polyline", polyline_centroid(polyline)).when(kind == "count", at)
    return F.coalesce(found.when(kind == "line", midpoint(line["start"], line["end"])), origin)


def display_geometry(rings: Column, polygon: Column, simple_rings: Column, simple_polygon: Column, selected: Column) -> Column:
    """struct (outline, rings, bounds) that is drawn: simplified shapes unless the measurement is selected. Rings fall
    back to the polygon, an outline of fewer than three points to the first ring; without either bounds are null."""
    own = F.when(F.size(rings) > 0, rings).when(F.size(polygon) >= 3, F.array(polygon)).otherwise(F.slice(F.array(polygon), 1, 0))
    simple = F.when(F.size(simple_rings) > 0, simple_rings).otherwise(own)
    fill = F.when(selected, own).otherwise(simple)
    outline = F.when(selected, polygon).otherwise(simple_polygon)

    def shown(f: Column) -> Column:
        o = F.when((F.size(outline) < 3) & (F.size(f) > 0), F.get(f, F.lit(0))).otherwise(outline)
        box = F.when(F.size(f) > 0, bounds(F.flatten(f))).when(F.size(o) >= 3, bounds(o))
        return F.struct(o.alias("outline"), f.alias("rings"), box.alias("bounds"))

    return bound(fill, shown)


def annotation_hit(kind: Column, p: Column, a: Column, b: Column, tolerance) -> Column:
    """Hit test of a rectangle, ellipse or segment spanned by two points."""
    x0, x1 = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    y0, y1 = F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
    box = (p["x"] >= x0 - tolerance) & (p["x"] <= x1 + tolerance) & (p["y"] >= y0 - tolerance) & (p["y"] <= y1 + tolerance)
    rx, ry = (x1 - x0) / 2 + tolerance, (y1 - y0) / 2 + tolerance
    u, v = (p["x"] - (x0 + x1) / 2) / F.nullif(rx, F.lit(0.0)), (p["y"] - (y0 + y1) / 2) / F.nullif(ry, F.lit(0.0))
    return F.when(kind == "rect", box).when(kind == "circle", F.coalesce(u * u + v * v <= 1, F.lit(False))).otherwise(segment_distance(p, a, b) <= tolerance)


def axis_locked(a: Column, b: Column) -> Column:
    """The second point moved onto the axis through the first that it is nearer to."""
    flat = F.abs(b["x"] - a["x"]) >= F.abs(b["y"] - a["y"])
    return F.when(flat, point(b["x"], a["y"])).otherwise(point(a["x"], b["y"]))


def inside_image(p: Column, width: Column, height: Column) -> Column:
    """The point clamped to an image."""
    return point(clamp(p["x"], F.lit(0.0), width.cast("double")), clamp(p["y"], F.lit(0.0), height.cast("double")))
