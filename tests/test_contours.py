"""Traced rings against a plain walk, and simplified ones against a plain recursion."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import contours as C
from gaugeworks.operators import masks as K

from test_masks import back, images, parts, runs


def plain_loops(pixels):
    """Closed lines around a set of pixels as lists of pixels: a walk from edge to edge, left turns first."""
    step = {0: (1, 0), 1: (0, 1), 2: (-1, 0), 3: (0, -1)}
    edges = {}
    for x, y in pixels:
        for turn, (sx, sy), off in ((0, (x, y), (0, -1)), (1, (x + 1, y), (1, 0)), (2, (x + 1, y + 1), (0, 1)), (3, (x, y + 1), (-1, 0))):
            if (x + off[0], y + off[1]) not in pixels:
                edges[sy, sx, turn] = (x, y)
    out, seen = {}, set()
    for start in sorted(edges):
        if start in seen:
            continue
        walked, e = [], start
        while e not in seen:
            seen.add(e)
            walked.append(e)
            ey, ex = e[0] + step[e[2]][1], e[1] + step[e[2]][0]
            e = next((ey, ex, (e[2] + t) % 4) for t in (3, 0, 1) if (ey, ex, (e[2] + t) % 4) in edges)
        line = [edges[w] for w in walked]
        points = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
        out[start] = points[:-1] if len(points) > 1 and points[-1] == points[0] else points, len(walked)
    return out


def test_loops(spark):
    a = images(5, n=4, width=14, height=12, share=0.55)
    a[9] = {(3, 3)}
    a[10] = {(x, y) for x in range(40) for y in range(3)}
    expected = {(i, *s): v for i, p in a.items() for s, v in plain_loops(p).items()}
    found = C.contours(runs(spark, a)).collect()
    assert {(r.id, *r.loop): ([(p.x, p.y) for p in r.points], r.n_edges) for r in found} == expected
    for r in found:  # as many outer lines as parts, and one for each hole
        assert r.n_edges >= 4
    for i, p in a.items():
        assert sum(not r.hole for r in found if r.id == i) == len(set(parts(p).values()))
    holes = K.holes(runs(spark, a)).select("id", "part_y", "part_x").distinct().groupBy("id").count().collect()
    assert {r.id: r["count"] for r in holes} == {i: n for i in a if (n := sum(r.hole for r in found if r.id == i))}


@pytest.mark.parametrize("band", [1, 2, 5])
def test_lines_over_bands(spark, band):
    a = images(6, n=3, width=14, height=12, share=0.6)
    a[8] = {(x, y - 7) for x in range(9) for y in range(12)} - {(x, y - 7) for x in range(2, 7) for y in range(3, 9)}
    expected = {(i, *s): v for i, p in a.items() for s, v in plain_loops(p).items()}
    found = C.contours(runs(spark, a), band=band).collect()
    assert {(r.id, *r.loop): ([(p.x, p.y) for p in r.points], r.n_edges) for r in found} == expected
    assert sorted(r.hole for r in found if r.id == 8) == [False, True]


def test_a_line_within_a_band_is_one_row(spark):
    a = {i: {(x, y) for x in range(30) for y in range(20)} for i in range(3)}
    assert sorted(C.pieces(runs(spark, a)).select("id", "closed", "n").collect()) == [(i, True, 100) for i in range(3)]


def test_rings_give_the_mask_back(spark):
    rng = random.Random(3)
    a = {}
    for i in range(12):
        n = rng.randint(3, 8)
        at = [(20 + rng.uniform(6, 18) * math.cos(2 * math.pi * k / n), 20 + rng.uniform(6, 18) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        a[i] = at
    point = "struct<x: double, y: double>"
    filled = K.filled(K.ring_runs(spark.createDataFrame(a.items(), f"id long, points array<{point}>")))
    rings = C.mask_rings(filled)
    assert back(K.shape_runs(rings)) == back(filled)
    frame = {0: {(x, y) for x in range(9) for y in range(9)} - {(x, y) for x in range(3, 6) for y in range(3, 6)} - {(7, 7)} | {(20, 20), (21, 20), (20, 21)}, 1: {(0, 0), (5, 5)}}
    (r,) = C.mask_rings(runs(spark, frame)).collect()
    rings = [[(p.x, p.y) for p in ring] for ring in r.rings]
    assert rings[0] == [(0, 0), (8, 0), (8, 8), (0, 8)]
    assert sorted(rings[1]) == sorted([(3, 2), (5, 2), (6, 3), (6, 5), (5, 6), (3, 6), (2, 5), (2, 3)])
    assert [len(x) for x in rings[2:]] == [4]
    signed = [sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(x, x[1:] + x[:1])) for x in rings]
    assert signed[0] > 0 and all(s < 0 for s in signed[1:])


def plain_simplified(points, epsilon):
    """The same cuts, one stretch after the other."""
    n = len(points)
    far = lambda s: max(range(n), key=lambda j: (math.dist(points[s], points[(s + j) % n]), -j))
    one = far(0)
    one = (one + far(one)) % n
    m = far(one)
    ring = [points[(one + j) % n] for j in range(n + 1)]
    if math.dist(ring[0], ring[m]) <= epsilon:
        return points

    def cut(a, b):
        (ax, ay), (bx, by) = ring[a], ring[b]
        off = {i: abs((ring[i][1] - ay) * (bx - ax) - (ring[i][0] - ax) * (by - ay)) for i in range(a + 1, b)}
        if off and max(off.values()) ** 2 > epsilon**2 * math.dist(ring[a], ring[b]) ** 2:
            i = max(off, key=lambda i: (off[i], -i))
            return cut(a, i) + cut(i, b)
        return [a]

    kept = [ring[i] for i in cut(0, m) + cut(m, n)]
    return kept if len(kept) >= 3 else points


def test_simplified_rings(spark):
    rng = random.Random(11)
    rings = {}
    for i in range(40):
        n = rng.randint(3, 200)
        rings[i] = [(50 + 40 * math.cos(2 * math.pi * k / n) + rng.uniform(0, 3), 50 + 30 * math.sin(2 * math.pi * k / n) + rng.uniform(0, 3)) for k in range(n)]
    rings[40] = [(0.0, 0.0), (0.3, 0.0), (0.1, 0.2)]
    schema = "id long, points array<struct<x: double, y: double>>"
    frame = spark.createDataFrame([*rings.items(), (41, None), (42, []), (43, [(1.0, 1.0)])], schema)
    found = {r.id: r.points and [(p.x, p.y) for p in r.points] for r in C.simplified(frame, ["id"], F.lit(2.5)).collect()}
    assert found.pop(41) is None and found.pop(42) == [] and found.pop(43) == [(1.0, 1.0)]
    for i, points in rings.items():
        assert found[i] == plain_simplified(points, 2.5)
    assert sum(map(len, found.values())) < sum(map(len, rings.values())) / 3
    e = frame.where("id = 40").select(C.display_epsilon(F.col("points")).alias("a"), C.outline_epsilon(F.col("points")).alias("b")).first()
    assert (e.a, e.b) == (1.0, 0.35)


def test_long_rings_are_cut_in_time(spark):
    """The far points of a ring are worked out once, not for every vertex of every vertex."""
    n = 4000
    ring = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((100 * F.cos(k * (2 * math.pi / n))).alias("x"), (80 * F.sin(k * (2 * math.pi / n)) + k % 3 * 0.01).alias("y")))
    start = time.monotonic()
    found = C.simplified(spark.range(1).select("id", ring.alias("points")), ["id"], F.lit(1.0)).first()
    assert 8 <= len(found.points) < 80
    assert time.monotonic() - start < 60
