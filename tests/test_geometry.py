import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions import geometry as G

SQUARE = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]


def frame(spark, rows):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in r],) for r in rows], f"p array<{G.POINT}>")


def test_square_ring(spark):
    p = F.col("p")
    found = frame(spark, [SQUARE]).select(G.polygon_area(p).alias("a"), G.polygon_centroid(p).alias("c"), G.bounds(p).alias("b"), G.polyline_length(p).alias("l")).first()
    assert found.a == 64 and tuple(found.c) == (4, 4) and tuple(found.b) == (0, 0, 8, 8) and found.l == 24


def test_degenerate_paths(spark):
    p = F.col("p")
    rows = frame(spark, [[], [(3, 4)], [(0, 0), (2, 2)]]).select(
        G.polygon_area(p).alias("a"), G.polyline_length(p).alias("l"), G.polygon_centroid(p).alias("c"), G.polyline_centroid(p).alias("m"),
        G.polyline_distance(G.point(F.lit(0), F.lit(0)), p).alias("d"),
    ).collect()
    assert [r.a for r in rows] == [0, 0, 0]
    assert [r.l for r in rows] == [0, 0, pytest.approx(math.sqrt(8))]
    assert [tuple(r.c) for r in rows] == [(0, 0), (3, 4), (1, 1)]
    assert [tuple(r.m) for r in rows] == [(0, 0), (3, 4), (1, 1)]
    assert [r.d for r in rows] == [math.inf, 5, 0]


def test_square_with_hole(spark):
    rings = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 1), (3, 1), (3, 3), (1, 3)], [(0, 0), (1, 1)]]
    df = spark.createDataFrame([([[{"x": float(x), "y": float(y)} for x, y in r] for r in rings],)], f"r array<array<{G.POINT}>>")
    r = F.col("r")
    found = df.select(
        G.rings_area(r).alias("a"), G.rings_hole_area(r).alias("h"), G.point_in_rings(G.point(F.lit(2), F.lit(2)), r).alias("hole"),
        G.point_in_rings(G.point(F.lit(5), F.lit(5)), r).alias("in"), G.rings_edge_distance(G.point(F.lit(5), F.lit(5)), r).alias("d"),
        F.transform(G.oriented(r), G.ring_signed_area).alias("s"),
    ).first()
    assert (found.a, found.h, found.hole, found["in"]) == (96, 4, False, True)
    assert found.d == pytest.approx(math.hypot(2, 2))
    assert found.s[0] > 0 and found.s[1] < 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=9), st.integers(-9, 9))
def test_area_does_not_change_with_start_and_place(spark, points, k):
    turned = points[k % len(points) :] + points[: k % len(points)]
    moved = [(x + 7, y - 3) for x, y in points]
    areas = [r[0] for r in frame(spark, [[(float(x), float(y)) for x, y in r] for r in (points, turned, moved)]).select(G.polygon_area(F.col("p"))).collect()]
    assert areas[1] == pytest.approx(areas[0], abs=1e-6) and areas[2] == pytest.approx(areas[0], abs=1e-6)


def test_clean_ring(spark):
    rings = [[(0, 0), (0, 0), (4, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(0, 0), (1, 1), (2, 2)], [], [(0, 0), (0, 0)]]
    found = [[tuple(p) for p in r[0]] for r in frame(spark, rings).select(G.clean_ring(F.col("p"))).collect()]
    assert found == [[(0, 0), (8, 0), (8, 8), (0, 8)], [(0, 0), (1, 1), (2, 2)], [], [(0, 0)]]


def test_self_intersection(spark):
    rings = [SQUARE, [(0, 0), (8, 8), (8, 0), (0, 8)], SQUARE[:3], [(0, 0), (8, 0), (4, 0), (4, 5)]]
    assert [r[0] for r in frame(spark, rings).select(G.self_intersects(F.col("p"))).collect()] == [False, True, False, True]
