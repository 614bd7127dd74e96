"""Masks as runs against pixel sets."""

import random
from collections import deque

import pytest

from gaugeworks.operators import masks as K

SCHEMA = "id long, x long, y long"


def images(seed, n=6, width=23, height=150, share=0.4):
    rng = random.Random(seed)
    return {i: {(x, y) for x in range(width) for y in range(-3, height) if rng.random() < share} for i in range(n)}


def runs(spark, pixels):
    return K.runs_of(spark.createDataFrame([(i, x, y) for i, ps in pixels.items() for x, y in ps], SCHEMA))


def back(frame):
    out = {}
    for r in frame.collect():
        line = {(x, r.y) for x in range(r.x0, r.x1 + 1)}
        assert not line & out.setdefault(r.id, set())
        out[r.id] |= line
    return out


def parts(pixels, corners=True):
    """Each pixel's first pixel of its part, by line."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    name = {}
    for start in sorted(pixels, key=lambda p: (p[1], p[0])):
        if start in name:
            continue
        name[start], queue = start, deque([start])
        while queue:
            x, y = queue.popleft()
            for a, b in steps:
                p = (x + a, y + b)
                if p in pixels and p not in name:
                    name[p] = start
                    queue.append(p)
    return name


def plain_fill(pixels):
    x0, x1 = min(x for x, _ in pixels) - 1, max(x for x, _ in pixels) + 1
    y0, y1 = min(y for _, y in pixels) - 1, max(y for _, y in pixels) + 1
    frame = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - pixels
    named = parts(frame, corners=False)
    return pixels | {p for p, n in named.items() if n != (x0, y0)}


def test_algebra(spark):
    a, b = images(1), images(2)
    del b[3]
    left, right = runs(spark, a), runs(spark, b)
    assert back(left) == a
    assert back(K.union(left, right)) == {i: a[i] | b.get(i, set()) for i in a}
    assert back(K.intersection(left, right)) == {i: a[i] & b[i] for i in b}
    assert back(K.difference(left, right)) == {i: a[i] - b.get(i, set()) for i in a}
    assert K.difference(left, left).count() == 0
    for r in K.measures(left).collect():
        xs, ys = zip(*a[r.id])
        assert r[1:6] == (len(xs), min(xs), min(ys), max(xs) + 1, max(ys) + 1)
        assert r.center_x == pytest.approx(sum(xs) / len(xs)) and r.center_y == pytest.approx(sum(ys) / len(ys))


@pytest.mark.parametrize("band", [1, 7, 64])
@pytest.mark.parametrize("corners", [True, False])
def test_components(spark, band, corners):
    a = images(3, share=0.45 if corners else 0.6)
    found = K.components(runs(spark, a), corners=corners, band=band).collect()
    named = {i: parts(p, corners) for i, p in a.items()}
    for r in found:
        assert named[r.id][r.x0, r.y] == (r.part_x, r.part_y)
    assert sum(r.x1 - r.x0 + 1 for r in found) == sum(map(len, a.values()))


def test_components_of_a_spiral_and_an_image_over_many_tasks(spark):
    """A snake through all bands of one large image, and combs that join at their far end."""
    from pyspark.sql import functions as F

    lines = spark.range(3000).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("y"))
    whole = lines.where("y % 2 = 0").select("id", "y", F.lit(0).cast("long").alias("x0"), F.lit(9999).cast("long").alias("x1"))
    turns = lines.where("y % 2 = 1").select("id", "y", F.when(F.col("y") % 4 == 1, 9999).otherwise(0).cast("long").alias("x0"))
    snake = whole.unionByName(turns.withColumn("x1", F.col("x0")))
    combs = lines.where("y < 2990").select("id", (F.col("y") + 10_000).alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(190), F.lit(2))).alias("x0"))
    combs = combs.withColumn("x1", F.col("x0")).unionByName(spark.createDataFrame([(1, 12_990, 0, 100)], "id long, y long, x0 long, x1 long"))
    found = K.components(snake.unionByName(combs)).groupBy("part_y", "part_x").count().collect()
    sizes = {(r.part_y, r.part_x): r["count"] for r in found}
    assert sizes.pop((0, 0)) == 3000
    assert sizes.pop((10_000, 0)) == 51 * 2990 + 1
    assert sizes == {(10_000, x): 2990 for x in range(102, 191, 2)}


def test_largest_filled_and_holes(spark):
    a = images(4, share=0.5)
    a[7] = {(x, y) for x in range(9) for y in range(9)} - {(4, 4), (2, 2), (2, 3)} | {(20, 0)}
    left = runs(spark, a)
    assert back(K.filled(left)) == {i: plain_fill(p) for i, p in a.items()}
    named = {i: parts(p) for i, p in a.items()}
    largest = {}
    for i, n in named.items():
        sizes = {}
        for start in n.values():
            sizes[start] = sizes.get(start, 0) + 1
        best = min(sizes, key=lambda s: (-sizes[s], s[1], s[0]))
        largest[i] = {p for p, s in n.items() if s == best}
    found = K.largest_part(left)
    assert back(found) == largest
    assert all(r.discarded for r in found.collect())
    assert {(r.part_x, r.part_y) for r in K.holes(left.where("id = 7")).collect()} == {(4, 4), (2, 2)}


def test_prompts(spark):
    a = {1: {(0, 0), (1, 0), (5, 0), (6, 0), (6, 1), (9, 9)}, 2: {(0, 0), (4, 4)}, 3: {(0, 0), (4, 4), (5, 4)}}
    prompts = [(1, 9.5, 8.6, True), (1, 6.4, 0.2, True), (1, 5.0, 0.0, False), (1, 6.0, 1.0, True), (2, 1.0, 1.0, True), (2, 0.0, 0.0, False)]
    sizes = spark.createDataFrame([(i, 10, 10) for i in a], "id long, width int, height int")
    found = K.prompted_part(runs(spark, a), spark.createDataFrame(prompts, "id long, x double, y double, positive boolean"), sizes)
    assert {r.id: (r.part_x, r.part_y, r.parts, r.positive_hits, r.negative_hits) for r in found.collect()} == {1: (5, 0, 3, 2, 1), 2: (4, 4, 2, 0, 0), 3: (4, 4, 2, 0, 0)}


def test_taking_an_area_off(spark):
    square = {(x, y) for x in range(6) for y in range(6)}
    a = dict.fromkeys(range(1, 6), square)
    cut = {1: {(0, 0)}, 2: {(20, 20)}, 3: square | {(9, 9)}, 4: {(3, y) for y in range(6)}}
    outcomes, left = K.subtract_edit(runs(spark, a), runs(spark, cut))
    assert {r.id: (r.outcome, r.area) for r in outcomes.collect()} == {1: (K.SUBTRACTED, 35), 2: (K.APART, 36), 3: (K.EMPTY, 36), 4: (K.SPLIT, 36), 5: (K.NO_SHAPE, 36)}
    assert back(left) == {**a, 1: square - {(0, 0)}}
    statistics, left = K.final_mask(runs(spark, a), runs(spark, cut))
    assert {r.id: tuple(r)[1:] for r in statistics.collect()} == {
        1: (True, False, False, 35), 2: (False, False, False, 36), 3: (True, True, False, 0), 4: (True, False, True, 18), 5: (False, False, False, 36),
    }
    assert back(left) == {1: square - {(0, 0)}, 2: square, 4: {(x, y) for x in range(3) for y in range(6)}, 5: square}


def plain_ring(points):
    """Pixels inside by the even-odd rule, and those of the outline."""
    v = [(round(x), round(y)) for x, y in points]
    edges = list(zip(v, v[1:] + v[:1]))
    out = set()
    for (ax, ay), (bx, by) in edges:
        if (bx, by) < (ax, ay):
            ax, ay, bx, by = bx, by, ax, ay
        dx, dy = bx - ax, by - ay
        long, sign = max(dx, abs(dy)), (dy > 0) - (dy < 0)
        for k in range(long + 1):
            near = lambda d: -(-(2 * k * d - long) // (2 * long)) if long else 0
            out.add((ax + k, ay + sign * near(abs(dy))) if dx >= abs(dy) else (ax + near(dx), ay + sign * k))
    for y in range(min(y for _, y in v), max(y for _, y in v)):
        cuts = sorted((y - ay) * (bx - ax) / (by - ay) + ax for (ax, ay), (bx, by) in edges if min(ay, by) <= y < max(ay, by))
        for a, b in zip(cuts[::2], cuts[1::2]):
            out |= {(x, y) for x in range(-60, 120) if a <= x <= b}
    return out


def test_rings_and_shapes(spark):
    rng = random.Random(8)
    rings = {i: [(rng.uniform(-9, 40), rng.uniform(-9, 40)) for _ in range(rng.randint(3, 9))] for i in range(60)}
    rings[60] = [(0.5, 1.5), (2.5, 2.5), (7.5, -0.5)]
    rings[61] = [(1.0, 1.0)] * 3
    point = "struct<x: double, y: double>"
    frame = spark.createDataFrame([*rings.items(), (62, [(0.0, 0.0), (3.0, 3.0)])], f"id long, points array<{point}>")
    assert back(K.ring_runs(frame)) == {i: plain_ring(p) for i, p in rings.items()}
    shapes = [(i, [rings[3 * i], rings[3 * i + 1], rings[3 * i + 2]]) for i in range(20)]
    expected = {i: plain_ring(a) - plain_ring(b) - plain_ring(c) for i, (a, b, c) in shapes}
    frame = spark.createDataFrame(shapes, f"id long, rings array<array<{point}>>")
    found = K.shape_runs(frame)
    assert back(found) == {i: p for i, p in expected.items() if p}
    overlaps = {(r.a, r.b): (r.common, r.iou) for r in K.run_overlaps(found, found, cell=8).collect()}
    expected = {(i, j): (len(p & q), pytest.approx(len(p & q) / len(p | q))) for i, p in expected.items() for j, q in expected.items() if p & q}
    assert overlaps == expected


def test_dilation_erosion_and_distances(spark):
    a = images(9, n=3, width=18, height=20, share=0.7)
    a = {i: {p for p in ps if p[1] >= 0} for i, ps in a.items()}
    sizes = spark.createDataFrame([(i, 18, 20) for i in a], "id long, width int, height int")
    square = lambda x, y, a, b: {(u, v) for u in range(x - a, x + a + 1) for v in range(y - b, y + b + 1) if 0 <= u < 18 and 0 <= v < 20}
    grow = lambda ps, a, b: set().union(*(square(x, y, a, b) for x, y in ps)) if ps else set()
    shrink = lambda ps, a, b: {(x, y) for x, y in ps if square(x, y, a, b) <= ps}
    left = runs(spark, a)
    some = lambda d: {i: p for i, p in d.items() if p}
    assert back(K.dilated(left, sizes, 2, 1)) == {i: grow(p, 2, 1) for i, p in a.items()}
    assert back(K.eroded(left, sizes, 1, 0)) == some({i: shrink(p, 1, 0) for i, p in a.items()})
    assert back(K.eroded(left, sizes, 1, 1)) == some({i: shrink(p, 1, 1) for i, p in a.items()})
    close = {i: shrink(grow(p, 1, 1), 1, 1) for i, p in a.items()}
    assert back(K.closed(left, sizes, 1)) == close
    assert back(K.opened(K.closed(left, sizes, 1), sizes, 1)) == some({i: grow(shrink(p, 1, 1), 1, 1) for i, p in close.items()})
    a = images(10, n=3, width=18, height=20, share=0.9)
    a[3] = {(x, y) for x in range(15) for y in range(11)}
    far = {}
    for i, ps in a.items():
        x0, x1, y0, y1 = min(x for x, _ in ps) - 1, max(x for x, _ in ps) + 1, min(y for _, y in ps) - 1, max(y for _, y in ps) + 1
        free = [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if (x, y) not in ps]
        far |= {(i, x, y): min((x - u) ** 2 + (y - v) ** 2 for u, v in free) for x, y in ps}
    assert {(r.id, r.x, r.y): r.square for r in K.distances(runs(spark, a)).collect()} == far


def test_tidy_masks(spark):
    """A large square with a hole and a slit, and a speck beside it."""
    square = {(x, y) for x in range(5, 25) for y in range(5, 20)}
    a = {1: square - {(10, 10), (11, 10)} - {(x, 14) for x in range(5, 12)} | {(27, 2)}}
    sizes = spark.createDataFrame([(1, 30, 25)], "id long, width int, height int")
    assert back(K.tidy(runs(spark, a), sizes)) == {1: square}
