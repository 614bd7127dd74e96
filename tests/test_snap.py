"""Snapped lines against numpy, step by step."""

import math
import random

import numpy as np
import pytest

from gaugeworks.operators import snap as S


def plain(image, ax, ay, bx, by):
    """One line: (status, from, to, confidence)."""
    length = math.hypot(bx - ax, by - ay)
    if length < 3:
        return S.TOO_SHORT, None, None, 0.0
    n = max(7, math.ceil(length / 0.5) + 1)
    t = np.linspace(0, length, n)
    ux, uy = (bx - ax) / length, (by - ay) / length
    off = np.arange(-2, 3)[:, None]
    h, w = image.shape
    xs, ys = np.clip(ax + t * ux - off * uy, 0, w - 1), np.clip(ay + t * uy + off * ux, 0, h - 1)
    x0, y0 = np.floor(xs).astype(int), np.floor(ys).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = xs - x0, ys - y0
    profile = ((image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy).mean(axis=0)
    soft = np.convolve(np.pad(profile, 2, mode="edge"), np.array([1, 4, 6, 4, 1]) / 16, mode="valid")
    g = np.gradient(soft, t)
    k, c = max(1, int(n * 0.15)), max(1, int(n * 0.3))
    inner = soft[(n - c) // 2 : (n - c) // 2 + c].mean() - np.concatenate([soft[:k], soft[-k:]]).mean()
    steep = abs(g).max()
    if steep < 3 and abs(inner) < 4:
        return S.FLAT, None, None, 0.0
    limit, s, mid = max(3, steep / 4), (-1 if inner < 0 else 1), n // 2
    guard = max(2, min(mid - 1, round(n * 0.05)))
    halves = [(range(guard, mid), s), (range(mid + 1, max(mid + 1, n - guard)), -s)]
    peaks = [[j for j in r[1:-1] if q * g[j] >= limit and q * g[j] >= q * g[j - 1] and q * g[j] >= q * g[j + 1]] for r, q in halves]
    signed = [max((j for j in r if q * g[j] >= limit), key=lambda j: (abs(g[j]), -j), default=None) for r, q in halves]
    free = [max(r, key=lambda j: (abs(g[j]), -j), default=None) for r, _ in halves]
    if all(peaks):
        pair = peaks[0][0], peaks[1][-1]
    elif None not in signed:
        pair = signed
    elif None not in free and min(abs(g[free[0]]), abs(g[free[1]])) >= limit and g[free[0]] * g[free[1]] < 0:
        pair = free
    else:
        return S.NO_PAIR, None, None, 0.0

    def place(j):
        if j <= 0 or j >= n - 1 or abs(bend := g[j - 1] - 2 * g[j] + g[j + 1]) < 1e-9:
            return t[j]
        return t[j] + max(-1, min(1, (g[j - 1] - g[j + 1]) / 2 / bend)) * (t[1] - t[0])

    a, b = map(place, pair)
    if a >= b:
        return S.NO_PAIR, None, None, 0.0
    even = max(0, 1 - abs((a + b) / 2 - length / 2) / max(length / 2, 1))
    sure = min(1, abs(g[list(pair)]).mean() / 20) * 0.45 + even * 0.25 + min(1, abs(inner) / 24) * 0.3
    sure = max(0.01, min(0.99, sure))
    return (S.SNAPPED if sure >= 0.45 else S.REVIEW), a, b, sure


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(4)
    images = {}
    for i in range(8):
        y, x = np.mgrid[0:50, 0:90]
        across = x * math.cos(i * 0.3) + y * math.sin(i * 0.3)
        middle = 45 * math.cos(i * 0.3) + 25 * math.sin(i * 0.3)
        strip = abs(across - middle) < 5 + i
        images[i] = np.where(strip, 40 + 20 * i, 210 - 18 * i) + rng.uniform(0, 2, (50, 90))
    images[8] = np.where(np.mgrid[0:50, 0:90][1] < 30, 200.0, 40.0)
    images[9] = np.full((50, 90), 120.0)
    images[10] = np.where(abs(np.mgrid[0:50, 0:90][1] - 34) < 14, 120.0, 127.0)
    return images


def test_lines_of_every_kind(spark, drawn):
    rng = random.Random(6)
    lines = []
    for n in range(150):
        i = n % 11
        a, r = rng.uniform(0, 2 * math.pi), rng.choice([1, 8.1, 20.3, 35.2, 60.4])
        cx, cy = 45 + rng.uniform(-8, 8), 25 + rng.uniform(-8, 8)
        lines.append((n, i, cx - r * math.cos(a), cy - r * math.sin(a), cx + r * math.cos(a), cy + r * math.sin(a), 90, 50))
    lines.append((150, 10, 12.0, 25.0, 60.0, 25.0, 90, 50))
    frame = spark.createDataFrame(lines, "line long, id long, ax double, ay double, bx double, by double, width int, height int")
    pixels = spark.createDataFrame([(i, x, y, float(image[y, x])) for i, image in drawn.items() for y in range(50) for x in range(90)], "id long, x int, y int, value double")
    found = {r.line: r for r in S.snapped_lines(pixels, frame).collect()}
    seen = set()
    for n, i, ax, ay, bx, by, w, h in lines:
        status, a, b, sure = plain(drawn[i], ax, ay, bx, by)
        r = found[n]
        seen.add(status)
        assert (r.status, r.confidence) == (status, pytest.approx(sure, abs=1e-9))
        if a is not None:
            length = math.hypot(bx - ax, by - ay)
            ends = [(min(max(ax + t * (bx - ax) / length, 0), w - 1), min(max(ay + t * (by - ay) / length, 0), h - 1)) for t in (a, b)]
            assert (r.ax, r.ay, r.bx, r.by) == pytest.approx((*ends[0], *ends[1]), abs=1e-7)
            assert r.diameter == pytest.approx(math.dist(*ends), abs=1e-7)
        else:
            assert r.diameter is None and r.confidence == 0
    assert seen == {S.TOO_SHORT, S.FLAT, S.NO_PAIR, S.REVIEW, S.SNAPPED}
    assert {found[n].polarity for n in found} >= {"dark_on_light", "light_on_dark"}
