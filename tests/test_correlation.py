"""Agreement of shifted images against numpy."""

import numpy as np
import pytest

from gaugeworks.operators import correlation as C


def test_every_shift(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 256, (9, 13)).astype(float), rng.integers(0, 256, (7, 11)).astype(float)
    b[2:] = 5.0
    flat = lambda image: spark.createDataFrame([(1, x, y, float(v)) for (y, x), v in np.ndenumerate(image)], "id long, x int, y int, value double")
    shifts = [(1, float(x), float(y)) for x in range(-12, 14) for y in range(-8, 10)] + [(1, 0.5, 1.5)]
    sizes = spark.createDataFrame([(1, 13, 9, 11, 7)], "id long, width_a int, height_a int, width_b int, height_b int")
    found = C.shifted_agreement(flat(a), flat(b), sizes, spark.createDataFrame(shifts, "id long, dx double, dy double"), least=2).collect()
    assert len(found) == len(shifts)
    for r in found:
        ix, iy = round(r.dx), round(r.dy)
        ax, ay, bx, by = max(0, ix), max(0, iy), max(0, -ix), max(0, -iy)
        w, h = min(13 - ax, 11 - bx), min(9 - ay, 7 - by)
        ow, oh = max(0, min(13, r.dx + 11) - max(0, r.dx)), max(0, min(9, r.dy + 7) - max(0, r.dy))
        assert r.ratio == pytest.approx(ow * oh / 77)
        if w < 2 or h < 2:
            assert r.ncc is None and r.texture is None
            continue
        u, v = a[ay : ay + h, ax : ax + w], b[by : by + h, bx : bx + w]
        assert r.texture == pytest.approx(u.std(), abs=1e-6)
        size = np.sqrt(((u - u.mean()) ** 2).sum() * ((v - v.mean()) ** 2).sum())
        assert r.ncc == pytest.approx(((u - u.mean()) * (v - v.mean())).sum() / size if size > 1e-6 else -1, abs=1e-6)
