import math
import random

import numpy as np

from gaugeworks.operators.masks import _shape_runs


def plain(p):
    found, n = set(), len(p)
    edges = [(p[i], p[(i + 1) % n]) for i in range(n)]
    for y in range(-6, 52):
        cuts = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges if a[1] != b[1] and min(a[1], b[1]) <= y < max(a[1], b[1]))
        for u, v in zip(cuts[::2], cuts[1::2]):
            found |= {(x, y) for x in range(math.ceil(u), math.floor(v) + 1)}
    for edge in edges:
        (xa, ya), (xb, yb) = sorted(edge)
        dx, dy = xb - xa, yb - ya
        size, up = max(dx, abs(dy)), (dy > 0) - (dy < 0)
        for k in range(size + 1):
            near = lambda d: 0 if size == 0 else math.ceil((2 * k * d - size) / (2 * size))  # noqa: B023, E731
            found.add((xa + k, ya + up * near(abs(dy))) if dx >= abs(dy) else (xa + near(dx), ya + up * k))
    return found


def test_shapes_by_bands_against_single_pixels():
    random.seed(3)
    for band in [4, 16, 64] * 20:
        shapes = [[[(random.randint(-5, 40), random.randint(-5, 50)) for _ in range(random.randint(3, 7))] for _ in range(random.randint(1, 3))] for _ in range(3)]
        rows, wanted = [], set()
        for k, (outer, *inner) in enumerate(shapes):
            wanted |= {(k, x, y) for x, y in plain(outer).difference(*map(plain, inner))}
            for r, p in enumerate(shapes[k]):
                for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
                    rows += [(k * 1000 + b + 100, r, ax, ay, bx, by, b * band, b * band + band - 1) for b in range(min(ay, by) // band, max(ay, by) // band + 1)]
        found = [(k // 1000, x, y) for k, y, x0, x1 in zip(*map(np.ndarray.tolist, _shape_runs(*map(np.array, zip(*rows))))) for x in range(x0, x1 + 1)]
        assert len(found) == len(set(found)) and set(found) == wanted
