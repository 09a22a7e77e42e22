"""Masks, outlines, hulls and circles against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd

from motionspark.operators import pixels, shapes


def element(size):
    r = size // 2
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= (round(r * math.sqrt(max(0, 1 - (dy / r) ** 2))) if r else 0)]


def test_round_elements():
    draw = np.random.default_rng(1)
    for size in (1, 3, 5, 7, 9):
        for _ in range(20):
            m = draw.random((draw.integers(1, 20), draw.integers(1, 20))) < draw.random()
            h, w = m.shape
            grown = np.array([[any(0 <= x + a < w and 0 <= y + b < h and m[y + b, x + a] for a, b in element(size)) for x in range(w)] for y in range(h)])
            shrunk = np.array([[all(not (0 <= x + a < w and 0 <= y + b < h) or m[y + b, x + a] for a, b in element(size)) for x in range(w)] for y in range(h)])
            assert (shapes.dilated(m, size) == grown).all() and (shapes.eroded(m, size) == shrunk).all()


def test_borders_hold_their_blobs():
    """Every blob's outer border: its own pixels next to the outside, each step to a neighbour, back to where it began."""
    draw = np.random.default_rng(2)
    for _ in range(60):
        m = draw.random((draw.integers(1, 16), draw.integers(1, 16))) < draw.random()
        ids = pixels.labels(m, corners=True)
        seen = dict(shapes.outlines(m))
        assert set(seen) == set(range(1, ids.max() + 1))
        outside = pixels.labels(~np.pad(m, 1))
        outer = (outside == outside[0, 0])[1:-1, 1:-1]
        wide = np.pad(outer, 1, constant_values=True)
        for label, points in seen.items():
            assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(points, points[1:] + points[:1])) or len(points) == 1
            at = {(x, y) for x, y in points}
            assert all(ids[y, x] == label for x, y in at)
            holes_closed = pixels.labels(ids != label) if (ids != label).any() else ids
            rim = {(x, y) for y, x in zip(*np.nonzero(ids == label)) if wide[y : y + 3 : 2, x + 1].any() or wide[y + 1, x : x + 3 : 2].any()}
            assert rim <= at or holes_closed.max() > 1  # blobs within holes of others have no pixel next to the outer ground


def test_measures_and_rounds(spark):
    mask = np.zeros((60, 80), bool)
    mask[10:31, 5:46] = True  # 21 x 41 pixels: 20 x 40 between their middles
    y, x = np.mgrid[:60, :80]
    mask |= np.hypot(x - 62, y - 40) <= 12
    ring = np.zeros_like(mask)
    ring |= np.abs(np.hypot(x - 30, y - 30) - 15) <= 2
    rows = [(k, label, i, px, py) for k, m in enumerate((mask, ring)) for label, points in shapes.outlines(m) for i, (px, py) in enumerate(points)]
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "blob", "at", "x", "y"]).astype("int32"))
    found = {(r.k, r.blob): r for r in shapes.measures(points, ["k", "blob"]).join(shapes.rounds(points, "k int, blob int"), ["k", "blob"]).collect()}
    box, disc, hoop = found[0, 1], found[0, 2], found[1, 1]
    assert (box.area, box.length, box.hull_area) == (800, 120, 800) and abs(box.radius - math.hypot(20, 10)) < 1e-9
    assert (box.minx, box.maxx, box.miny, box.maxy) == (5, 45, 10, 30)
    assert abs(disc.cx - 62) < 1e-9 and abs(disc.cy - 40) < 1e-9 and abs(disc.radius - 12) < 0.2 and 4 * math.pi * disc.area / disc.length**2 > 0.85
    assert abs(hoop.area / (math.pi * 16.6**2) - 1) < 0.05  # the outer border alone


def test_hulls_and_least_circles():
    draw = np.random.default_rng(3)
    for _ in range(150):
        p = draw.integers(0, draw.choice((3, 9, 50)), (draw.integers(1, 14), 2))
        corners = shapes.hull(p[:, 0], p[:, 1])
        x, y, r = shapes.least_circle(corners)
        assert (np.hypot(p[:, 0] - x, p[:, 1] - y) <= r + 1e-6).all()
        best = math.inf
        for some in itertools.chain(itertools.combinations(p, 1), itertools.combinations(p, 2), itertools.combinations(p, 3)):
            c = shapes._through(np.array(some, float))
            if c and (np.hypot(p[:, 0] - c[0], p[:, 1] - c[1]) <= c[2] + 1e-6).all():
                best = min(best, c[2])
        assert abs(r - best) < 1e-6
        if len(corners) > 2:  # all points lie on one side of each edge
            for a, b in zip(corners, np.roll(corners, -1, axis=0)):
                side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
                assert (side >= -1e-9).all()


def test_labels_against_filling():
    draw = np.random.default_rng(4)
    for _ in range(100):
        m = draw.random((draw.integers(1, 14), draw.integers(1, 14))) < draw.random()
        for corners in (False, True):
            ids, want, k = pixels.labels(m, corners), np.zeros(m.shape, int), 0
            for y, x in zip(*np.nonzero(m)):
                if not want[y, x]:
                    k += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not want[a, b]:
                            want[a, b] = k
                            todo += [(a + dy, b + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (corners or not (dy and dx))]
            assert (ids == want).all()


def test_a_noisy_picture_of_full_size():
    import time

    draw = np.random.default_rng(5)
    mask = np.zeros((1080, 1920), bool)
    mask[draw.integers(0, 1080, 21_000), draw.integers(0, 1920, 21_000)] = True
    start = time.process_time()
    found = pixels.moments(mask, mask.astype(float), corners=True)
    assert len(found) > 19_000 and time.process_time() - start < 1


def test_oblique_lines_are_one_blob_over_corners():
    mask = np.zeros((500, 120), bool)
    mask[np.arange(500), np.arange(500) // 5] = True
    assert len(pixels.moments(mask, mask, corners=True)) == 1 < len(pixels.moments(mask, mask))


def test_rows_of_a_key_are_put_together_across_batches():
    import pandas as pd

    from motionspark.operators import pixels

    batches = [pd.DataFrame({"k": [1, 1, 2], "v": [1, 2, 3]}), pd.DataFrame({"k": [2, 2], "v": [4, 5]}), pd.DataFrame({"k": [2, None, None], "v": [6, 7, 8]})]
    assert [list(g["v"]) for g in pixels.grouped(iter(batches), ["k"])] == [[1, 2], [3, 4, 5, 6], [7, 8]]


def test_a_picture_is_painted_only_where_its_things_reach():
    import numpy as np

    from motionspark.plans import sights

    box = sights._box(120, 90, 10, 5)
    whole = (slice(0, sights.H), slice(0, sights.W))
    assert (box[0].stop - box[0].start) * (box[1].stop - box[1].start) < 400
    u, v = sights._x - 120, sights._y - 90
    cover = np.clip(10 - np.abs(u) + 0.5, 0, 1) * np.clip(5 - np.abs(v) + 0.5, 0, 1)
    assert np.array_equal(sights.bar(sights._mat(), 120, 90, 0, 10, 5, sights.DARK), sights._paint(sights._mat(), whole, cover, sights.DARK))
