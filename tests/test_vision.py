"""Lines, edges and shifts of drawn pictures."""

import math

import numpy as np
from pyspark.sql import functions as F

from motionspark.operators import vision

KIND = "clip_id long, frame int, w int, h int, rgba binary"


def picture(w=240, h=200):
    image = np.zeros((h, w, 4), np.uint8)
    image[..., :3], image[..., 3] = (31, 107, 57), 255
    return image


def band(image, cx, cy, angle, half, wide, colour):
    """A smooth-edged rectangle."""
    y, x = np.mgrid[: image.shape[0], : image.shape[1]]
    u, v = (x - cx) * math.cos(angle) + (y - cy) * math.sin(angle), (y - cy) * math.cos(angle) - (x - cx) * math.sin(angle)
    cover = (np.clip(half - np.abs(u) + 0.5, 0, 1) * np.clip(wide - np.abs(v) + 0.5, 0, 1))[..., None]
    image[..., :3] = np.round(image[..., :3] * (1 - cover) + np.array(colour) * cover)
    return image


def table(spark, images, kind=KIND, *more):
    return spark.createDataFrame([(1, i, im.shape[1], im.shape[0], bytearray(im.tobytes()), *more) for i, im in enumerate(images)], kind)


def test_robust_line():
    draw = np.random.default_rng(3)
    x = draw.uniform(0, 100, 200)
    y = 5 + x * math.tan(0.2) + draw.normal(0, 0.1, 200)
    y[x > 85] += 20
    assert abs(vision.huber_line(x, y)[0] - 0.2) < 0.01 < abs(0.5 * np.arctan2(2 * np.cov(x, y)[0, 1], np.var(x) - np.var(y)) - 0.2)


def test_lines_ignore_marks_beside_them(spark):
    image = band(picture(), 120, 100, 1.3, 90, 3, (230, 220, 40))
    for k in range(6):  # a dotted rule of the same colour
        band(image, 60, 30 + 25 * k, 0.3, 4, 2, (230, 220, 40))
    found = vision.find_lines(table(spark, [image, picture()])).collect()
    assert len(found) == 1 and found[0].frame == 0 and abs(found[0].rad - 1.3) < 0.003


def test_face_between_pixels(spark):
    for angle in (-0.06, 0.0, 0.035):
        image = band(picture(), 120, 100, angle, 40, 18, (235, 235, 235))
        heads = table(spark, [image], f"{KIND}, hx double, hy double, ux double, uy double, want double", 120.0, 100.0, 0.0, 1.0, 78.0)
        r = vision.face_lines(heads).first()
        assert abs(r.frad - angle) < 0.004 and r.rms < 0.3 and abs(r.fy - 118 - (r.fx - 120) * math.tan(angle)) < 0.5
    blank = table(spark, [picture()], f"{KIND}, hx double, hy double, ux double, uy double, want double", 120.0, 100.0, 0.0, 1.0, 78.0)
    assert vision.face_lines(blank).count() == 0


def test_camera_shift_holds_its_last(spark):
    draw = np.random.default_rng(1)
    base = np.kron(draw.integers(40, 200, (50, 60, 3)), np.ones((4, 4, 1))).astype(np.uint8)
    image = np.dstack([base, np.full(base.shape[:2], 255, np.uint8)])
    moved = np.roll(image, (3, -5), axis=(0, 1)).copy()
    moved[80:110, 100:140, :3] = 250  # something that moves by itself
    blank = np.full_like(image, 90)
    rows = vision.camera_shift(table(spark, [image, moved, blank])).orderBy("frame").collect()
    assert [(round(r.sx), round(r.sy)) for r in rows] == [(0, 0), (-5, 3), (-5, 3)]


def test_short_tracks_stay(spark):
    rows = [("a", i, float(i * (50 if i == 2 else 1)), 0.0) for i in range(4)] + [("b", i, 500.0 if i == 6 else float(i), 0.0) for i in range(12)]
    kept = vision.smooth_track(spark.createDataFrame(rows, "k string, i int, x double, y double"), ["k"], "i", "x", "y")
    assert sorted(r.i for r in kept.where(F.col("k") == "a").collect()) == [0, 1, 2, 3]
    assert sorted(r.i for r in kept.where(F.col("k") == "b").collect()) == [i for i in range(12) if i != 6]


def test_line_takes_hues_of_few_pixels(monkeypatch):
    """Hues are taken of what is colourful and yellowish alone, not of the picture."""
    seen, real = [], vision.pixels.hsv
    monkeypatch.setattr(vision.pixels, "hsv", lambda rgba: seen.append(rgba[..., 0].size) or real(rgba))
    image = picture()
    image[..., :3] = (90, 90, 95)
    band(image, 120, 100, 1.3, 90, 3, (230, 220, 40))
    assert abs(vision.mat_line(image)[0] - 1.3) < 0.003 and sum(seen) < image[..., 0].size / 10
    for n in (1, 2, 7, 8):
        assert vision._median(np.arange(n, 0.0, -1)) == np.median(np.arange(n, 0.0, -1))
