"""Balls at rest and heads in drawn clips."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_vision import band, picture

from motionspark.operators import heads, pixels, shapes, vision

KIND = "clip_id long, frame int, w int, h int, rgba binary"


def disc(image, cx, cy, r, colour, inner=0.0):
    y, x = np.mgrid[: image.shape[0], : image.shape[1]]
    off = np.hypot(x - cx, y - cy)
    cover = (np.clip(r - off + 0.5, 0, 1) * np.clip(off - inner + 0.5, 0, 1) if inner else np.clip(r - off + 0.5, 0, 1))[..., None]
    image[..., :3] = np.round(image[..., :3] * (1 - cover) + np.array(colour) * cover)
    return image


def clips(spark, clips):
    return spark.createDataFrame([(k, i, im.shape[1], im.shape[0], bytearray(im.tobytes())) for k, images in clips.items() for i, im in enumerate(images)], KIND)


def test_a_still_ball_among_a_ring_a_smear_and_what_moves(spark):
    """The ball and the ring are candidates, as only motion tells them apart; the smear, a half disc and what moves are not."""

    def mat(i):
        image = disc(picture(480, 300), 120.3, 80.6, 11, (240, 240, 240))
        disc(image, 330, 100, 17, (235, 235, 235), inner=14)
        band(image, 240, 230, 0.3, 60, 7, (240, 240, 240))
        band(image, 60, 200, 0.0, 8, 16, (20, 20, 20))
        return band(image, 100 + 14 * i, 180, 0.4, 30, 12, (250, 250, 250))

    rows = heads.balls_at_rest(clips(spark, {1: [mat(i) for i in range(20)], 2: [picture(480, 300)] * 3})).collect()
    assert {r.clip_id for r in rows} == {1} and len(rows) == 2
    at = sorted((round(r.x), round(r.y), r.d) for r in rows)
    assert [a[:2] for a in at] == [(120, 81), (330, 100)] and 18 < at[0][2] < 23 and 30 < at[1][2] < 35  # a high level cuts into the blurred rim
    ball = min(rows, key=lambda r: r.x)
    assert math.hypot(ball.x - 120.3, ball.y - 80.6) < 0.7


def test_dim_balls_and_several_levels(spark):
    """A ball too dim for the first levels is found lower down; candidates of lower levels within a kept one's radius are it again."""
    image = disc(picture(480, 300), 100, 100, 12, (205, 205, 205))
    disc(image, 300, 200, 12, (165, 165, 165))
    rows = heads.balls_at_rest(clips(spark, {5: [image] * 2})).orderBy("x").collect()
    assert [(round(r.x), round(r.y)) for r in rows] == [(100, 100), (300, 200)]


def mallet(i, shift=(0.0, 0.0)):
    """Two bright prongs about a dark middle, on a thin bright shaft, over a mat with a printed ring; the camera moves by ``shift``."""
    sx, sy = shift
    image = disc(picture(420, 320), 60 + sx, 250 + sy, 30, (230, 230, 230), inner=26)
    cx, cy = 150 + 6 * i + sx, 160 + sy
    band(image, cx, cy - 80, math.pi / 2, 70, 2, (240, 240, 240))
    for side in (-1, 1):
        band(image, cx + side * 28, cy, 0.0, 12, 22, (240, 240, 240))
    return image, (cx, cy)


def test_two_prongs_are_one_head_without_its_shaft(spark):
    drawn = [mallet(i, (1.4 * (i % 3), -0.9 * (i % 2))) for i in range(14)]
    rasters = clips(spark, {7: [im for im, _ in drawn]})
    still = clips(spark, {7: [disc(picture(420, 320), 60, 250, 30, (230, 230, 230), inner=26)]}).drop("frame")
    balls = spark.createDataFrame([(7, 240.0, 210.0, 30.0, heads.rules.HEAD_MM / 80)], "clip_id long, ball_x double, ball_y double, ball_d double, mm_per_px double")
    shifts = spark.createDataFrame([(7, i, 1.4 * (i % 3), -0.9 * (i % 2)) for i in range(14)], "clip_id long, frame int, sx double, sy double")
    best, outline = heads.find_heads(rasters, balls, still, shifts)
    found = {r.frame: r for r in best.collect()}
    assert sorted(found) == list(range(14))
    top = {r.frame: (r.top, r.left, r.right) for r in outline.join(best.select("clip_id", "frame", "head"), ["clip_id", "frame", "head"]).groupBy("frame").agg(F.min("y").alias("top"), F.min("x").alias("left"), F.max("x").alias("right")).collect()}
    for i, (_, (cx, cy)) in enumerate(drawn):
        assert math.hypot(found[i].x - cx, found[i].y - cy) < 3
        assert top[i][0] > cy - 28 and abs(top[i][1] - (cx - 40)) < 3 and abs(top[i][2] - (cx + 40)) < 3


def test_the_clips_own_still_serves(spark):
    """With the still taken from the clip itself, and stills that are missing."""
    images = [mallet(4 * i)[0] for i in range(9)]
    rasters = clips(spark, {1: images, 2: images[:2]})
    balls = spark.createDataFrame([(k, 240.0, 210.0, 31.0, None) for k in (1, 2)], "clip_id long, ball_x double, ball_y double, ball_d double, mm_per_px double")
    best, _ = heads.find_heads(rasters, balls, pixels.stills(rasters.where("clip_id = 1")))
    found = {(r.clip_id, r.frame): r.x for r in best.collect()}
    assert {f for k, f in found if k == 1} == set(range(9)) and all(abs(found[1, i] - (150 + 24 * i)) < 4 for i in range(9))


def test_stills_are_medians_over_tiles(spark):
    draw = np.random.default_rng(1)
    images = [draw.integers(0, 256, (70, 130, 4)).astype(np.uint8) for _ in range(5)]
    row = pixels.stills(clips(spark, {3: images}), size=32).first()
    found = np.frombuffer(row.rgba, np.uint8).reshape(row.h, row.w, 4)
    assert (found[..., :3] == np.median(np.stack(images)[..., :3], axis=0)).all() and (found[..., 3] == 255).all()


def test_step_places_lie_between_samples():
    s = np.arange(-7, 7.01, 0.5)
    for at in np.linspace(-3, 3, 25):
        for blur in (0.3, 1.0, 1.8):
            clean = 200 / (1 + np.exp((s - at) / blur * 1.7))
            place, steep = vision.step_places(clean[None])
            assert abs(place[0] * 0.5 - 7 - at) < 0.06 and steep[0] > 2
            rippled = clean + 5 * np.sin(9 * s) * (np.abs(s - at) > 5)
            assert abs(vision.step_places(rippled[None])[0][0] * 0.5 - 7 - at) < 0.2


def test_stills_are_searched_where_they_are_bright(monkeypatch):
    """A still is blurred about what is bright alone, and its outlines are those of the whole still."""
    image = disc(disc(picture(480, 300), 120.3, 80.6, 11, (240, 240, 240)), 160, 100, 9, (190, 190, 190))
    looked, real = [], shapes.blurred
    monkeypatch.setattr(shapes, "blurred", lambda part, *more, **other: looked.append(part.size) or real(part, *more, **other))
    one = pd.DataFrame([(1, 480, 300, image.tobytes())], columns=["clip_id", "w", "h", "rgba"])
    found = next(heads._rest_points(iter([one])))
    assert len(looked) == 1 and looked[0] < image[..., 0].size / 10
    bright = np.round(real(shapes.grey(image)))
    for level in heads.LADDER:
        whole = [(blob, i, x, y) for blob, points in shapes.outlines(shapes.opened(bright > level, 3), 15.0) for i, (x, y) in enumerate(points)]
        assert list(found[found["level"] == level][["blob", "at", "x", "y"]].itertuples(index=False, name=None)) == whole
    assert not list(heads._rest_points(iter([one.assign(rgba=[picture(480, 300).tobytes()])])))


def test_medians_of_bytes():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        stack = draw.integers(0, 256, (n, 400)).astype(np.uint8)
        stack[:, ::3] = stack[0, ::3]
        assert (pixels.lower_median(stack) == np.floor(np.median(stack, axis=0))).all()
