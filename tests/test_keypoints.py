"""Camera shifts by features on drawn grounds with a large body that moves by itself."""

import math

import numpy as np
from test_heads import clips

from motionspark.operators import keypoints, shapes, vision


def ground(draw, h, w, low, high):
    """Soft-edged random blots."""
    return shapes.blurred(np.kron(draw.integers(low, high, (h // 5 + 2, w // 5 + 2)), np.ones((5, 5)))[:h, :w].astype(float), 1.2, 3)


def moved(image, dx, dy, turn=0.0):
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(float)
    u, v = x - dx, y - dy
    return vision.between(image, u * math.cos(turn) + v * math.sin(turn), v * math.cos(turn) - u * math.sin(turn))


def scene(draw):
    """Frames whose ground shifts a little while a stronger body of over a third of the picture goes its own way."""
    h, w = 200, 260
    wide = ground(draw, h + 40, w + 40, 90, 150)
    body = ground(draw, 150, 130, 10, 250)
    out = []
    for dx, dy, bx in ((0.0, 0.0, 20), (1.3, -0.6, 29), (2.7, 1.9, 38), (-1.5, 0.4, 47)):
        grey = moved(wide, dx, dy)[20:-20, 20:-20].copy()
        grey[25:175, bx : bx + 130] = body
        rgba = np.dstack([grey, grey, grey, np.full_like(grey, 255)])
        out.append(((dx, dy), np.round(rgba).astype(np.uint8)))
    return out, np.round(np.dstack([*[wide[20:-20, 20:-20]] * 3, np.full((h, w), 255)])).astype(np.uint8)


def test_the_ground_outvotes_a_large_body(spark):
    drawn, still = scene(np.random.default_rng(3))
    rasters = clips(spark, {1: [im for _, im in drawn]})
    found = {r.frame: (r.sx, r.sy) for r in keypoints.feature_shifts(rasters, clips(spark, {1: [still]}).drop("frame")).collect()}
    for i, ((dx, dy), _) in enumerate(drawn):
        assert math.hypot(found[i][0] - dx, found[i][1] - dy) < 0.3
    # Phase correlation between frames is carried off by the body.
    far = []
    for i in (1, 2, 3):
        by_phase = vision.shift_between(*(im[..., 0].astype(float) for im in (drawn[0][1], drawn[i][1]))) or (0.0, 0.0)
        far.append(math.hypot(by_phase[0] - drawn[i][0][0], by_phase[1] - drawn[i][0][1]))
    assert max(far) > 3


def test_turns_and_pictures_without_corners(spark):
    draw = np.random.default_rng(5)
    wide = ground(draw, 220, 260, 60, 200)
    turned = moved(wide, 6.0, -4.0, 0.02)
    as_raster = lambda g: np.dstack([*[np.round(g).astype(np.uint8)] * 3, np.full(g.shape, 255, np.uint8)])
    blank = as_raster(np.full(wide.shape, 90.0))
    rasters = clips(spark, {1: [as_raster(g) for g in (wide, turned)] + [blank], 2: [blank, as_raster(wide[:20, :20])]})
    still = clips(spark, {1: [as_raster(wide)], 2: [blank]}).drop("frame")
    found = {(r.clip_id, r.frame): (r.sx, r.sy) for r in keypoints.feature_shifts(rasters, still).collect()}
    want = (6.0, -4.0)
    assert math.hypot(*np.subtract(found[1, 1], want)) < 0.5 and found[1, 2] == found[1, 1] and math.hypot(*found[1, 0]) < 0.05
    assert found[2, 0] == found[2, 1] == (0.0, 0.0)
    motion = {r.frame: r for r in keypoints.motions(keypoints.matches(keypoints.corner_rows(still.selectExpr("*", "0 AS frame")), keypoints.corner_rows(rasters))).collect()}
    assert abs(math.atan2(motion[1].turn_y, motion[1].turn_x) - 0.02) < 0.002


def test_matches_are_mutual_and_corners_spread():
    draw = np.random.default_rng(8)
    image = ground(draw, 150, 170, 0, 255).astype(np.uint8)
    x, y, words = keypoints.corners(image)
    tiles = np.unique(np.stack([np.round(x) // keypoints.CORNER_TILE, np.round(y) // keypoints.CORNER_TILE]), axis=1, return_counts=True)[1]
    assert len(x) > 60 and np.quantile(tiles, 0.9) <= keypoints.PER_TILE and words.shape == (len(x), 4)
    again = keypoints.corners(np.roll(image, (4, 3), (0, 1)))
    same = {(round(a, 6), round(b, 6)) for a, b in zip(x + 3, y + 4)} & {(round(a, 6), round(b, 6)) for a, b in zip(*again[:2])}
    assert len(same) > 0.5 * len(x)


def test_nearest_of_those_that_share_a_band(monkeypatch):
    """As all pairs say, ties and blocks of candidates included."""
    draw = np.random.default_rng(11)
    still = draw.integers(-(2**63), 2**63, (60, 4), np.int64)
    still[40:44] = still[3]
    frame = np.concatenate([still[draw.permutation(60)[:50]] ^ (1 << draw.integers(0, 63, (50, 4))), draw.integers(-(2**63), 2**63, (20, 4), np.int64)])
    frame[60:64] = frame[5]
    differ = np.bitwise_count((still[:, None] ^ frame).view(np.uint64)).sum(axis=2)
    band = lambda words: np.ascontiguousarray(words).view(np.uint16)
    differ = np.where((band(still)[:, None] == band(frame)).any(axis=2), differ, 999)
    want = {(a, b) for b, a in enumerate(differ.argmin(axis=0)) if differ[a, b] < 999 and differ[a].argmin() == b}
    assert len(want) > 30
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(keypoints, "PAIRS", pairs)
        assert set(zip(*(v.tolist() for v in keypoints.mutual(still, frame)))) == want
    assert [len(v) for v in keypoints.mutual(still[:0], frame)] == [len(v) for v in keypoints.mutual(still, frame[:0])] == [0, 0]


def test_corners_are_dealt_once(spark):
    """A corner is one row until it is matched, not one a band, and pictures are looked at once."""
    draw = np.random.default_rng(5)
    grey = np.round(ground(draw, 120, 160, 60, 200)).astype(np.uint8)
    rasters = clips(spark, {1: [np.dstack([grey] * 3 + [np.full_like(grey, 255)])] * 2})
    found = keypoints.matches(keypoints.corner_rows(rasters.where("frame = 0")), keypoints.corner_rows(rasters, marked=True))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    rows = found.collect()
    assert sorted(r.frame for r in rows if r.n is None) == [0, 1]
    own = [r for r in rows if r.n is not None]
    assert len(own) > 100 and sorted(r.n for r in own if r.frame == 1) == list(range(len(own) // 2)) and all((r.x, r.y) == (r.u, r.v) for r in own)
