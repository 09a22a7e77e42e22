"""From drawn rasters to strokes, held to the truth that was drawn in."""

import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from motionspark.operators import pixels, tracker
from motionspark.plans import analysis, strokes
from motionspark.sources import rasters
from motionspark.streaming.tracker import track_stream

W, H, SCALE = 160, 400, 0.4
MAT = (0.0, 0.0, W - 1.0, H - 1.0)
HOM = [1 / SCALE, 0.0, 0.0, 0.0, 1 / SCALE, 0.0, 0.0, 0.0, 1.0]
CLIP = 104  # plain, at 1 m/s
SIDE = 1  # the head lies behind its face


@pytest.fixture(scope="module")
def truth(spark):
    return strokes.observations(spark, SMALL).where(F.col("k") == CLIP)


def drawn(spark, truth, folder, **how):
    rasters.render(truth.repartition(4), W, H, SCALE, **how).write.parquet(folder)
    return spark.read.parquet(folder)


def check(record, shift=0.0):
    """The reference's own gates."""
    r, k = record.collect()[0], CLIP
    face, path, start = (k % 41 - 20) / 10, (7 * k % 61 - 30) / 10, (k % 41 - 20) / 10 - 0.1
    assert abs(r.fps - 240) < 2 and abs(r.t0 - 0.9) < 1 / 240
    assert abs(r.face_deg - face) < 0.30 and abs(r.path_deg - path) < 0.40 and abs(r.face_to_path - face + path) < 0.50
    assert abs(r.face_rate / -50 - 1) < 0.08 and abs(r.start_line_deg - start) < 0.30
    assert abs(r.ball_speed / 1.0 - 1) < 0.03 and abs(r.tempo_ratio / 1.968 - 1) < 0.05 and abs(r.back_len - 200) < 8
    return r


def test_rasters_to_stroke(spark, truth, tmp_path):
    seen = tracker.see(drawn(spark, truth, f"{tmp_path}/r"))
    seen.write.parquet(f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    tracked = tracker.track(seen, MAT, HOM)
    assert tracked.where("bx is not null and ax is not null").count() == 324
    cands = tracker.candidates(seen, MAT)
    for i in range(4):  # as a stream in four parts, the last with a frame that comes too late
        part = seen.where((F.col("frame") % 324 >= 81 * i) & (F.col("frame") < 81 * (i + 1)) | ((F.lit(i) == 3) & (F.col("frame") == 5)))
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = track_stream(stream, MAT, HOM).writeStream.format("memory").queryName("tracked_rasters").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("tracked_rasters").collect()} == {tuple(r) for r in tracked.collect()}
    check(analysis.stroke_record(tracker.finish(tracked, cands, MAT, HOM, W / SCALE)))
    scaled = tracker.finish(tracked, cands, MAT, [2 * v if i < 6 else v for i, v in enumerate(HOM)], 2 * W / SCALE, scale_from_ball=True)
    r = analysis.stroke_record(scaled).collect()[0]
    assert abs(r.ball_speed / 1.0 - 1) < 0.10 and abs(r.face_deg - (CLIP % 41 - 20) / 10) < 0.30  # a typed width twice too large
    assert abs(r.mat_mm / (W / SCALE) - 1) < 0.10 and any(w.startswith("scale measured from the ball") and " 4" in w or " 3" in w for w in r.warnings)


def test_top_down(spark, truth, tmp_path):
    seen = tracker.see(drawn(spark, truth, f"{tmp_path}/r", line=True), line=True)
    seen.write.parquet(f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    lines = seen.where("line is not null").select("clip_id", "frame", "line.rad", F.col("line.x").alias("lx"), F.col("line.y").alias("ly"))
    assert lines.count() == 324
    obs = tracker.finish_top_down(tracker.track(seen, MAT), tracker.candidates(seen, MAT), lines, W, H)
    r = analysis.stroke_record(obs).collect()[0]
    # Seen from above with y down the picture, right of the way is left in the picture: angles turn their sign.
    face, path = (CLIP % 41 - 20) / 10, (7 * CLIP % 61 - 30) / 10
    assert abs(r.t0 - 0.9) < 1 / 240 and abs(abs(r.face_deg) - abs(face)) < 0.4 and abs(abs(r.path_deg) - abs(path)) < 0.5
    assert abs(r.ball_speed / 1.0 - 1) < 0.10


def test_tracker_rules():
    """A lost ball is looked for everywhere and must keep its size; markers are looked for near their last place first."""
    ball = lambda x, y, n=100: {"x": x, "y": y, "n": n, "fill": 0.8}
    mark = lambda x, y, w=1.0: {"x": x, "y": y, "weight": w}
    t = tracker.Tracker((0.0, 0.0, 500.0, 500.0))
    assert t.step([ball(50, 50)], [mark(10, 10), mark(30, 10)])[0]["x"] == 50
    found, pair = t.step([ball(400, 400, 300), ball(52, 50)], [mark(300, 300, 9.0), mark(320, 300, 9.0), mark(31, 11), mark(11, 11)])
    assert found["x"] == 52 and [m["x"] for m in pair] == [11, 31]
    for _ in range(6):
        assert t.step([ball(400, 400, 300)], [])[0] is None  # too large for this ball
    assert t.state["ball"] is not None
    t.step([], [])
    assert t.state["ball"] is None and t.state["size"] > 0 and t.state["box"] is None
    assert t.step([ball(400, 400, 300)], [])[0] is None and t.step([ball(410, 400, 120)], [])[0]["x"] == 410
    gated = tracker.Tracker((0.0, 0.0, 500.0, 500.0), HOM)
    assert gated.step([ball(20, 20, 5000), ball(30, 30, 230)], [])[0]["x"] == 30


def test_hue_of_a_sticker(spark, truth, tmp_path):
    one = rasters.render(truth.where("frame = 0"), W, H, SCALE)
    at = truth.where("frame = 0").first()
    px, py = round(W / 2 + (at.hx + at.fx / 2) * SCALE), round((at.hy + at.fy / 2) * SCALE)
    found = pixels.sample_hue(one.withColumns({"px": F.lit(px), "py": F.lit(py)}), 2).first()
    assert abs(found.hue - 320) < 2 and found.n == 25 and found.s > 0.8
    nothing = pixels.sample_hue(one.withColumns({"px": F.lit(-50), "py": F.lit(-50)}), 2)
    assert nothing.count() == 0


def markerless(truth_rows):
    """A bright head of 110 by 60 mm whose front runs through the face, the ball, and the line, as rasters."""
    out = []
    for r in truth_rows:
        line = (W / 2, 5 * SCALE)
        balls = [] if r.ball_x is None else [(W / 2 + r.ball_x * SCALE, r.ball_y * SCALE, rasters.BALL_MM / 2 * SCALE, rasters.BALL)]
        image = rasters.draw([], W, H, line)[..., :3].astype(float)
        if r.hx is not None:
            y, x = np.mgrid[:H, :W].astype(float)
            n = math.hypot(r.fx, r.fy)
            ux, uy = r.fx / n, r.fy / n  # along the face; its normal points the way the ball goes
            px, py = x - (W / 2 + r.hx * SCALE), y - r.hy * SCALE
            along, ahead = px * ux + py * uy, -px * uy + py * ux
            cover = np.clip(22 - np.abs(along) + 0.5, 0, 1) * np.clip(12 - np.abs(ahead - SIDE * -12) + 0.5, 0, 1)
            image += (np.array([225.0, 225.0, 225.0]) - image) * cover[..., None]
        rgba = np.dstack([np.round(image), np.full((H, W), 255)]).astype(np.uint8)
        for cx, cy, radius, colour in balls:
            y, x = np.mgrid[:H, :W].astype(float)
            cover = np.clip(radius - np.hypot(x - cx, y - cy) + 0.5, 0, 1)[..., None]
            rgba[..., :3] = np.round(rgba[..., :3] * (1 - cover) + np.array(colour) * cover)
        out.append((CLIP, r.frame, r.t, W, H, bytearray(rgba.tobytes())))
    return out


def test_markerless_top_down(spark, truth, tmp_path):
    """Both edges of every large blob are kept; the ball's way tells which is the face, within the gate of 1.2 degrees."""
    rows = truth.orderBy("frame").collect()
    drawn = spark.createDataFrame(markerless(rows), rasters.RASTERS)
    drawn.repartition(8).write.parquet(f"{tmp_path}/r")
    drawn = spark.read.parquet(f"{tmp_path}/r")
    tracker.see(drawn, line=True).write.parquet(f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    lines = seen.where("line is not null").select("clip_id", "frame", "line.rad", F.col("line.x").alias("lx"), F.col("line.y").alias("ly"))
    tracker.face_hypotheses(drawn, lines).write.parquet(f"{tmp_path}/faces")
    faces = spark.read.parquet(f"{tmp_path}/faces")
    assert faces.where("side = 1").count() > 250 and faces.where("side = -1").count() > 250
    obs = tracker.finish_top_down(tracker.track(seen, MAT), tracker.candidates(seen, MAT), lines, W, H, faces=faces)
    r = analysis.stroke_record(obs, markerless=True).collect()[0]
    face = (CLIP % 41 - 20) / 10
    assert abs(abs(r.face_deg) - abs(face)) < 1.2 and r.face_frames > 200
    assert any("without markers" in w for w in r.warnings)


def test_mats_that_fill_less_than_their_box(spark):
    """Blobs beside the mat's corners are neither followed nor candidates."""
    quad = [(20.0, 0.0), (140.0, 0.0), (100.0, 300.0), (60.0, 300.0)]
    box = (20.0, 0.0, 140.0, 300.0)
    ball = lambda x, y: {"cand_idx": 0, "x": x, "y": y, "n": 100, "fill": 0.8, "w": 11, "h": 11}
    seen = spark.createDataFrame([(1, 0, 0.0, [ball(30.0, 280.0)], [], None), (1, 1, 0.1, [ball(80.0, 280.0)], [], None)], tracker.SEEN)
    assert [(r.frame, r.bx) for r in tracker.track(seen, box, quad=quad).orderBy("frame").collect()] == [(0, None), (1, 80.0)]
    assert [r.frame for r in tracker.candidates(seen, box, quad=quad).collect()] == [1] and tracker.candidates(seen, box).count() == 2
