"""Tracking, pixels, containers, the session store and the stream."""

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from motionspark.operators.observations import accepted_heads
from motionspark.operators import pixels, tracking
from motionspark.sources import mp4, session_store
from motionspark.streaming.tracker import associate_stream

CANDS = "clip_id long, frame int, cand_idx int, x double, y double"


def candidates():
    """Two printed marks, a swinging head and a ball that leaves; the marks come first."""
    rows = []
    for f in range(80):
        points = [(300, 120), (300, 900), (250, 560 + 420 * math.sin(2 * math.pi * f / 79)), (302, 500 if f < 20 else 500 - 6 * (f - 20))]
        rows += [(1, f, i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    return rows


def test_the_ball_is_the_track_that_leaves(spark):
    df = spark.createDataFrame(candidates(), CANDS)
    ball = {r["frame"]: (r["x"], r["y"]) for r in tracking.resolve_ball(df).collect()}
    assert abs(ball[79][1] - (500 - 6 * 59)) <= 2 and abs(ball[0][1] - 500) <= 2
    assert ball[0][1] - ball[79][1] > 300


def test_stream_equals_batch(spark, tmp_path):
    rows = candidates()
    batch = {tuple(r) for r in tracking.associate(spark.createDataFrame(rows, CANDS)).collect()}
    for i in range(4):
        part = spark.createDataFrame([r for r in rows if r[1] // 20 == i], CANDS)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(CANDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = associate_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("tracked").collect()} == batch


def test_heads_that_jump_or_blur_are_refused(spark):
    rows = [(1, f, 10.0 * f, 0.0, 1.0, 0.5) for f in range(10)] + [(1, 10, 900.0, 0.0, 1.0, 0.5), (1, 11, 110.0, 0.0, 1.0, 0.5), (1, 12, 120.0, 0.0, 1.0, 3.0), (1, 13, 130.0, 0.0, 1.0, None), (2, 0, 5.0, 5.0, 1.0, 0.5)]
    kept = accepted_heads(spark.createDataFrame(rows, "clip_id long, frame int, x double, y double, mm_per_px double, rms double")).collect()
    assert sorted((r.clip_id, r.frame) for r in kept) == [*[(1, f) for f in range(10)], (1, 11), (2, 0)]


def raster(w=80, h=60, draw=()):
    image = np.zeros((h, w, 4), np.uint8)
    image[..., :3], image[..., 3] = (31, 107, 57), 255
    y, x = np.mgrid[:h, :w]
    for kind, *a in draw:
        if kind == "disc":
            cx, cy, r, colour = a
            image[(x - cx) ** 2 + (y - cy) ** 2 <= r * r, :3] = colour
        else:
            cx, cy, angle, half, wide, colour = a
            u, v = (x - cx) * math.cos(angle) + (y - cy) * math.sin(angle), (y - cy) * math.cos(angle) - (x - cx) * math.sin(angle)
            image[(abs(u) <= half) & (abs(v) <= wide), :3] = colour
    return (w, h, bytearray(image.tobytes()))


RASTERS = "clip_id long, frame int, w int, h int, rgba binary"


def test_blobs_lines_and_markers(spark):
    magenta, white, yellow, dark = (232, 30, 168), (240, 240, 240), (230, 215, 40), (10, 10, 10)
    angle = math.radians(2)
    frames = [(1, 0, *raster(draw=[("disc", 30, 20, 5, white), ("bar", 60, 30, 0.3, 3, 1, white)])), (1, 1, *raster(draw=[("disc", 20, 20, 3, magenta), ("disc", 60, 25, 4, magenta), ("disc", 40, 50, 1, magenta)])), (1, 2, *raster(draw=[("bar", 40, 30, angle, 36, 2, yellow)])), (1, 3, *raster(draw=[("bar", 40, 30, 0.4, 15, 3, dark)]))]
    df = spark.createDataFrame(frames, RASTERS)
    ball = pixels.first_candidate(pixels.ball_candidates(df.where("frame = 0"), n_min=40)).collect()
    assert len(ball) == 1 and abs(ball[0]["x"] - 30) < 1.5 and abs(ball[0]["y"] - 20) < 1.5
    assert sorted(round(r["x"]) for r in pixels.markers(df.where("frame = 1")).collect()) == [20, 60]
    line = pixels.target_line(df.where("frame = 2")).first()
    assert abs(line["theta_deg"] - 2) < 0.5
    assert pixels.target_line(df.where("frame = 0")).count() == 0
    head = pixels.putter_blob(df.where("frame = 3")).first()
    assert abs(head["theta"] - 0.4) < 0.05
    edge = pixels.face_edge(spark.createDataFrame([(1, 0, *raster(draw=[("bar", 40, 30, 0.05, 20, 6, white)]), 40.0, 30.0, 0.0, -1.0)], RASTERS + ", hx double, hy double, ux double, uy double")).first()
    assert abs(edge["theta_deg"] - math.degrees(0.05)) < 1.0


def test_background_is_the_median(spark):
    frames = [(1, f, *raster(12, 8, [("disc", 1 + 2 * f, 4, 0.5, (250, 250, 250))])) for f in range(5)]
    rows = pixels.background(spark.createDataFrame(frames, RASTERS)).collect()
    assert len(rows) == 96 and {(r["r"], r["g"], r["b"]) for r in rows} == {(31, 107, 57)}


def test_template_follows(spark):
    frames = [(1, f, *raster(draw=[("disc", 20 + 3 * f, 30, 3, (250, 250, 250))])) for f in range(6)]
    seeds = spark.createDataFrame([(1, 20.0, 30.0)], "clip_id long, sx double, sy double")
    xs = [r["x"] for r in pixels.track_template(spark.createDataFrame(frames, RASTERS), seeds).orderBy("frame").collect()]
    assert all(abs(x - 20 - 3 * f) <= 1 for f, x in enumerate(xs))


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def movie(fragmented=False, edits=None, chunks=(1000, 2000)):
    full = lambda kind, n, body: box(kind, struct.pack(">II", 0, n) + body)
    entry = box(b"avc1", bytes(24) + struct.pack(">HH", 320, 180) + bytes(50) + box(b"avcC", bytes([1, 0x64, 0, 0x1F, 0xFF])))
    stbl = box(b"stbl", full(b"stsd", 1, entry) + full(b"stts", 1, struct.pack(">II", 4, 100)) + full(b"ctts", 4, struct.pack(">IiIiIiIi", 1, 0, 1, 200, 1, -100, 1, 0)) + box(b"stsz", struct.pack(">III", 0, 0, 4) + struct.pack(">IIII", 10, 20, 30, 40)) + full(b"stsc", 2, struct.pack(">IIIIII", 1, 3, 1, 2, 1, 1)) + full(b"stco", 2, struct.pack(">II", *chunks)) + full(b"stss", 1, struct.pack(">I", 1)))
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 6000, 400, 0, 0)) + box(b"hdlr", struct.pack(">II", 0, 0) + b"vide" + bytes(13)) + box(b"minf", stbl))
    edts = b""
    if edits:
        version, times = edits
        edts = box(b"edts", box(b"elst", struct.pack(">BBHI", version, 0, 0, len(times)) + b"".join(struct.pack(">Qqi" if version else ">Iii", 400, t, 1 << 16) for t in times)))
    head = box(b"ftyp", b"isom" + bytes(4))
    return head + (box(b"moof", b"") if fragmented else box(b"moov", box(b"trak", edts + mdia)))


def test_mp4_samples(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(movie())
    (tmp_path / "b.mp4").write_bytes(movie(True))
    (tmp_path / "c.mp4").write_bytes(b"\0\0\0\x09junk")
    (tmp_path / "d.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", b""))
    rows = mp4.read_samples(spark, str(tmp_path)).orderBy("path", "sample_idx").collect()
    good = [r for r in rows if r["reason"] is None]
    assert [(r["offset"], r["size"], r["dts"], r["cts"], r["key"]) for r in good] == [(1000, 10, 0, 0, True), (1010, 20, 100, 300, False), (1030, 30, 200, 100, False), (2000, 40, 300, 300, False)]
    assert good[0]["codec"] == "avc1.64001f" and (good[0]["width"], good[0]["height"], good[0]["timescale"], good[0]["nominal_fps"]) == (320, 180, 6000, 60)
    assert {r["reason"] for r in rows} == {None, "fragmented file", "no movie box", "no video track"}


def test_mp4_edit_lists(spark, tmp_path):
    """The first edit that is not empty is time 0, for decoding and presentation times alike."""
    for name, edits in {"a": (0, [-1, 50]), "b": (1, [100]), "c": (0, [-1])}.items():
        (tmp_path / f"{name}.mov").write_bytes(movie(edits=edits))
    rows = mp4.read_samples(spark, str(tmp_path)).orderBy("path", "sample_idx").collect()
    times = {n: [(r.dts, r.cts) for r in rows if r.path.endswith(f"{n}.mov")] for n in "abc"}
    plain = [(0, 0), (100, 300), (200, 100), (300, 300)]
    assert times == {"a": [(d - 50, c - 50) for d, c in plain], "b": [(d - 100, c - 100) for d, c in plain], "c": plain}


def test_mp4_bytes_and_frames(spark, tmp_path):
    """Samples are read by their ranges, from a file whose index follows the media; frames are found in the order shown."""
    media = bytes(range(100))
    start = len(box(b"ftyp", b"isom" + bytes(4))) + 8
    whole = movie(chunks=(start, start + 60))
    head, moov = whole[: start - 8], whole[start - 8 :]
    (tmp_path / "late.mp4").write_bytes(head + box(b"mdat", media) + moov)
    samples = mp4.read_samples(spark, str(tmp_path)).cache()
    data = {r.sample_idx: bytes(r.data) for r in mp4.sample_bytes(samples).collect()}
    assert data == {0: media[:10], 1: media[10:30], 2: media[30:60], 3: media[60:]}
    shown = [mp4.frame_at(samples, i).first() for i in range(4)]
    assert [(r.sample_idx, r.from_key) for r in shown] == [(0, 0), (2, 0), (1, 0), (3, 0)]
    assert mp4.frame_at(samples, 9).count() == 0


def test_clip_timing(spark):
    df = spark.createDataFrame([(240.0, 30.0), (0.0, 240.0)], "stated_fps double, container_fps double")
    a, b = mp4.clip_timing(df).collect()
    assert (a["capture_fps"], a["time_scale"], a["stretched"], a["looks_rendered"]) == (240, 0.125, True, True)
    assert (b["capture_fps"], b["stretched"], b["looks_rendered"]) == (240, False, False)


def test_session_store(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "2024-01-01", 1.23456, None, [1.0]), (1, "2024-01-02", 9.0, "bad", [2.0])], "session int, t string, face_deg double, implausible string, head_path array<double>")
    session_store.save(session_store.blank_implausible(df, ["face_deg"]), path)
    session_store.append(df.limit(1), path)
    got = session_store.load(spark, path)
    assert got.count() == 3 and "head_path" not in got.columns and not got.where("has_clip").count()
    assert got.where("implausible is not null").first()["face_deg"] is None
    session_store.export_csv(got, str(tmp_path / "csv"))
    out = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert sorted(r["#"] for r in out) == ["1", "2", "3"] and "1.2346" in [r["face_deg"] for r in out]
    session_store.export_json(got, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    session_store.clear(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"fps": 240,\n "quad": [[1, 2], [3, 4]], "note": "x", "other": 1}')
    (tmp_path / "b.json").write_text("{broken")
    rows = session_store.read_json(spark, str(tmp_path), "fps double, quad array<array<double>>, note string").collect()
    assert sorted([(r.fps, r.quad, r.note) for r in rows], key=repr) == [(240.0, [[1.0, 2.0], [3.0, 4.0]], "x"), (None, None, None)]
