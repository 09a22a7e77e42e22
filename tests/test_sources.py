"""Data sources of samples and frames, with pushed filters and split files."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, Not
from test_tracking import box, movie

from motionspark.operators import tracker
from motionspark.plans import strokes
from motionspark.sources import frames, mp4, rasters
from motionspark.sources.files import Asked
from motionspark.sources.mp4_source import Mp4Reader, Mp4Source


@pytest.fixture(scope="module")
def registered(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mp4Source)
    spark.dataSource.register(frames.FrameSource)
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def with_media(name, folder):
    start = len(box(b"ftyp", b"isom" + bytes(4))) + 8
    whole = movie(chunks=(start, start + 60))
    (folder / name).write_bytes(whole[: start - 8] + box(b"mdat", bytes(range(100))) + whole[start - 8 :])


def test_mp4_source_equals_read_samples(registered, tmp_path):
    spark = registered
    with_media("a.mp4", tmp_path)
    with_media("b.MOV", tmp_path)
    (tmp_path / "c.mp4").write_bytes(movie(True))
    (tmp_path / "notes.txt").write_text("no film")
    want = {tuple(r) for r in mp4.read_samples(spark, f"{tmp_path}/*.[mM]*").withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")).collect()}
    for split in (40, 10**6):
        found = spark.read.format("mp4").option("split", split).load(str(tmp_path))
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    data = spark.read.format("mp4").option("data", "true").option("split", 50).load(str(tmp_path))
    assert {bytes(r.data) for r in data.where("sample_idx = 1").collect()} == {bytes(range(10, 30))}
    one = data.where(F.col("key") & (F.col("path") == f"file://{tmp_path}/a.mp4"))
    assert [(r.sample_idx, bytes(r.data)) for r in one.collect()] == [(0, bytes(range(10)))]


def test_pushed_filters_read_fewer_bytes(tmp_path):
    for name in ("a.mp4", "b.mp4"):
        with_media(name, tmp_path)

    def taken(*filters):
        reader = Mp4Reader({"path": str(tmp_path), "data": "true"})
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        return len(rows), reader.bytes_read, left

    path, key, at = ("path",), ("key",), ("sample_idx",)
    everything, fewer = taken(), taken(EqualTo(key, True))
    assert everything[0] == 8 and fewer[0] == 2 and everything[1] - fewer[1] == 2 * 90
    assert taken(EqualTo(path, f"file://{tmp_path}/a.mp4"))[1] * 2 == everything[1]
    assert taken(In(path, ("nowhere",)))[:2] == (0, 0)
    assert taken(GreaterThanOrEqual(at, 1), LessThan(at, 3))[0] == 4 and taken(EqualTo(key, True), EqualTo(key, False))[0] == 0
    strange = Not(EqualTo(key, True))
    assert taken(strange)[2] == [strange] and taken(strange)[0] == 8
    assert Asked("n").row(5)


def test_mp4_stream_takes_each_file_once(registered, tmp_path):
    spark, folder = registered, tmp_path / "in"
    folder.mkdir()
    with_media("a.mp4", folder)
    stream = spark.readStream.format("mp4").load(str(folder)).select("path", "sample_idx")
    for name in ("b.mp4", "c.mp4"):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        with_media(name, folder)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").groupBy("path").count().collect()
    assert {(os.path.basename(r.path), r["count"]) for r in rows} == {("a.mp4", 4), ("b.mp4", 4), ("c.mp4", 4)}


def y4m(images, chroma="444", fps="240:1", full=True):
    """A Y4M file of h x w x 3 pictures of whole YUV samples."""
    h, w = images[0].shape[:2]
    across, down = frames.CHROMA[chroma] or (1, 1)
    out = f"YUV4MPEG2 W{w} H{h} F{fps} Ip A1:1 C{chroma}{' XCOLORRANGE=FULL' if full else ''}\n".encode()
    for im in images:
        out += b"FRAME\n" + im[..., 0].tobytes()
        if chroma != "mono":
            out += im[::down, ::across, 1].tobytes() + im[::down, ::across, 2].tobytes()
    return out


def as_yuv(rgba):
    r, g, b = (rgba[..., i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.clip(np.round(np.dstack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402])), 0, 255).astype(np.uint8)


def test_y4m_frames(registered, tmp_path):
    spark, draw = registered, np.random.default_rng(2)
    images = [draw.integers(0, 256, (7, 10, 3)).astype(np.uint8) for _ in range(9)]
    for chroma in ("444", "422", "420jpeg", "mono", "411"):
        (tmp_path / f"{chroma}.y4m").write_bytes(y4m(images, chroma) + b"FRAME\ncut")
    for split in (100, 10**6):
        rows = spark.read.format("frames").option("split", split).load(str(tmp_path)).collect()
        assert len(rows) == 45 and {(r.w, r.h, round(r.t * 240)) for r in rows} == {(10, 7, i) for i in range(9)}
        grey = {(os.path.basename(r.path), r.frame): np.frombuffer(r.rgba, np.uint8).reshape(7, 10, 4) for r in rows}
        for i in range(9):
            assert (grey["mono.y4m", i][..., :3] == images[i][..., :1]).all() and (grey["mono.y4m", i][..., 3] == 255).all()
            y, u, v = (images[i][..., c].astype(float) for c in range(3))
            red = np.clip(np.round(y + 1.402 * (v - 128)), 0, 255)
            assert (grey["444.y4m", i][..., 0] == red).all() and (grey["420jpeg.y4m", i][::2, ::2, 0] == red[::2, ::2]).all() and (grey["411.y4m", i][:, ::4, 0] == red[:, ::4]).all()
    few = spark.read.format("frames").load(str(tmp_path)).where(f"frame >= 7 AND path = 'file://{tmp_path}/mono.y4m'")
    assert sorted(r.frame for r in few.collect()) == [7, 8]
    reader = frames.FrameReader({"path": str(tmp_path)})
    list(reader.pushFilters([EqualTo(("frame",), 3)]))
    assert [r[2] for p in reader.partitions() for r in reader.read(p)] == [3] * 5 and reader.bytes_read < 6000
    with pytest.raises(ValueError):
        frames.header(b"YUV4MPEG2 W2 H2 C420p10\n")


def png(image, kinds, colour):
    """A PNG by the plainest encoder, each row with the filter of its turn."""
    h, w, n = image.shape
    flat = image.reshape(h, w * n).astype(int)
    raw = b""
    for y in range(h):
        left = np.concatenate([np.zeros(n, int), flat[y][:-n]])
        up = flat[y - 1] if y else np.zeros(w * n, int)
        corner = np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        plane = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        kind = kinds[y % len(kinds)]
        raw += bytes([kind]) + ((flat[y] - [np.zeros(w * n, int), left, up, (left + up) // 2, plane][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(raw)
    return frames.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


def test_png_sequences(registered, tmp_path):
    spark, draw = registered, np.random.default_rng(4)
    images = [draw.integers(0, 256, (6, 5, 4)).astype(np.uint8) for _ in range(4)]
    for i, im in enumerate(images):
        os.makedirs(tmp_path / "clip", exist_ok=True)
        (tmp_path / "clip" / f"f{i:03}.png").write_bytes(png(im, (0, 1, 2, 3, 4), 6))
    rows = spark.read.format("frames").option("fps", 10).option("split", 100).load(str(tmp_path)).orderBy("frame").collect()
    assert [(r.frame, r.t) for r in rows] == [(i, i / 10) for i in range(4)] and len({r.clip_id for r in rows}) == 1
    for r, im in zip(rows, images):
        assert (np.frombuffer(r.rgba, np.uint8).reshape(6, 5, 4) == im).all()
    for channels, colour in ((1, 0), (2, 4), (3, 2)):
        found = frames.read_png(png(images[0][..., :channels], (4, 3), colour))
        assert (found[..., 0] == images[0][..., 0]).all() and (found[..., 3] == (images[0][..., 1] if channels == 2 else 255)).all()


def test_a_stroke_read_from_a_file_of_frames(registered, tmp_path):
    """A drawn clip, written as Y4M and read back in splits, gives the same sightings as the rasters themselves."""
    spark = registered
    truth = strokes.observations(spark, "/root/testdata/sf0.001").where("k = 104 AND frame BETWEEN 200 AND 230")
    drawn = rasters.render(truth, 160, 400, 0.4).orderBy("frame").collect()
    (tmp_path / "stroke.y4m").write_bytes(y4m([as_yuv(np.frombuffer(r.rgba, np.uint8).reshape(400, 160, 4)) for r in drawn]))
    seen = tracker.see(spark.read.format("frames").option("split", 1_000_000).load(str(tmp_path))).orderBy("frame").collect()
    own = tracker.see(spark.createDataFrame([tuple(r) for r in drawn], rasters.RASTERS)).orderBy("frame").collect()
    assert len(seen) == len(own) == 31
    for a, b in zip(seen, own):
        assert len(a.balls) == len(b.balls) and len(a.marks) == len(b.marks) == 2
        for p, q in zip(*(sorted([*r.balls, *r.marks], key=lambda thing: thing.x) for r in (a, b))):
            assert abs(p.x - q.x) < 0.1 and abs(p.y - q.y) < 0.1


def test_sample_tables_from_sql(registered, tmp_path):
    """Laterally over a table of files: the rows of read_samples, and bytes if asked for."""
    from pyspark.errors import AnalysisException

    from motionspark.sources import sample_tables

    spark = registered
    with_media("a.mp4", tmp_path)
    (tmp_path / "c.mp4").write_bytes(movie(True))
    sample_tables.register(spark)
    files = [(n, f"file:{tmp_path}/{n}.mp4") for n in "ac"] + [("z", None)]
    spark.createDataFrame(files, "name string, path string").createOrReplaceTempView("files")
    found = {tuple(r) for r in spark.sql("SELECT s.* FROM files f, LATERAL mp4_samples(f.path) s").collect()}
    assert found == {tuple(r) for r in mp4.read_samples(spark, str(tmp_path)).collect()} and len(found) == 5
    rows = spark.sql("SELECT f.name, s.sample_idx, s.data FROM files f, LATERAL mp4_samples(f.path, true) s WHERE s.sample_idx >= 1 ORDER BY 1, 2").collect()
    assert [(r.name, r.sample_idx, bytes(r.data)) for r in rows] == [("a", 1, bytes(range(10, 30))), ("a", 2, bytes(range(30, 60))), ("a", 3, bytes(range(60, 100)))]
    for wrong in ("mp4_samples(3)", "mp4_samples('x', 5)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {wrong}").collect()
