"""What single pictures and short clips show, as registered queries: one clip for each supplier key, drawn by its numbers.

The oracles say in SQL where things were drawn; measured places and angles are shown to the step they were drawn in,
which asks for half a step of accuracy.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import heads, keypoints, pixels, vision
from ..operators.observations import HEAD_MM

W, H, FRAMES, WANT = 240, 180, 5, 60.0
CLIP = "clip_id long, frame int, w int, h int, rgba binary"
BRIGHT, DARK, YELLOW, GROUND = (240, 240, 240), (25, 25, 25), (230, 220, 40), (60, 110, 70)

_y, _x = np.mgrid[:H, :W].astype(float)


_ground = np.broadcast_to(np.array(GROUND, float), (H, W, 3)).copy()
#: A worker's one picture and its levels, used anew for each raster: memory that is given back and asked for again costs more than drawing.
_canvas, _levels = np.empty((2, H, W, 3))


def _mat() -> np.ndarray:
    return _ground.copy()


def _blank() -> np.ndarray:
    """As ``_mat``, on the worker's one canvas."""
    np.copyto(_canvas, _ground)
    return _canvas


def _box(cx: float, cy: float, rx: float, ry: float) -> tuple[slice, slice]:
    """The rows and columns that a thing reaching (rx, ry) from its middle can touch; beyond them its cover is 0."""
    return tuple(slice(max(0, math.floor(c - r - 1)), max(0, math.ceil(c + r + 2))) for c, r in ((cy, ry), (cx, rx)))


def _paint(image: np.ndarray, box: tuple[slice, slice], cover: np.ndarray, colour: tuple) -> np.ndarray:
    image[box] += (np.array(colour, float) - image[box]) * cover[..., None]
    return image


def disc(image: np.ndarray, cx: float, cy: float, r: float, colour: tuple) -> np.ndarray:
    box = _box(cx, cy, r, r)
    return _paint(image, box, np.clip(r - np.hypot(_x[box] - cx, _y[box] - cy) + 0.5, 0, 1), colour)


def bar(image: np.ndarray, cx: float, cy: float, degrees: float, half: float, wide: float, colour: tuple) -> np.ndarray:
    """A smooth-edged rectangle about (cx, cy), its long side turned by ``degrees``."""
    a = math.radians(degrees)
    c, d = abs(math.cos(a)), abs(math.sin(a))
    box = _box(cx, cy, half * c + wide * d, half * d + wide * c)
    x, y = _x[box] - cx, _y[box] - cy
    u, v = x * math.cos(a) + y * math.sin(a), y * math.cos(a) - x * math.sin(a)
    return _paint(image, box, np.clip(half - np.abs(u) + 0.5, 0, 1) * np.clip(wide - np.abs(v) + 0.5, 0, 1), colour)


#: Clips that one task draws: its rasters are one batch of Arrow's, some 55 MB for FRAMES frames.
CLIPS_A_TASK = 64
#: Clips that are handed on together.
CLIPS_A_BATCH = 8


def _keys(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))


def _raster(image: np.ndarray) -> np.ndarray:
    """A picture's levels, of three channels or of grey, as whole numbers, with an opaque fourth channel."""
    whole = np.rint(image, out=_levels if image.shape == _levels.shape else None)
    raw = np.full((*image.shape[:2], 4), 255, np.uint8)
    raw[..., :3] = np.clip(whole, 0, 255, out=whole).astype(np.uint8).reshape(*image.shape[:2], -1)
    return raw


def _clips(spark, sf_dir: str, picture: Callable[[int, int], np.ndarray], frames: int = FRAMES) -> DataFrame:
    """Rows of CLIP: ``picture(k, frame)`` for the frames of each supplier's clip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for at in range(0, len(f), CLIPS_A_BATCH):
                drawn = ((k, i, _raster(picture(int(k), i))) for k in f["k"].iloc[at : at + CLIPS_A_BATCH] for i in range(frames))
                yield pd.DataFrame([(k, i, im.shape[1], im.shape[0], im.tobytes()) for k, i, im in drawn], columns=["clip_id", "frame", "w", "h", "rgba"])

    keys = _keys(spark, sf_dir)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys.count() / CLIPS_A_TASK))
    return keys.repartition(tasks, "k").mapInPandas(run, CLIP)


def _step(c: Column, step: float) -> Column:
    return (F.floor(c / step + 0.5) * step + 0.0).cast("double")


def rest_balls(spark, sf_dir):
    """The ball before it is struck; what moves across the clip leaves no trace in its still."""

    def picture(k: int, i: int) -> np.ndarray:
        image = disc(_blank(), 60 + k % 50, 40 + k % 37, 8, BRIGHT)
        return bar(image, 30 + 45 * i, 140, 20, 18, 10, BRIGHT)

    found = heads.balls_at_rest(_clips(spark, sf_dir, picture))
    return found.select("clip_id", "rank", _step(F.col("x"), 1).alias("x"), _step(F.col("y"), 1).alias("y"))


def _mallet(k: int, i: int) -> tuple[float, float]:
    return 70 + k % 40 + 3 * i, 90 + k % 23


def head_places(spark, sf_dir):
    """A head of two prongs on a shaft, in every frame one head."""

    def picture(k: int, i: int) -> np.ndarray:
        cx, cy = _mallet(k, i)
        image = bar(_blank(), cx, cy - 60, 90, 55, 2, BRIGHT)
        for side in (-1, 1):
            bar(image, cx + side * 22, cy, 0, 9, 17, BRIGHT)
        return image

    rasters = _clips(spark, sf_dir, picture)
    stills = _clips(spark, sf_dir, lambda k, i: _blank(), 1).drop("frame")
    balls = _keys(spark, sf_dir).select(F.col("k").alias("clip_id"), F.lit(150.0).alias("ball_x"), F.lit(150.0).alias("ball_y"), F.lit(20.0).alias("ball_d"), F.lit(HEAD_MM / WANT).alias("mm_per_px"))
    best, _ = heads.find_heads(rasters, balls, stills, places=balls.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame")))  # of keys, as rasters and stills would be drawn twice
    return best.select("clip_id", "frame", _step(F.col("x"), 1).alias("x"), _step(F.col("y"), 1).alias("y"))


def _head(k: int, i: int) -> np.ndarray:
    return bar(_blank(), 120 + k % 9, 90 + k % 7, (k % 31 - 15) * 0.2, 30, 14, BRIGHT)


def head_faces(spark, sf_dir):
    """The direction of a head's face between pixels, to a fifth of a degree."""
    seen = _clips(spark, sf_dir, _head, 1).withColumns({"hx": 120.0 + F.col("clip_id") % 9, "hy": 90.0 + F.col("clip_id") % 7, "ux": F.lit(0.0), "uy": F.lit(1.0), "want": F.lit(WANT)})
    return vision.face_lines(seen).select("clip_id", _step(F.degrees("frad"), 0.2).alias("degrees"))


def face_edges(spark, sf_dir):
    """The same by whole pixels, to two degrees."""
    seen = _clips(spark, sf_dir, lambda k, i: bar(_blank(), 120, 90, (k % 7 - 3) * 2.0, 30, 14, BRIGHT), 1)
    edges = pixels.face_edge(seen.withColumns({"hx": F.lit(120.0), "hy": F.lit(90.0), "ux": F.lit(0.0), "uy": F.lit(1.0)}))
    return edges.select("clip_id", _step(F.col("theta_deg"), 2.0).alias("degrees"))


def dark_blobs(spark, sf_dir):
    """The dark, long thing of a picture that holds more than a dozen heavier dark specks."""

    def picture(k: int, i: int) -> np.ndarray:
        image = bar(_blank(), 100 + k % 40, 80 + k % 30, 0, 16, 4, (70, 70, 70))
        for n in range(15):
            bar(image, 10 + 15 * n, 15, 0, 6, 6, (80, 80, 80))
        return image

    found = pixels.putter_blob(_clips(spark, sf_dir, picture, 1))
    return found.select("clip_id", _step(F.col("x"), 1).alias("x"), _step(F.col("y"), 1).alias("y"), F.col("n").cast("long").alias("n"))


def mat_lines(spark, sf_dir):
    """The printed line, past marks of its colour beside it, to a degree."""

    def picture(k: int, i: int) -> np.ndarray:
        image = bar(_blank(), 120, 90, 60 + k % 60, 110, 2, YELLOW)
        for n in range(5):
            bar(image, 20 + 5 * n, 20 + 33 * n, 10, 3, 2, YELLOW)
        return image

    return vision.find_lines(_clips(spark, sf_dir, picture, 1)).select("clip_id", _step(F.pmod(F.degrees("rad"), F.lit(180.0)), 1).alias("degrees"))


def template_tracks(spark, sf_dir):
    """A patch followed through a clip."""
    rasters = _clips(spark, sf_dir, lambda k, i: disc(disc(_blank(), 60 + k % 30 + 4 * i, 70 + 3 * i, 6, BRIGHT), 60 + k % 30 + 4 * i, 70 + 3 * i, 2.5, DARK))
    seeds = _keys(spark, sf_dir).select(F.col("k").alias("clip_id"), (60.0 + F.col("k") % 30).alias("sx"), F.lit(70.0).alias("sy"))  # of rasters, they would be drawn twice
    return pixels.track_template(rasters, seeds, size=17, reach=9).select("clip_id", "frame", _step(F.col("x"), 1).alias("x"), _step(F.col("y"), 1).alias("y"))


def still_sums(spark, sf_dir):
    """Sums of the medians over a clip's frames of all pixels, whose values follow from their places and the key."""

    def picture(k: int, i: int) -> np.ndarray:
        y, x = np.mgrid[:20, :30]
        return np.stack([(x * 7 + y * 13 + i * i * 31 + k * c) % 256 for c in (1, 3, 11)], axis=-1)

    still = pixels.background(_clips(spark, sf_dir, picture))
    return still.groupBy("clip_id").agg(*[F.sum(F.col(c)).cast("long").alias(c) for c in "rgb"], F.count(F.lit(1)).alias("pixels"))


@functools.lru_cache(maxsize=2)  # a clip's ground and body, for all its frames
def _blots(k: int) -> np.ndarray:
    """Soft-edged random blots."""
    draw = np.random.default_rng(k)
    return keypoints.shapes.blurred(np.kron(draw.integers(60, 200, (H // 5 + 10, W // 5 + 10)), np.ones((5, 5))), 1.2, 3)


def camera_shifts(spark, sf_dir):
    """Half pixels that the ground moves by, while a body of a third of the picture goes another way."""

    def picture(k: int, i: int) -> np.ndarray:
        dx, dy = (k % 7 - 3) * 0.5 * i, (k % 5 - 2) * 0.5 * i
        grey = vision.between(_blots(k), _x + 20 - dx, _y + 20 - dy)
        at = 30 + 12 * i
        grey[30:150, at : at + 120] = _blots(k + 500_000)[20:140, 20:140]
        return grey

    def still(k: int, i: int) -> np.ndarray:
        return _blots(k)[20 : 20 + H, 20 : 20 + W]

    found = keypoints.feature_shifts(_clips(spark, sf_dir, picture, 3), _clips(spark, sf_dir, still, 1).drop("frame"))
    return found.select("clip_id", "frame", _step(F.col("sx"), 0.5).alias("sx"), _step(F.col("sy"), 0.5).alias("sy"))


QUERIES = {f.__name__: f for f in (rest_balls, head_places, head_faces, face_edges, dark_blobs, mat_lines, template_tracks, still_sums, camera_shifts)}

_supplied = "SELECT s_suppkey::BIGINT AS k FROM supplier"
_frames = f"SELECT k, unnest(range({FRAMES}))::INT AS i FROM ({_supplied})"
ORACLE_SQL = {
    "rest_balls": f"SELECT k AS clip_id, 1::INT AS rank, (60 + k % 50)::DOUBLE AS x, (40 + k % 37)::DOUBLE AS y FROM ({_supplied})",
    "head_places": f"SELECT k AS clip_id, i AS frame, (70 + k % 40 + 3 * i)::DOUBLE AS x, (90 + k % 23)::DOUBLE AS y FROM ({_frames})",
    "head_faces": f"SELECT k AS clip_id, (k % 31 - 15) * 0.2::DOUBLE + 0.0 AS degrees FROM ({_supplied})",
    "face_edges": f"SELECT k AS clip_id, ((k % 7 - 3) * 2)::DOUBLE AS degrees FROM ({_supplied})",
    "dark_blobs": f"SELECT k AS clip_id, (100 + k % 40)::DOUBLE AS x, (80 + k % 30)::DOUBLE AS y, 31 * 7::BIGINT AS n FROM ({_supplied})",
    "mat_lines": f"SELECT k AS clip_id, (60 + k % 60)::DOUBLE AS degrees FROM ({_supplied})",
    "template_tracks": f"SELECT k AS clip_id, i AS frame, (60 + k % 30 + 4 * i)::DOUBLE AS x, (70 + 3 * i)::DOUBLE AS y FROM ({_frames})",
    "still_sums": f"""
        SELECT k AS clip_id, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, count(*) AS pixels FROM (
          SELECT k, x, y, floor(median((x * 7 + y * 13 + i * i * 31 + k) % 256)) AS r, floor(median((x * 7 + y * 13 + i * i * 31 + k * 3) % 256)) AS g,
                 floor(median((x * 7 + y * 13 + i * i * 31 + k * 11) % 256)) AS b
          FROM ({_frames}), (SELECT unnest(range(30)) AS x), (SELECT unnest(range(20)) AS y) GROUP BY k, x, y) GROUP BY k""",
    "camera_shifts": f"SELECT k AS clip_id, i AS frame, (k % 7 - 3) * 0.5::DOUBLE * i + 0.0 AS sx, (k % 5 - 2) * 0.5::DOUBLE * i + 0.0 AS sy FROM (SELECT k, unnest(range(3))::INT AS i FROM ({_supplied}))",
}
