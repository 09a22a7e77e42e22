"""Rasters drawn from observations: what a camera straight above the mat would see of a stroke with stickers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RASTERS = "clip_id long, frame int, t double, w int, h int, rgba binary"
MAT, BALL, STICKER, LINE = (31, 107, 57), (240, 240, 240), (230, 30, 163), (230, 220, 40)
BALL_MM, STICKER_MM = 42.7, 18.0  # diameters


def draw(points: list[tuple[float, float, float, tuple]], w: int, h: int, line: tuple[float, float] | None = None) -> np.ndarray:
    """An h x w x 4 raster with smooth-edged discs (x, y, radius, colour) over a mat, and a strip down it (x, half width)."""
    image = np.empty((h, w, 3))
    image[:] = MAT
    x = np.arange(w)
    if line:
        cover = np.clip(line[1] - np.abs(x - line[0]) + 0.5, 0, 1)[None, :, None]
        image = image * (1 - cover) + np.array(LINE) * cover
    for cx, cy, r, colour in points:
        a, b = max(0, int(cy - r - 2)), min(h, int(cy + r + 3))
        if a >= b:
            continue
        y = np.arange(a, b)[:, None]
        cover = np.clip(r - np.hypot(x - cx, y - cy) + 0.5, 0, 1)[..., None]
        image[a:b] = image[a:b] * (1 - cover) + np.array(colour) * cover
    return np.dstack([np.round(image).astype(np.uint8), np.full((h, w), 255, np.uint8)])


def _rendered(frames: Iterator[pd.DataFrame], w: int, h: int, scale: float, line: bool) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples():
            px = lambda x, y: (w / 2 + x * scale, y * scale)
            points = []
            if r.hx == r.hx and r.fx == r.fx:
                points += [(*px(r.hx + s * r.fx / 2, r.hy + s * r.fy / 2), STICKER_MM / 2 * scale, STICKER) for s in (-1, 1)]
            if r.ball_x == r.ball_x:
                points.append((*px(r.ball_x, r.ball_y), BALL_MM / 2 * scale, BALL))
            out.append((r.k, r.frame, r.t, w, h, draw(points, w, h, (w / 2, 5 * scale) if line else None).tobytes()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RASTERS.split(", ")])


def render(obs: DataFrame, w: int, h: int, scale: float, line: bool = False) -> DataFrame:
    """Rows of RASTERS from observations in mm (k, frame, t, ball_x, ball_y, hx, hy, fx, fy): ``scale`` pixels a mm, x = 0 in the middle.

    Frames are drawn in small batches, as each is a raster; a frame without a ball or head shows none.
    """
    rows = obs.select(F.col("k").cast("long").alias("k"), F.col("frame").cast("int").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("t", "ball_x", "ball_y", "hx", "hy", "fx", "fy")])
    return rows.mapInPandas(partial(_small, of=partial(_rendered, w=w, h=h, scale=scale, line=line)), RASTERS)


def _small(frames: Iterator[pd.DataFrame], of, rows: int = 64) -> Iterator[pd.DataFrame]:
    yield from of(f.iloc[i : i + rows] for f in frames for i in range(0, len(f), rows))
