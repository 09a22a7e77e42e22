"""Robust lines, sub-pixel face edges and camera shifts of rasters, one raster at a time within Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pixels, series

#: Fixed values (pixels at a width of 960, shares of the picture, grey levels).
LINE_PIXELS, LINE_AREA, LINE_SPAN, LINE_BAND, LINE_REFIT = 200, 120, 0.25, 12.0, 100
LEADING, FACE_REACH, EDGE_REACH, EDGE_STEP, EDGE_STEEP = 78, 0.55, 7.0, 0.5, 2.0
HUBER = 1.345
STEP_PART = 0.05  # of the steepest fall: what still belongs to its step


def _median(x: np.ndarray) -> float:
    """``np.median`` without its checks, which take longer than the rest for what a picture holds."""
    k = len(x) // 2
    parted = np.partition(x, (max(k - 1, 0), k))
    return float(parted[k] if len(x) % 2 else (parted[k - 1] + parted[k]) / 2)


def huber_line(x: np.ndarray, y: np.ndarray, rounds: int = 20) -> tuple[float, float, float]:
    """(direction in radians, middle x, middle y) of a total least squares line whose far points count less.

    A point beyond 1.345 robust deviations has the weight of that bound over its distance.
    """
    weight = np.ones(len(x))
    theta = cx = cy = 0.0
    for _ in range(rounds):
        total = weight.sum()
        cx, cy = (x * weight).sum() / total, (y * weight).sum() / total
        u, v = x - cx, y - cy
        before, theta = theta, 0.5 * np.arctan2(2 * (u * v * weight).sum(), ((u * u - v * v) * weight).sum())
        off = np.abs(v * np.cos(theta) - u * np.sin(theta))
        bound = HUBER * max(1.4826 * _median(off), 0.05)
        weight = np.where(off <= bound, 1.0, bound / np.maximum(off, 1e-12))
        if abs(theta - before) < 1e-9:
            break
    return float(theta), float(cx), float(cy)


def mat_line(rgba: np.ndarray, hue: float = 60, tol: float = 50) -> tuple[float, float, float] | None:
    """Direction and middle of the line of a hue in a raster, seeded by the longest blob and fitted to all pixels along it; hues are taken of colourful pixels only."""
    h, w = rgba.shape[:2]
    mask = pixels.where(rgba, lambda s, v: (s >= 50 / 255) & (v >= 50 / 255), hue, tol)
    if mask.sum() < LINE_PIXELS:
        return None
    found = pixels.moments(mask, pixels.value(rgba), max(1, int(np.ceil(LINE_AREA * w / 960))), corners=True)
    span = np.maximum(found["maxx"] - found["minx"], found["maxy"] - found["miny"]) + 1
    if not (span >= LINE_SPAN * max(w, h)).any():
        return None
    y, x = (a.astype(float) for a in np.nonzero(pixels.labels(mask, corners=True) == found["label"][span.idxmax()]))
    theta, cx, cy = huber_line(x, y)
    y, x = (a.astype(float) for a in np.nonzero(mask))
    near = np.abs((y - cy) * np.cos(theta) - (x - cx) * np.sin(theta)) < LINE_BAND * w / 960
    return huber_line(x[near], y[near]) if near.sum() >= LINE_REFIT else (theta, cx, cy)


def find_lines(rasters: DataFrame, hue: float = 60, tol: float = 50) -> DataFrame:
    """clip_id, frame, rad, lx, ly: the mat's line in each raster, by ``mat_line``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = ((r.clip_id, r.frame, mat_line(np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4), hue, tol)) for r in f.itertuples())
            yield pd.DataFrame([(k, i, *at) for k, i, at in found if at], columns=["clip_id", "frame", "rad", "lx", "ly"])

    return rasters.select("clip_id", "frame", "w", "h", "rgba").mapInPandas(run, "clip_id long, frame int, rad double, lx double, ly double")


def between(grey: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Grey levels between pixels, by the nearest four; the border goes on outside."""
    x, y = np.clip(x, 0, grey.shape[1] - 1.001), np.clip(y, 0, grey.shape[0] - 1.001)
    i, j = x.astype(int), y.astype(int)
    top = grey[j, i] + (grey[j, i + 1] - grey[j, i]) * (x - i)
    low = grey[j + 1, i] + (grey[j + 1, i + 1] - grey[j + 1, i]) * (x - i)
    return top + (low - top) * (y - j)


def step_places(profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of evenly spaced grey levels, where the one step down lies (in samples, between them) and how steep it is at most.

    The place is the centre of gravity of the fall about its steepest sample, which for a step that is blurred alike to both
    sides is its middle, however wide the blur; ripples that are not part of that fall do not count.
    """
    fall = np.maximum(profiles[:, :-1] - profiles[:, 1:], 0.0)
    peak, top = fall.argmax(axis=1)[:, None], fall.max(axis=1)
    part = fall >= STEP_PART * top[:, None]  # more would cut the rim's foot off, and by where it lies between pixels
    at = np.arange(fall.shape[1])
    gap = np.where(part, -1, at)
    after = np.where(~part, at, fall.shape[1])
    left = np.where(at <= peak, gap, -1).max(axis=1)[:, None]
    right = np.where(at >= peak, after, fall.shape[1]).min(axis=1)[:, None]
    share = np.where((at > left) & (at < right), fall, 0.0)
    return (share * (at + 0.5)).sum(axis=1) / np.maximum(share.sum(axis=1), 1e-12), top


def face_line(grey: np.ndarray, outline: tuple[np.ndarray, np.ndarray], head: tuple[float, float], way: tuple[float, float], want: float) -> tuple[float, float, float, float, int] | None:
    """(direction, x, y, rms, points) of a bright head's edge on the side of ``way`` (a unit vector), found between pixels.

    Seen along ``way``, the outline's foremost points give a first edge. Brightness is then read along ``way`` through it, one profile for
    each pixel of the face; the middles of their steps are the edge, to which a line is fitted that far points hardly move. Where under
    eight profiles have a step, the outline's own line stands; with under ten foremost points there is no face.
    """
    turn = np.array([[way[0], way[1]], [-way[1], way[0]]])
    depth, along = turn @ (np.stack(outline) - np.array(head)[:, None])
    front = np.flatnonzero(depth >= np.quantile(depth, LEADING / 100)) if len(depth) else np.zeros(0, int)
    reach = FACE_REACH * want
    front = front[np.abs(along[front] - np.median(along[front])) <= reach] if len(front) else front
    if len(front) < 10:
        return None

    def line(t: np.ndarray, d: np.ndarray) -> tuple[float, float, float, float, int]:
        """A line through points along and in depth of the face, in the picture's own axes."""
        slant, t0, d0 = huber_line(t, d)
        off = (d - d0) * np.cos(slant) - (t - t0) * np.sin(slant)
        (ax, ay), (x, y) = turn.T @ np.array([np.sin(slant), np.cos(slant)]), turn.T @ np.array([d0, t0]) + np.array(head)
        return float((np.arctan2(ay, ax) + np.pi / 2) % np.pi - np.pi / 2), float(x), float(y), float(np.sqrt(np.mean(off**2))), len(t)

    slant, t0, d0 = huber_line(along[front], depth[front])
    t = np.arange(np.ceil(max(along[front].min(), t0 - reach)), min(along[front].max(), t0 + reach) + 1e-9)
    first = d0 + (t - t0) * np.tan(slant)
    d = first[:, None] + np.arange(-EDGE_REACH, EDGE_REACH + EDGE_STEP / 2, EDGE_STEP)
    px, py = np.einsum("ij,jkl->ikl", turn.T, np.stack([d, np.broadcast_to(t[:, None], d.shape)])) + np.array(head)[:, None, None]
    place, steep = step_places(between(grey, px, py))
    sharp = steep > EDGE_STEEP
    if sharp.sum() < 8:
        return line(along[front], depth[front])
    return line(t[sharp], (first + place * EDGE_STEP - EDGE_REACH)[sharp])


def face_lines(heads: DataFrame, v_min: float = 0.6) -> DataFrame:
    """clip_id, frame, frad, fx, fy, rms, n: the face of the bright head (hx, hy: a pixel of it; ux, uy: the ball's way; want: its width in pixels) of each raster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                rgba = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
                ids = pixels.labels(pixels.hsv(rgba)[2] >= v_min)
                inside = 0 <= int(r.hy) < r.h and 0 <= int(r.hx) < r.w and ids[int(r.hy), int(r.hx)]
                if not inside:
                    continue
                blob = np.pad(ids == inside, 1)
                rim = blob[1:-1, 1:-1] & ~(blob[:-2, 1:-1] & blob[2:, 1:-1] & blob[1:-1, :-2] & blob[1:-1, 2:])
                y, x = (a.astype(float) for a in np.nonzero(rim))
                if found := face_line(rgba[..., :3].mean(axis=2), (x, y), (x.mean(), y.mean()), (r.ux, r.uy), r.want):
                    out.append((r.clip_id, r.frame, *found))
            yield pd.DataFrame(out, columns=["clip_id", "frame", "frad", "fx", "fy", "rms", "n"])

    return heads.select("clip_id", "frame", "w", "h", "rgba", "hx", "hy", "ux", "uy", "want").mapInPandas(run, "clip_id long, frame int, frad double, fx double, fy double, rms double, n int")


def shift_between(still: np.ndarray, grey: np.ndarray) -> tuple[float, float] | None:
    """How far a picture has moved against another, by phase correlation with a parabola about the peak; None if nothing stands out."""
    cross = np.fft.rfft2(grey - grey.mean()) * np.conj(np.fft.rfft2(still - still.mean()))
    like = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-9), still.shape)
    y, x = np.unravel_index(int(like.argmax()), like.shape)
    if like[y, x] <= 8 * like.std():
        return None

    def between(a: float, b: float, c: float) -> float:
        curve = a - 2 * b + c
        return float(np.clip(0.5 * (a - c) / curve, -0.5, 0.5)) if abs(curve) > 1e-12 else 0.0

    h, w = like.shape
    sx, sy = x + between(like[y, x - 1], like[y, x], like[y, (x + 1) % w]), y + between(like[y - 1, x], like[y, x], like[(y + 1) % h, x])
    return (sx - w if x > w / 2 else sx), (sy - h if y > h / 2 else sy)


def camera_shift(rasters: DataFrame) -> DataFrame:
    """clip_id, frame, sx, sy: each raster's shift against its clip's first one; where none is found the last one holds, at first 0.

    A moving thing that is a small part of a picture's texture does not carry the peak; for large ones see ``keypoints.feature_shifts``. The
    first raster goes once with every chunk of frames, not with each of them.
    """
    first = rasters.groupBy("clip_id").agg(F.min_by(F.struct("w", "h", "rgba"), "frame").alias("still")).select("clip_id", "still.*")

    def each(r, still: np.ndarray) -> list[tuple]:
        now = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
        return [(r.clip_id, r.frame, *(shift_between(*(x[..., :3].mean(axis=2) for x in (still, now))) or (None, None)))]

    moved = pixels.with_still(rasters, first, each, "clip_id long, frame int, mx double, my double")
    held = series.carry_last(series.carry_last(moved, ["clip_id"], "frame", F.col("mx"), "sx"), ["clip_id"], "frame", F.col("my"), "sy")
    return held.select("clip_id", "frame", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sx", "sy")])


def smooth_track(track: DataFrame, by: list[str], at: str, x: str, y: str, half: int = 4, floor: float = 6.0) -> DataFrame:
    """Rows of a track that lie within max(floor, 3 median distances) of its rolling median, with smooth_x and smooth_y: the median over what is kept.

    Tracks of under 5 rows, or with under 5 left, keep all their rows and the first medians.
    """
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(at)
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(order.rowsBetween(-half, half))
    t = track.withColumns({"_n": F.count(F.lit(1)).over(whole), "_sx": middle(x), "_sy": middle(y)})
    t = t.withColumn("_off", F.sqrt(F.pow(F.col(x) - F.col("_sx"), 2.0) + F.pow(F.col(y) - F.col("_sy"), 2.0)))
    t = t.withColumn("_keep", F.col("_off") <= F.greatest(F.lit(floor), 3 * F.percentile("_off", F.lit(0.5)).over(whole)))
    t = t.withColumn("_left", F.count_if("_keep").over(whole)).withColumn("_all", (F.col("_n") < 5) | (F.col("_left") < 5))
    kept = t.where(F.col("_all") | F.col("_keep")).withColumns({"_tx": middle(x), "_ty": middle(y)})
    shown = lambda few, first, second: F.when(F.col("_n") < 5, F.col(few)).when(F.col("_all"), F.col(first)).otherwise(F.col(second))
    return kept.select(*track.columns, shown(x, "_sx", "_tx").alias("smooth_x"), shown(y, "_sy", "_ty").alias("smooth_y"))
