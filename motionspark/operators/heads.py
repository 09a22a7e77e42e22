"""The ball at rest, and the head that strikes it, found by the shapes of what a camera sees.

A clip's still is the median of its frames, taken tile by tile. Boundary points, blobs, candidates and heads are rows; a
raster is looked at once, for its mask, and a clip's still travels once with every chunk of its frames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import dealt, written
from . import pixels, rules, series, shapes, vision

#: Brightness of a resting ball from bright to dim, areas at a width of 960, how round and how full it is.
LADDER = (215, 200, 185, 170, 155)
REST_AREA, REST_ROUND, REST_FULL, REST_FRAMES, REST_TOP = (60.0, 6000.0), 0.62, 0.60, 40, 6
#: What moves and is bright, and a head's parts as shares of its width.
MOVED, BRIGHT, JOIN, SHAFT, PART, TOGETHER, BALL_TO_HEAD = 24, 150, 5, 0.17, 0.12, 0.8, 2.6

#: Pixels that a blur reaches.
BLUR = 3

RESTS = "clip_id long, level int, cand int, x double, y double, d double, score double"


def opening(rasters: DataFrame, frames: int) -> DataFrame:
    """The first frames of each clip."""
    return series.top_k(rasters, ["clip_id"], [F.asc("frame")], frames).drop("rank")


REST_POINTS = f"clip_id long, w int, level int, {shapes.POINTS}"


def _rest_points(stills: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of REST_POINTS: the outlines of each still at each brightness of LADDER; a still is blurred once, where it is bright at all."""
    for f in stills:
        rows = []
        for r in f.itertuples():
            grey = shapes.grey(np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4))
            inner = shapes.box(grey > min(LADDER), 2 * BLUR)  # a blurred pixel is no brighter than the brightest that it reaches
            if inner[0].stop == 0:
                continue
            bright = np.round(shapes.blurred(grey[inner], half=BLUR))
            for level in LADDER:
                for blob, points in shapes.outlines(shapes.opened(bright > level, 3), REST_AREA[0] * (r.w / 960) ** 2):
                    rows += [(r.clip_id, r.w, level, blob, i, x + inner[1].start, y + inner[0].start) for i, (x, y) in enumerate(points)]
        if rows:
            yield pixels.table(rows, [c.split()[0] for c in REST_POINTS.split(", ")])


def _kept_apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each clip's candidates in order, those that no kept one lies within the radius of, down to the level that brings two."""
    clip, kept, done = None, [], None
    for rows in frames:
        out = []
        for i, r in enumerate(rows.itertuples()):
            if r.clip_id != clip:
                clip, kept, done = r.clip_id, [], None
            if done is not None and r.level != done:
                continue
            if all(math.hypot(r.x - x, r.y - y) >= r.d / 2 for x, y in kept):
                kept.append((r.x, r.y))
                out.append(i)
                done = r.level if len(kept) >= 2 else None
        yield rows.iloc[out]


def balls_at_rest(rasters: DataFrame, frames: int = REST_FRAMES, top: int = REST_TOP) -> DataFrame:
    """clip_id, rank, x, y, d, score: where a still ball may lie before it is struck, the roundest and fullest first.

    The still of the opening frames is cut at falling brightness; outlines that are round (by area and length) and full (by area
    and least enclosing circle) are candidates. A candidate whose middle lies within its own radius of one found before is the same; the
    first level that brings them to two is the last. Size does not rank: a printed ring may be larger and rounder than the ball.
    A clip without such outlines has no rows; all frames of a clip are of one size.
    """
    points = written(pixels.stills(opening(rasters, frames), None).mapInPandas(_rest_points, REST_POINTS), "points")  # read by both measures
    by = ["clip_id", "level", "blob"]
    found = shapes.measures(points, by).join(dealt(shapes.rounds(points, "clip_id long, w int, level int, blob int")), by)
    scale = F.pow(F.col("w") / 960.0, F.lit(2.0))
    circular, full = 4 * math.pi * F.col("area") / F.pow("length", F.lit(2.0)), F.col("area") / (math.pi * F.pow("radius", F.lit(2.0)) + 1e-6)
    gates = F.col("area").between(REST_AREA[0] * scale, REST_AREA[1] * scale) & (F.col("length") > 0) & (circular >= REST_ROUND) & (full >= REST_FULL)
    able = found.where(gates).select("clip_id", "level", F.col("blob").alias("cand"), F.col("cx").alias("x"), F.col("cy").alias("y"), (2 * F.col("radius")).alias("d"), (circular * full).alias("score"))
    apart = able.repartition("clip_id").sortWithinPartitions("clip_id", F.desc("level"), "cand").mapInPandas(_kept_apart, RESTS)
    return series.top_k(apart, ["clip_id"], [F.desc("score"), F.desc("level"), F.asc("cand")], top).select("clip_id", "rank", "x", "y", "d", "score")


def shifted(still: np.ndarray, sx: float, sy: float, inner: tuple[slice, slice] = np.s_[:, :]) -> np.ndarray:
    """A part of a grey still moved by (sx, sy) pixels; its border goes on."""
    if abs(sx) <= 0.3 and abs(sy) <= 0.3:
        return still[inner].astype(float)
    y, x = np.mgrid[: still.shape[0], : still.shape[1]][:, *inner].astype(float)
    return vision.between(np.pad(still.astype(float), 1, "edge"), x - sx + 1, y - sy + 1)


def head_mask(rgba: np.ndarray, still: np.ndarray | None, shift: tuple[float, float], want: float) -> np.ndarray:
    """What is bright and has moved against the grey still, gaps closed and what is thinner than a head taken off."""
    size, bright = max(3, round(want * SHAFT) | 1), 175 if still is None else BRIGHT
    top = np.maximum(np.maximum(rgba[..., 0], rgba[..., 1]), rgba[..., 2])
    inner = shapes.box(top > bright, size + 2 * JOIN)  # no pixel is brighter than its brightest channel, and beyond the margin nothing is closed or opened
    now = shapes.grey(rgba[inner])
    part = now > bright
    if still is not None:
        part &= np.abs(now - shifted(still, *shift, inner)) > MOVED
        part = shapes.closed(part, JOIN)
    mask = np.zeros(top.shape, bool)
    mask[inner] = shapes.opened(part, size)
    return mask


HEAD_POINTS = "clip_id long, frame int, blob int, at int, x int, y int"


def head_points(rasters: DataFrame, stills: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Rows of HEAD_POINTS: the outlines of what may be parts of a head.

    ``rasters``: with sx, sy. ``stills``: a row for each clip with a ball, its raster or null, and ``want``, a head's width in pixels. ``places`` as ``with_still`` has them.
    """
    last: list = [None, None]  # a still in four channels and in grey

    def each(r, still: np.ndarray | None, want: float) -> list[tuple]:
        if still is not last[0]:
            last[:] = still, None if still is None else shapes.grey(still)
        found = shapes.outlines(head_mask(np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4), last[1], (r.sx, r.sy), want))
        return [(r.clip_id, r.frame, blob, i, x, y) for blob, points in found for i, (x, y) in enumerate(points)]

    return pixels.with_still(rasters, stills, each, HEAD_POINTS, ("sx", "sy"), of_clip=("want",), places=places)


def put_together(parts: DataFrame) -> DataFrame:
    """clip_id, frame, blob, head: parts of one picture whose middles (cx, cy) lie within ``reach`` of each other, directly or through others, are one head, named by its least blob.

    A picture has no more parts than their least area leaves room for, so they meet in one small group.
    """

    def one(rows: dict[str, np.ndarray]) -> list[tuple]:
        order = np.argsort(rows["blob"], kind="stable")
        blob, x, y, head = rows["blob"][order], rows["cx"][order], rows["cy"][order], np.arange(len(order))
        near = np.hypot(x[:, None] - x, y[:, None] - y) <= rows["reach"][0]
        while True:
            least = np.where(near, head, len(head)).min(axis=1)
            if (least == head).all():
                return list(zip(rows["clip_id"], rows["frame"], blob, blob[head]))
            head = least

    return pixels.by_key(parts, ["clip_id", "frame"], one, "clip_id long, frame int, blob int, head int")


def find_heads(rasters: DataFrame, balls: DataFrame, stills: DataFrame, shifts: DataFrame | None = None, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Heads (clip_id, frame, head, x, y, area, score, want), one a picture at most, and the points of all heads' outlines (clip_id, frame, head, x, y).

    ``balls``: clip_id, ball_x, ball_y, ball_d and mm_per_px or null; ``shifts``: clip_id, frame, sx, sy, as the camera moved; ``places``: clip_id and frame of all rasters, which
    are read twice where it is not given. A mallet of two prongs falls into two parts, which are one head again; the hull of all its points is what its size is judged by.
    """
    want = F.coalesce(rules.HEAD_MM / F.col("mm_per_px"), F.col("ball_d") * BALL_TO_HEAD)
    of_clip = balls.select("clip_id", "ball_x", "ball_y", "ball_d", want.alias("want"))
    moved = rasters.join(dealt(shifts), ["clip_id", "frame"], "left") if shifts is not None else rasters.withColumns({"sx": F.lit(0.0), "sy": F.lit(0.0)})
    seen = moved.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("sx", "sy")})
    by = ["clip_id", "frame", "blob"]
    points = written(head_points(seen, of_clip.select("clip_id", "want").join(dealt(stills), "clip_id", "left"), places), "points")  # read by each step
    sized = shapes.measures(points, by).join(dealt(of_clip.select("clip_id", "want")), "clip_id").where(F.col("area") >= F.pow(F.col("want") * PART, 2.0))
    able = points.join(dealt(sized.select(*by, "want")), by)
    round_parts = shapes.rounds(able, "clip_id long, frame int, blob int, want double")
    heads = put_together(round_parts.select(*by, "cx", "cy", (F.col("want") * TOGETHER).alias("reach")))
    outline = able.join(dealt(heads), by).select("clip_id", "frame", "head", "x", "y")
    whole = shapes.rounds(outline, "clip_id long, frame int, head int").join(dealt(of_clip), "clip_id")
    size = lambda a, b: (F.col(b) - F.col(a) + 1).cast("double")
    blobs = whole.select("clip_id", "frame", F.col("head").alias("cand_idx"), F.col("cx").alias("x"), F.col("cy").alias("y"), size("minx", "maxx").alias("bw"), size("miny", "maxy").alias("bh"), F.col("hull_area").alias("area"), "ball_x", "ball_y", "ball_d", "want", (rules.HEAD_MM / F.col("want")).alias("mm_per_px"))
    best = rules.choose_head(blobs, ["clip_id", "frame"]).select("clip_id", "frame", F.col("cand_idx").alias("head"), "x", "y", "area", "score", "want")
    return best, outline
