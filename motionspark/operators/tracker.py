"""From rasters to observations: blobs of each raster, a tracker over a clip's blobs, and second thoughts over the whole clip.

Blobs are found raster by raster, in parallel and without knowing what came before. What depends on earlier frames
(where to look, how large the ball has been, when a thing counts as lost) works on the blobs alone: a clip's sorted
rows stream through one task that holds a few numbers. A blob is in a search box if its middle is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..staging import written
from . import pixels, rules, series, shapes, tracking, vision
from .observations import BALL_MM
from .rules import AREA_GATE, SIZE_GATE

#: Fixed values of the search (pixels, frames, shares).
REACH, REACH_SPEED, MARGIN, BALL_MISSES, MARKER_MISSES, SIZE_KEPT, TRAVEL = 22.0, 1.7, 40.0, 6, 4, 0.8, 0.06
SCALES = (0.15, 8.0)
#: Pixels of the least head at a width of 640, half the length that a face is shown with.
HEAD_PIXELS, HALF_FACE = 2500, 20.0

BALL = "struct<cand_idx:int,x:double,y:double,n:int,fill:double,w:int,h:int>"
MARK = "struct<x:double,y:double,weight:double>"
SEEN = f"clip_id long, frame int, t double, balls array<{BALL}>, marks array<{MARK}>, line struct<rad:double,x:double,y:double>"


def ball_like(s: np.ndarray, v: np.ndarray, v_min: float = 0.55, s_max: float = 0.30) -> np.ndarray:
    return (v >= v_min) & (s <= s_max)


def marker_like(s: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (s >= 0.45) & (v >= 0.25)


def _seen(frames: Iterator[pd.DataFrame], hue: float, line: bool) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples():
            rgba = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
            v, balls = pixels.value(rgba), []
            for i, b in enumerate(pixels.components(pixels.where(rgba, ball_like), v, 6)):
                wide, high = int(b["maxx"] - b["minx"] + 1), int(b["maxy"] - b["miny"] + 1)
                balls.append({"cand_idx": i, "x": b["x"], "y": b["y"], "n": b["n"], "fill": b["n"] / (wide * high), "w": wide, "h": high})
            marks = [{"x": b["x"], "y": b["y"], "weight": b["weight"]} for b in pixels.components(pixels.where(rgba, marker_like, hue, 30), v, 4)]
            found = pixels.line_in(rgba) if line else None
            out.append((r.clip_id, r.frame, r.t, balls, marks, None if found is None else {"rad": found[0], "x": found[1], "y": found[2]}))
        yield pd.DataFrame(out, columns=["clip_id", "frame", "t", "balls", "marks", "line"])


def see(rasters: DataFrame, hue: float = 320, line: bool = False) -> DataFrame:
    """Rows of SEEN: all ball-like and marker-like blobs of each raster, heaviest first, and the mat's line if asked for."""
    return rasters.select("clip_id", "frame", "t", "w", "h", "rgba").mapInPandas(partial(_seen, hue=hue, line=line), SEEN)


class Tracker:
    """The ball and the two markers of one clip, frame after frame. ``state`` is plain numbers and can be stored as JSON."""

    def __init__(self, mat: tuple[float, float, float, float], h: list[float] | None = None, min_fill: float = 0.45, state: dict | None = None, quad: list[tuple[float, float]] | None = None):
        self.mat, self.h, self.min_fill, self.quad = mat, h, min_fill, quad
        pad = (mat[2] - mat[0]) * 0.35  # markers may lie beside the mat
        self.putter = (mat[0] - pad, mat[1] - pad * 0.4, mat[2] + pad, mat[3] + pad * 0.6)
        self.state = state or {"ball": None, "v": [0.0, 0.0], "miss": 0, "size": 0.0, "box": None, "lost": 0}

    def area(self, x: float, y: float) -> float:
        """Pixels that a ball covers at a place, by the mat's scale across."""
        across = lambda x: (self.h[0] * x + self.h[1] * y + self.h[2]) / (self.h[6] * x + self.h[7] * y + self.h[8])
        mm = abs(across(x + 1) - across(x))
        return math.pi / 4 * (BALL_MM / mm) ** 2 if mm > 0 else 0.0

    def on_mat(self, x: float, y: float) -> bool:
        """Whether a place lies on the mat's quadrilateral, its edges included: not on different sides of different edges."""
        if self.quad is None:
            return True
        off = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(self.quad, [*self.quad[1:], self.quad[0]])]
        return not (any(o > geometry.EDGE for o in off) and any(o < -geometry.EDGE for o in off))

    def first_ball(self, balls: list[dict], box: tuple[float, float, float, float]) -> dict | None:
        """The heaviest blob in a box that is as large as a ball there and fills its own box; others fall through."""
        low, high = 0.0, math.inf
        if self.h is not None:
            areas = [a for x in (box[0], box[2]) for y in (box[1], box[3]) if (a := self.area(x, y)) > 0]
            if areas:
                low, high = min(areas) * AREA_GATE[0], max(areas) * AREA_GATE[1]
        return next((b for b in balls if box[0] <= b["x"] <= box[2] and box[1] <= b["y"] <= box[3] and low <= b["n"] <= high and b["fill"] >= self.min_fill), None)

    def step(self, balls: list[dict], marks: list[dict]) -> tuple[dict | None, list[dict] | None]:
        s = self.state
        ball, near = None, False
        if s["ball"]:
            r = REACH + math.hypot(*s["v"]) * REACH_SPEED
            x, y = s["ball"][0] + s["v"][0], s["ball"][1] + s["v"][1]
            ball = self.first_ball(balls, (x - r, y - r, x + r, y + r))
            near = ball is not None
        if ball is None:
            ball = self.first_ball(balls, self.mat)
        if ball and not near and s["size"] and not SIZE_GATE[0] * s["size"] < ball["n"] < SIZE_GATE[1] * s["size"]:
            ball = None
        if ball and not (self.mat[0] <= ball["x"] <= self.mat[2] and self.mat[1] <= ball["y"] <= self.mat[3] and self.on_mat(ball["x"], ball["y"])):
            ball = None
        if ball:
            if s["ball"]:
                s["v"] = [ball["x"] - s["ball"][0], ball["y"] - s["ball"][1]]
            s["size"] = s["size"] * SIZE_KEPT + ball["n"] * (1 - SIZE_KEPT) if s["size"] else float(ball["n"])
            s["ball"], s["miss"] = [ball["x"], ball["y"]], 0
        else:
            s["miss"] += 1
            if s["miss"] > BALL_MISSES:  # the size outlives the place
                s["ball"], s["v"] = None, [0.0, 0.0]
        pair = None
        boxes = [self.putter] if s["box"] is None else [(s["box"][0] - MARGIN, s["box"][1] - MARGIN, s["box"][2] + MARGIN, s["box"][3] + MARGIN), self.putter]
        for box in boxes:
            inside = [m for m in marks if box[0] <= m["x"] <= box[2] and box[1] <= m["y"] <= box[3]]
            if len(inside) >= 2:
                pair = sorted(sorted(inside, key=lambda m: -m["weight"])[:2], key=lambda m: m["x"])
                break
        if pair:
            (a, b), s["lost"] = pair, 0
            s["box"] = [min(a["x"], b["x"]), min(a["y"], b["y"]), max(a["x"], b["x"]), max(a["y"], b["y"])]
        else:
            s["lost"] += 1
            if s["lost"] > MARKER_MISSES:
                s["box"] = None
        return ball, pair


TRACKED = "clip_id long, frame int, t double, bx double, by double, bn int, ax double, ay double, cx double, cy double"


def tracked_row(clip_id: int, frame: int, t: float, ball: dict | None, pair: list[dict] | None) -> tuple:
    a, b = pair or (None, None)
    return (clip_id, frame, t, *([ball["x"], ball["y"], ball["n"]] if ball else [None] * 3), *([a["x"], a["y"], b["x"], b["y"]] if pair else [None] * 4))


def _tracked(frames: Iterator[pd.DataFrame], **how) -> Iterator[pd.DataFrame]:
    clip, tracker = None, None
    for f in frames:
        out = []
        for r in f.itertuples():
            if r.clip_id != clip:
                clip, tracker = r.clip_id, Tracker(**how)
            out.append(tracked_row(r.clip_id, r.frame, r.t, *tracker.step(list(r.balls), list(r.marks))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")]).astype({"bn": "Int32"})


def track(seen: DataFrame, mat: tuple[float, float, float, float], h: list[float] | None = None, quad: list[tuple[float, float]] | None = None) -> DataFrame:
    """Rows of TRACKED: the tracker's ball and marker pair (left one first) of each frame, in pixels.

    ``mat``: the box (x0, y0, x1, y1) that the mat fills; ``h``: the homography from pixels to mm, None while
    the scale is unknown, which leaves the ball's size open; ``quad``: the mat's corners in order, where it fills less than its box.
    """
    rows = seen.select("clip_id", "frame", "t", "balls", "marks").repartition("clip_id").sortWithinPartitions("clip_id", "frame")
    return rows.mapInPandas(partial(_tracked, mat=mat, h=h, quad=quad), TRACKED)


def candidates(seen: DataFrame, mat: tuple[float, float, float, float], min_fill: float = 0.45, quad: list[tuple[float, float]] | None = None) -> DataFrame:
    """clip_id, frame, cand_idx, x, y, width (the shorter side): the ball-like blobs within the mat's box and, if given, its corners."""
    inside = (F.col("b.x").between(mat[0], mat[2])) & (F.col("b.y").between(mat[1], mat[3])) & (F.col("b.fill") >= min_fill)
    if quad is not None:
        inside = inside & geometry.point_in_quad(F.col("b.x"), F.col("b.y"), F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in quad]))
    return seen.select("clip_id", "frame", F.explode("balls").alias("b")).where(inside).select("clip_id", "frame", "b.cand_idx", "b.x", "b.y", F.least("b.w", "b.h").cast("double").alias("width"))


def resolved(tracked: DataFrame, cands: DataFrame, mat: tuple[float, float, float, float]) -> DataFrame:
    """``tracked`` with the ball rewritten by the one candidate track of the clip that left, and ``width``; clips without one keep theirs."""
    diagonal = math.hypot(mat[2] - mat[0], mat[3] - mat[1])
    ball = tracking.resolve_ball(cands, min_move=diagonal * TRAVEL).withColumnsRenamed({"x": "_x", "y": "_y"})
    sized = ball.join(cands.select("clip_id", "frame", F.col("x").alias("_x"), F.col("y").alias("_y"), "width"), ["clip_id", "frame", "_x", "_y"], "left").groupBy("clip_id", "frame", "_x", "_y").agg(F.max("width").alias("width"))
    found = ball.select("clip_id").distinct().withColumn("found", F.lit(True))
    j = tracked.join(found, "clip_id", "left").join(sized, ["clip_id", "frame"], "left")
    own = lambda new, old: F.when(F.col("found"), F.col(new)).otherwise(F.col(old))
    return j.select("clip_id", "frame", "t", own("_x", "bx").alias("bx"), own("_y", "by").alias("by"), "width", "ax", "ay", "cx", "cy", F.coalesce("found", F.lit(False)).alias("found"))


def finish(tracked: DataFrame, cands: DataFrame, mat: tuple[float, float, float, float], h: list[float], mat_width: float, scale_from_ball: bool = False) -> DataFrame:
    """Observations (k, frame, t, ball_x, ball_y, hx, hy, fx, fy) in mm, x = 0 in the middle of the mat.

    With ``scale_from_ball`` distances are scaled so that the clip's upper median of the ball's width is a ball's, if
    that takes a factor between 0.15 and 8; angles are as they were. Its column mat_mm is then how wide that makes the mat.
    """
    r = resolved(tracked, cands, mat)
    hom = F.array(*[F.lit(float(v)) for v in h])
    to = lambda x, y: geometry.apply_homography(hom, F.col(x), F.col(y))
    r = r.withColumns({"b": to("bx", "by"), "a": to("ax", "ay"), "c": to("cx", "cy")})
    factor = F.lit(1.0)
    if scale_from_ball:
        middle = r.where("width is not null").groupBy("clip_id").agg(F.avg("bx").alias("mx"), F.avg("by").alias("my"))
        across = F.abs(geometry.apply_homography(hom, F.col("mx") + 1, F.col("my"))["x"] - to("mx", "my")["x"])
        size = series.upper_median(r.where("found"), ["clip_id"], "width", "px").join(middle, "clip_id")
        k = BALL_MM / F.nullif(F.col("px") * across, F.lit(0.0))
        r = r.join(size.select("clip_id", F.when((k > SCALES[0]) & (k < SCALES[1]), k).alias("k_scale")), "clip_id", "left")
        factor = F.coalesce("k_scale", F.lit(1.0))
    mm = lambda e, shift=0.0: ((e - shift) * factor)
    both = lambda d: (F.col(f"a.{d}") + F.col(f"c.{d}")) / 2
    implied = [F.when(factor != 1.0, factor * mat_width).alias("mat_mm")] if scale_from_ball else []
    return r.select(
        F.col("clip_id").alias("k"), "frame", "t", mm(F.col("b.x"), mat_width / 2).alias("ball_x"), mm(F.col("b.y")).alias("ball_y"), mm(both("x"), mat_width / 2).alias("hx"), mm(both("y")).alias("hy"),
        mm(F.col("c.x") - F.col("a.x")).alias("fx"), mm(F.col("c.y") - F.col("a.y")).alias("fy"), *implied,
    )


FACES = "clip_id long, frame int, cand_idx int, side int, x double, y double, w double, ex double, ey double, erad double, rms double"


def _faces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples():
            rgba = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
            mask, grey = pixels.where(rgba, ball_like), rgba[..., :3].mean(axis=2)
            big = pixels.moments(mask, pixels.value(rgba), math.ceil(HEAD_PIXELS * (r.w / 640) ** 2))
            ids = pixels.labels(mask) if len(big) else None
            for i, b in enumerate(big.itertuples()):
                y, x = np.nonzero((ids == b.label) & ~shapes.eroded(ids == b.label, 3))
                wide = max(b.maxx - b.minx, b.maxy - b.miny) + 1
                for side in (1, -1):
                    way = (side * math.cos(r.rad), side * math.sin(r.rad))
                    across = np.ptp((y - b.y) * way[0] - (x - b.x) * way[1]) + 1
                    if found := vision.face_line(grey, (x.astype(float), y.astype(float)), (b.x, b.y), way, float(across)):
                        out.append((r.clip_id, r.frame, i, side, b.x, b.y, float(min(across, wide)), found[1], found[2], found[0], found[3]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FACES.split(", ")])


def face_hypotheses(rasters: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of FACES: for every bright blob that may be a head both of its edges across the mat's line, ahead of (side 1) and behind it (-1).

    Which of them is the face is not known before the ball has gone, so both are kept. Rasters without a line have none.
    """
    return rasters.select("clip_id", "frame", "w", "h", "rgba").join(lines.select("clip_id", "frame", "rad"), ["clip_id", "frame"]).mapInPandas(_faces, FACES)


def settled_faces(faces: DataFrame, scale: DataFrame, lines: DataFrame) -> DataFrame:
    """clip_id, frame, x, y, ex, ey, erad, rms: of each picture's hypotheses the edge on the side that the ball went to, of the blob that is nearest to a head's width.

    ``scale``: clip_id, mm_per_px, dx, dy (the ball's way).
    """
    ahead = F.when(F.col("dx") * F.cos("rad") + F.col("dy") * F.sin("rad") < 0, -1).otherwise(1)
    own = faces.join(scale, "clip_id").join(lines.select("clip_id", "frame", "rad"), ["clip_id", "frame"]).where(F.col("side") == ahead).withColumn("sticker", F.lit(False))
    best = rules.choose_face(own, ["clip_id", "frame"]).where("source = 'edge'").select("clip_id", "frame", "cand_idx")
    return own.join(best, ["clip_id", "frame", "cand_idx"]).select("clip_id", "frame", "x", "y", "ex", "ey", "erad", "rms")


def ball_ways(found: DataFrame) -> DataFrame:
    """clip_id, mm_per_px, dx, dy: the scale by the ball's width, and its way from first to last, of clips with four places of the ball beside a line."""
    lined = F.col("rad").isNotNull() & F.col("bx").isNotNull()
    way = found.where(lined).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("bx", "by"), "frame").alias("p"), F.max_by(F.struct("bx", "by"), "frame").alias("q")).where("n >= 4")
    return series.upper_median(found, ["clip_id"], "width", "px").join(way, "clip_id").select("clip_id", (BALL_MM / F.col("px")).alias("mm_per_px"), (F.col("q.bx") - F.col("p.bx")).alias("dx"), (F.col("q.by") - F.col("p.by")).alias("dy"))


def finish_top_down(tracked: DataFrame, cands: DataFrame, lines: DataFrame, w: int, h: int, edges: DataFrame | None = None, faces: DataFrame | None = None) -> DataFrame:
    """Observations (k, frame, t, ball_x, ball_y, hx, hy, fx, fy) in mm of a camera straight above, by the mat's line and the ball.

    ``lines``: clip_id, frame, rad, lx, ly. The line gives the direction and, across, the origin; the ball's width
    gives the scale and its way the sign. ``edges`` (clip_id, frame, x, y: the head, ex, ey, erad, rms) are fitted face
    edges; blurred ones (rms over 3) and frames without one fall back on the markers. ``faces`` (rows of FACES) are the
    hypotheses of a clip without markers, of which the ball's way picks the edges. Frames without a line have nothing.
    """
    r = resolved(tracked, cands, (0.0, 0.0, w - 1.0, h - 1.0)).where("found").join(lines, ["clip_id", "frame"], "left")
    scale = ball_ways(r)
    if faces is not None:
        scale = written(scale, "ways")
        edges = settled_faces(faces, scale, lines)
    r = r.join(scale, "clip_id")
    turn = F.when(F.col("dx") * F.cos("rad") + F.col("dy") * F.sin("rad") < 0, -1.0).otherwise(1.0)
    r = r.withColumns({"ux": turn * F.cos("rad"), "uy": turn * F.sin("rad")})
    c = F.col
    across = lambda x, y: ((x - c("lx")) * -c("uy") + (y - c("ly")) * c("ux")) * c("mm_per_px")
    along = lambda x, y: ((x - w / 2) * c("ux") + (y - h / 2) * c("uy")) * c("mm_per_px")
    ends = {"x1": c("ax"), "y1": c("ay"), "x2": c("cx"), "y2": c("cy")}
    head = {"mx": (c("ax") + c("cx")) / 2, "my": (c("ay") + c("cy")) / 2}
    if edges is not None:
        sharp = edges.where("rms <= 3").select("clip_id", "frame", c("x").alias("ehx"), c("y").alias("ehy"), "ex", "ey", "erad")
        r = r.join(sharp, ["clip_id", "frame"], "left")
        pick = lambda e, m: F.when(c("erad").isNotNull(), e).otherwise(m)
        ends = {"x1": pick(c("ex") - HALF_FACE * F.cos("erad"), ends["x1"]), "y1": pick(c("ey") - HALF_FACE * F.sin("erad"), ends["y1"]), "x2": pick(c("ex") + HALF_FACE * F.cos("erad"), ends["x2"]), "y2": pick(c("ey") + HALF_FACE * F.sin("erad"), ends["y2"])}
        head = {"mx": pick(c("ehx"), head["mx"]), "my": pick(c("ehy"), head["my"])}
    r = r.withColumns(ends | head)
    # Left of the line is negative across, so a face runs from left to right as seen along the ball's way.
    fx, fy = across(c("x2"), c("y2")) - across(c("x1"), c("y1")), along(c("x2"), c("y2")) - along(c("x1"), c("y1"))
    return r.select(c("clip_id").alias("k"), "frame", "t", across(c("bx"), c("by")).alias("ball_x"), along(c("bx"), c("by")).alias("ball_y"), across(c("mx"), c("my")).alias("hx"), along(c("mx"), c("my")).alias("hy"), fx.alias("fx"), fy.alias("fy"))
