"""From sightings in pixels to observations in mm on the mat.

Tables: clips (clip_id, w, h), times (clip_id, frame, t), tracks (clip_id, cand, frame, x, y), seeds (clip_id, cand,
d: the ball's diameter), lines (clip_id, frame, rad, lx, ly), shifts (clip_id, frame, sx, sy), heads (clip_id, frame,
x, y) and faces (clip_id, frame, fx, fy, frad, rms). Only the gate that depends on the last accepted head is
sequential; it streams each clip's sorted rows through one task with one row of state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import dealt, written
from . import series

#: Fixed values (mm, frames, shares).
BALL_MM, HEAD_MM = 42.7, 110.0
LEAST_TRACK, LEAST_PEAK, RETURNED = 8, 0.06, 0.6
FACE_RMS_MM = 2.5
LEAST_FRAMES = 8
#: Why a clip cannot be measured, in the order of the tests.
ERRORS = ("clip too short to analyse", "no still, ball-shaped object near the start", "no ball-shaped object travelled far enough to have been struck", "no target line found on the mat", "found the ball but never the putter head")


def timing(times: DataFrame, capture_fps: Column | None = None) -> DataFrame:
    """clip_id, frames, container_fps ((n - 1) / span, else 30), fps and scale_t, from the times of a clip's frames."""
    span = F.max("t") - F.min("t")
    container = F.when(span > 0, (F.count(F.lit(1)) - 1) / span).otherwise(30.0)
    per_clip = times.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), container.alias("container_fps"))
    fps = F.coalesce(F.nullif(capture_fps, F.lit(0.0)), F.col("container_fps")) if capture_fps is not None else F.col("container_fps")
    return per_clip.withColumn("fps", fps).withColumn("scale_t", F.col("container_fps") / F.col("fps"))


def movers(tracks: DataFrame, seeds: DataFrame, clips: DataFrame) -> DataFrame:
    """The ball of each clip: clip_id, cand, d, mm_per_px, dx, dy (its way) and tux, tuy (unit vector), seen.

    Of tracks with 8 sightings or more that went 6 % of the diagonal and ended at 60 % of their greatest
    distance or farther, the one that ends farthest from its start, the first of equals.
    """
    at = F.struct("x", "y")
    ends = tracks.groupBy("clip_id", "cand").agg(F.min_by(at, "frame").alias("a"), F.max_by(at, "frame").alias("b"), F.count(F.lit(1)).alias("seen"))
    far = F.sqrt(F.pow(F.col("x") - F.col("a.x"), 2.0) + F.pow(F.col("y") - F.col("a.y"), 2.0))
    peaks = tracks.join(dealt(ends), ["clip_id", "cand"]).groupBy("clip_id", "cand").agg(F.max(far).alias("peak"))
    way = ends.join(dealt(peaks), ["clip_id", "cand"]).join(dealt(clips), "clip_id").withColumns({"dx": F.col("b.x") - F.col("a.x"), "dy": F.col("b.y") - F.col("a.y")})
    way = way.withColumn("depart", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    fit = way.where((F.col("seen") >= LEAST_TRACK) & (F.col("peak") >= LEAST_PEAK * F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))) & (F.col("depart") >= RETURNED * F.col("peak")) & (F.col("depart") > 0))
    best = series.top_k(fit, ["clip_id"], [F.desc("depart"), F.asc("cand")], 1).join(dealt(seeds), ["clip_id", "cand"])
    return best.select("clip_id", "cand", "d", (BALL_MM / F.greatest(F.lit(1.0), F.col("d"))).alias("mm_per_px"), "dx", "dy", (F.col("dx") / F.col("depart")).alias("tux"), (F.col("dy") / F.col("depart")).alias("tuy"), "seen")


def mat_axes(framed: DataFrame) -> DataFrame:
    """Adds ux, uy: the line's direction, turned the way the ball goes (dx, dy)."""
    turn = F.when(F.col("dx") * F.cos("rad") + F.col("dy") * F.sin("rad") < 0, -1.0).otherwise(1.0)
    return framed.withColumns({"ux": turn * F.cos("rad"), "uy": turn * F.sin("rad")})


def to_mat(x: Column, y: Column) -> tuple[Column, Column]:
    """Mat coordinates of a pixel: across from the line, along from the middle of the image, freed of the camera's shift."""
    c = F.col
    across = ((x - c("lx")) * -c("uy") + (y - c("ly")) * c("ux")) * c("mm_per_px")
    along = ((x - c("sx") - c("w") / 2) * c("ux") + (y - c("sy") - c("h") / 2) * c("uy")) * c("mm_per_px")
    return across, along


def _accepted(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    clip, last, vx, vy = None, None, 0.0, 0.0
    for rows in frames:
        keep = []
        for i, (of, frame, x, y, mm, rms) in enumerate(zip(rows["clip_id"], rows["frame"], rows["x"], rows["y"], rows["mm_per_px"], rows["rms"])):
            if of != clip:
                clip, last, vx, vy = of, None, 0.0, 0.0
            gap = max(1, frame - last[0]) if last else 1
            if last and math.hypot(x - last[1] - vx * gap, y - last[2] - vy * gap) > HEAD_MM / mm * (0.7 + 0.25 * gap):
                continue
            if not rms * mm <= FACE_RMS_MM:  # a smeared edge, or none
                continue
            if last:
                vx, vy = 0.6 * ((x - last[1]) / gap) + 0.4 * vx, 0.6 * ((y - last[2]) / gap) + 0.4 * vy
            last = (frame, x, y)
            keep.append(i)
        yield rows.iloc[keep][columns]


def accepted_heads(sightings: DataFrame) -> DataFrame:
    """Rows (clip_id, frame, x, y, mm_per_px, rms, ...) whose head lies where the accepted ones before it lead and whose face is sharp.

    A head may lie head_width * (0.7 + 0.25 * gap) from where the smoothed velocity puts it. Only accepted
    rows move the state. A null rms is no face.
    """
    rows = sightings.repartition("clip_id").sortWithinPartitions("clip_id", "frame")
    return rows.mapInPandas(partial(_accepted, columns=sightings.columns), sightings.schema)


def contact_points(heads: DataFrame) -> DataFrame:
    """Accepted heads (clip_id, frame, x, y, fx, fy, frad, tux, tuy, d) with depth, and cx, cy: the point that meets the ball.

    The head is rigid, so the way from its middle to its face is one median a clip, and the normal is smoothed by
    doubled angles over 6 accepted rows either side.
    """
    towards = lambda rad: F.when(-F.sin(rad) * F.col("tux") + F.cos(rad) * F.col("tuy") < 0, -1.0).otherwise(1.0)
    turn = towards(F.col("frad"))
    step = (F.col("fx") - F.col("x")) * -F.sin("frad") * turn + (F.col("fy") - F.col("y")) * F.cos("frad") * turn
    near = Window.partitionBy("clip_id").orderBy("frame").rowsBetween(-6, 6)
    smooth = 0.5 * F.atan2(F.avg(F.sin(2 * F.col("frad"))).over(near), F.avg(F.cos(2 * F.col("frad"))).over(near))
    h = heads.withColumns({"step": step, "srad": smooth}).withColumn("depth", F.median("step").over(Window.partitionBy("clip_id")))
    turn = towards(F.col("srad"))
    reach = F.col("depth") + F.col("d") / 2
    return h.withColumns({"cx": F.col("x") - F.sin("srad") * turn * reach, "cy": F.col("y") + F.cos("srad") * turn * reach}).drop("step", "srad")


def observations(clips: DataFrame, times: DataFrame, tracks: DataFrame, seeds: DataFrame, lines: DataFrame, shifts: DataFrame, heads: DataFrame, faces: DataFrame) -> DataFrame:
    """One row a frame of each clip with a ball: clip_id, frame, t, ball_x, ball_y, hx, hy, fdx, fdy (face vector), angle (mod 180), all in mm or degrees.

    Faces and heads are those that pass the gate of ``accepted_heads``; heads are the points that meet the ball.
    """
    ball = movers(tracks, seeds, clips)
    framed = times.join(dealt(ball), "clip_id").join(dealt(clips), "clip_id").join(dealt(lines), ["clip_id", "frame"], "left").join(dealt(shifts), ["clip_id", "frame"], "left").fillna(0.0, ["sx", "sy"])
    own = tracks.select("clip_id", "cand", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    framed = mat_axes(framed.join(dealt(own), ["clip_id", "cand", "frame"], "left"))
    lined = F.col("rad").isNotNull()
    sightings = framed.where(lined & F.col("bx").isNotNull()).join(dealt(heads), ["clip_id", "frame"]).join(dealt(faces), ["clip_id", "frame"], "left")
    met = contact_points(accepted_heads(sightings.select("clip_id", "frame", "x", "y", "mm_per_px", "rms", "fx", "fy", "frad", "tux", "tuy", "d")))
    seen = framed.join(dealt(met.select("clip_id", "frame", "cx", "cy", "frad")), ["clip_id", "frame"], "left")
    (bx, by), (hx, hy) = to_mat(F.col("bx"), F.col("by")), to_mat(F.col("cx"), F.col("cy"))
    c = F.col
    out = seen.withColumns(
        {
            "ball_x": F.when(lined, bx), "ball_y": F.when(lined, by), "hx": hx, "hy": hy,
            "fdx": (F.cos("frad") * -c("uy") + F.sin("frad") * c("ux")) * 40.0 * c("mm_per_px"), "fdy": (F.cos("frad") * c("ux") + F.sin("frad") * c("uy")) * 40.0 * c("mm_per_px"),
        }
    )
    return out.withColumn("angle", F.pmod(F.degrees(F.atan2("fdy", "fdx")), F.lit(180.0))).select("clip_id", "frame", "t", "ball_x", "ball_y", "hx", "hy", "fdx", "fdy", "angle", lined.alias("lined"))


def clean_heads(obs: DataFrame) -> DataFrame:
    """Observations without heads and faces that cannot be real; adds gate: across, along, turned or null.

    Across the mat a stroke is bounded, so the whole clip judges; along it there is a speed limit from the
    last row kept; a face may not leave the circular median of the rows about it. Rows dropped by the first two
    have no vote in the third.
    """
    keyed = ["clip_id", "frame"]
    obs = written(obs, "observations")  # read by each gate
    headed = obs.where("hx is not null")
    bounded = written(series.across_outliers(headed, ["clip_id"], "hx"), "bounded")
    paced = series.speed_limit(bounded, ["clip_id"], "frame", "hy").select(*keyed, F.lit(True).alias("paced"))
    state = obs.join(dealt(bounded.select(*keyed, F.lit(True).alias("bounded"))), keyed, "left").join(dealt(paced), keyed, "left")
    state = state.withColumn("vote", F.when(F.col("paced"), F.col("angle")))
    state = series.circular_filter(state.withColumn("kept", F.col("vote")), ["clip_id"], "frame", "kept")
    gate = F.when(F.col("hx").isNull(), None).when(F.col("bounded").isNull(), "across").when(F.col("paced").isNull(), "along").when(F.col("vote").isNotNull() & F.col("kept").isNull(), "turned")
    held = lambda c: F.when(F.col("gate").isNull(), F.col(c)).alias(c)
    return state.withColumn("gate", gate).select(*keyed, "t", "ball_x", "ball_y", *[held(c) for c in ("hx", "hy", "fdx", "fdy", "angle")], "lined", "gate")


def clip_results(clips: DataFrame, times: DataFrame, tracks: DataFrame, seeds: DataFrame, cleaned: DataFrame, ball: DataFrame, capture: DataFrame) -> DataFrame:
    """One row a clip: error (or null), frames, container_fps, capture_fps, ball_d, mm_per_px and the counts of what was seen and dropped.

    ``ball``: movers; ``capture``: clip_id, rate. An error leaves the measures null.
    """
    seen = cleaned.groupBy("clip_id").agg(
        F.count_if("lined").alias("lines"), F.count("hx").alias("heads"), F.count_if(F.col("gate").isin("across", "along")).alias("heads_dropped"), F.count_if(F.col("gate") == "turned").alias("faces_dropped"), F.count("ball_x").alias("balls")
    )
    has_seed = seeds.select("clip_id").distinct().withColumn("seeded", F.lit(True))
    r = clips
    for figures in (timing(times), has_seed, ball, seen, capture):
        r = r.join(dealt(figures), "clip_id", "left")
    tests = (F.coalesce("frames", F.lit(0)) < LEAST_FRAMES, F.col("seeded").isNull(), F.col("cand").isNull(), F.col("lines") == 0, F.col("heads") == 0)
    r = r.withColumn("error", F.coalesce(*[F.when(test, text) for test, text in zip(tests, ERRORS)]))
    fine = lambda c, name: F.when(F.col("error").isNull(), c).alias(name)
    measures = {"capture_fps": F.coalesce("rate", "container_fps"), "ball_d": F.col("d"), "mm_per_px": F.col("mm_per_px"), "ball_frames": F.col("seen")} | {n: F.col(c) for n, c in {"line_frames": "lines", "head_frames": "heads", "heads_dropped": "heads_dropped", "faces_dropped": "faces_dropped"}.items()}
    return r.select("clip_id", "error", "frames", "container_fps", *[fine(c, n) for n, c in measures.items()])
