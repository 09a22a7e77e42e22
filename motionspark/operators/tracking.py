"""Tracking: the operators whose next step depends on what was accepted before, one task for each clip's rows.

Association is greedy and exclusive, so it is a recurrence over frames and runs as a grouped map by clip;
which track is the ball is then a plain aggregation.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import dealt
from .series import upper_median

#: Fixed values of the tracker (pixels, frames).
GATE, MIN_MOVE, MISSES, RETURNED = 26.0, 40.0, 6, 0.6


class Association:
    """Live tracks of one clip. ``step`` takes a frame's candidates in order and gives each a track."""

    def __init__(self, state: dict | None = None, gate: float = GATE):
        self.gate = gate
        state = state or {}
        self.live: list[list[float]] = state.get("live", [])  # id, x, y, vx, vy, misses
        self.made, self.frame = state.get("made", 0), state.get("frame", -1)

    def state(self) -> dict:
        return {"live": self.live, "made": self.made, "frame": self.frame}

    def step(self, points: list[tuple[float, float]]) -> list[int]:
        """Older tracks choose first, each the free candidate nearest to where its last step leads it."""
        given = [-1] * len(points)
        for track in self.live:
            _, x, y, vx, vy, _ = track
            free = [(math.hypot(px - x - vx, py - y - vy), i) for i, (px, py) in enumerate(points) if given[i] < 0]
            distance, i = min(free, default=(math.inf, -1))
            if i >= 0 and distance <= self.gate + math.hypot(vx, vy):
                px, py = points[i]
                given[i] = int(track[0])
                track[1:] = [px, py, px - x, py - y, 0]
            else:
                track[5] += 1
        self.live = [t for t in self.live if t[5] <= MISSES]
        for i, (px, py) in enumerate(points):
            if given[i] < 0:
                given[i] = self.made
                self.live.append([self.made, px, py, 0.0, 0.0, 0])
                self.made += 1
        self.frame += 1
        return given

    def run(self, rows: pd.DataFrame) -> list[int]:
        """Tracks of rows sorted by frame and index; frames without rows count as misses."""
        out: list[int] = []
        for frame, group in rows.groupby("frame", sort=True):
            while self.frame < frame - 1:
                self.step([])
            out += self.step(list(zip(group["x"], group["y"])))
        return out


def associate(candidates: DataFrame, gate: float = GATE) -> DataFrame:
    """Adds ``track`` to candidates (clip_id, frame, cand_idx, x, y)."""
    kind = ", ".join(f"{n} {t}" for n, t in candidates.dtypes) + ", track int"

    def clip(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "cand_idx"])
        return rows.assign(track=Association(gate=gate).run(rows))

    return candidates.groupBy("clip_id").applyInPandas(clip, kind)


def ball_tracks(tracked: DataFrame, min_move: float = MIN_MOVE, least: int = 4) -> DataFrame:
    """The ball of each clip: clip_id, track, first, x0, y0, departure.

    Of tracks with at least ``least`` sightings that moved ``min_move`` and did not come back (they end
    at 60 % of their greatest distance or more) it is the one that ends farthest from its start.
    """
    start = F.min_by(F.struct("x", "y"), "frame").alias("start")
    spans = tracked.groupBy("clip_id", "track").agg(start, F.max_by(F.struct("x", "y"), "frame").alias("end"), F.min("frame").alias("first"), F.count(F.lit(1)).alias("seen"))
    away = F.hypot(F.col("x") - F.col("start.x"), F.col("y") - F.col("start.y"))
    peaks = tracked.join(dealt(spans.select("clip_id", "track", "start")), ["clip_id", "track"]).groupBy("clip_id", "track").agg(F.max(away).alias("peak"))
    departure = F.hypot(F.col("end.x") - F.col("start.x"), F.col("end.y") - F.col("start.y"))
    fit = spans.join(dealt(peaks), ["clip_id", "track"]).withColumn("departure", departure)
    fit = fit.where((F.col("seen") >= least) & (F.col("peak") >= min_move) & (F.col("departure") >= RETURNED * F.col("peak")))
    best = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("departure"), F.asc("track")))
    return fit.withColumn("_r", best).where("_r = 1").select("clip_id", "track", "first", F.col("start.x").alias("x0"), F.col("start.y").alias("y0"), "departure")


def resolve_ball(candidates: DataFrame, gate: float = GATE, min_move: float = MIN_MOVE) -> DataFrame:
    """clip_id, frame, x, y of the ball: its track, and before it the candidates nearest to its start.

    The frames before are taken backwards from the first sighting until one has nothing within the gate.
    """
    tracked = associate(candidates, gate)
    ball = ball_tracks(tracked, min_move)
    own = tracked.join(dealt(ball), ["clip_id", "track"]).select("clip_id", "frame", "x", "y")
    away = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    before = candidates.join(dealt(ball), "clip_id").where(F.col("frame") < F.col("first")).withColumn("_d", away)
    nearest = before.groupBy("clip_id", "frame", "first").agg(F.min(F.struct("_d", "cand_idx", "x", "y")).alias("c")).where(F.col("c._d") <= gate)
    # Frames are unbroken back from the first sighting as long as they count down by one.
    back = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("frame")))
    still = nearest.withColumn("_back", back).where(F.col("first") - F.col("frame") == F.col("_back"))
    return own.unionByName(still.select("clip_id", "frame", "c.x", "c.y"))


def scale_from_ball(tracked: DataFrame, ball_mm: float = 42.7) -> DataFrame:
    """clip_id, scale: the ball's true width over the upper median of its measured ones, if within (0.15, 8)."""
    k = F.lit(ball_mm) / F.col("width")
    return upper_median(tracked, ["clip_id"], "width_mm", "width").select("clip_id", F.when((k > 0.15) & (k < 8), k).alias("scale"))
