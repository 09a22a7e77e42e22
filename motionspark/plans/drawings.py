"""From rasters to strokes as registered queries: one drawn clip of 324 frames for each region.

The oracles state the truth that was drawn in; measured values are held to the accuracy gates of the analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracker
from ..sources import rasters
from ..staging import written
from . import analysis, stroke_sql
from .dialect import Spark

#: Pixels, and pixels a mm; the mat fills the picture.
W, H, SCALE = 160, 640, 0.4
MAT = (0.0, 0.0, W - 1.0, H - 1.0)
HOMOGRAPHY = [1 / SCALE, 0.0, 0.0, 0.0, 1 / SCALE, 0.0, 0.0, 0.0, 1.0]
KEYS = "SELECT 8 * (r_regionkey + 1) AS k FROM {}"  # plain strokes


def drawn(spark: SparkSession, sf_dir: str, line: bool = False) -> DataFrame:
    d = Spark(sf_dir)
    obs = spark.sql(f"WITH {stroke_sql.observations(d, KEYS.format(d.table('region')))} SELECT * FROM obs")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rasters.render(obs.repartition(tasks, "k", "frame"), W, H, SCALE, line)


def raster_sightings(spark, sf_dir):
    """Ball-like and marker-like blobs of each raster."""
    return tracker.see(drawn(spark, sf_dir)).select("clip_id", "frame", F.size("balls").alias("balls"), F.size("marks").alias("marks"))


def raster_lines(spark, sf_dir):
    """The direction of the line printed down the mat, to whole degrees."""
    return tracker.see(drawn(spark, sf_dir, line=True), line=True).select("clip_id", "frame", F.pmod(F.round(F.degrees("line.rad")), F.lit(180.0)).alias("degrees"))


def raster_tracks(spark, sf_dir):
    """Whether the tracker's ball is within a pixel of the one that was drawn."""
    at = tracker.track(tracker.see(drawn(spark, sf_dir)), MAT, HOMOGRAPHY).alias("t")
    d = Spark(sf_dir)
    truth = spark.sql(f"WITH {stroke_sql.observations(d, KEYS.format(d.table('region')))} SELECT * FROM obs").alias("o")
    off = F.sqrt(F.pow(F.col("bx") - W / 2 - F.col("ball_x") * SCALE, F.lit(2.0)) + F.pow(F.col("by") - F.col("ball_y") * SCALE, F.lit(2.0)))
    return at.join(truth, (F.col("t.clip_id") == F.col("o.k")) & (F.col("t.frame") == F.col("o.frame"))).select("clip_id", "t.frame", (off < 1).alias("near"))


def raster_strokes(spark, sf_dir):
    """Which figures of each stroke, measured from its rasters alone, meet the accuracy gates."""
    seen = written(tracker.see(drawn(spark, sf_dir)), "seen")
    obs = tracker.finish(tracker.track(seen, MAT, HOMOGRAPHY), tracker.candidates(seen, MAT), MAT, HOMOGRAPHY, W / SCALE)
    r, k = analysis.stroke_record(written(obs, "tracked"), cheap=True), F.col("k")
    face, path, speed = (k % 41 - 20) / 10, (7 * k % 61 - 30) / 10, 1 + (k % 13) / 10
    gates = {
        "impact": F.abs(F.col("t0") - 0.9) < 1 / 240, "face": F.abs(F.col("face_deg") - face) < 0.3, "path": F.abs(F.col("path_deg") - path) < 0.4, "start_line": F.abs(F.col("start_line_deg") - face + 0.1) < 0.3, "rate": F.abs(F.col("face_rate") / -50 - 1) < 0.08,
        "speed": F.abs(F.col("ball_speed") / speed - 1) < 0.03, "tempo": F.abs(F.col("tempo_ratio") / 1.968 - 1) < 0.05, "length": F.abs(F.col("back_len") - 200) < 8,
    }
    return r.select(k.alias("clip_id"), *[g.alias(n) for n, g in gates.items()])


QUERIES = {f.__name__: f for f in (raster_sightings, raster_lines, raster_tracks, raster_strokes)}

_frames = "SELECT 8 * (r_regionkey + 1)::BIGINT AS clip_id, unnest(range(324))::INT AS frame FROM region"
ORACLE_SQL = {
    "raster_sightings": f"SELECT clip_id, frame, 1 AS balls, 2 AS marks FROM ({_frames})",
    "raster_lines": f"SELECT clip_id, frame, 90.0::DOUBLE AS degrees FROM ({_frames})",
    "raster_tracks": f"SELECT clip_id, frame, true AS near FROM ({_frames})",
    "raster_strokes": "SELECT 8 * (r_regionkey + 1)::BIGINT AS clip_id, " + ", ".join(f"true AS {g}" for g in ("impact", "face", "path", "start_line", "rate", "speed", "tempo", "length")) + " FROM region",
}
