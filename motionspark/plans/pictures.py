"""From sightings to observations as registered queries, over pictures by an analytic model: one clip for each supplier key.

``k % 8`` picks a variant: 4 no line on the mat, 5 no head, 6 a ball that is only nudged, 7 too short; all have heads,
faces and lines that are missing or wrong in some frames. The oracles are DuckDB SQL written on their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import rounded
from ..operators import observations as ob
from ..operators import tracking
from ..staging import dealt, written
from . import analysis
from .dialect import Duck, Spark
from .dialect import rounded as sql_rounded


#: Clips that one task makes into rows: some 300,000 in most tables, three times as many sightings.
CLIPS_A_TASK = 2500


def model(d: Spark, keys: str = "") -> str:
    """CTEs of the tables that sightings come in, one clip for each s_suppkey of ``keys`` (suppliers by default)."""
    return f"""
base AS (SELECT s_suppkey AS clip_id, s_suppkey % 8 AS kind, radians(s_suppkey % 21 - 10) AS rad0, (s_suppkey % 5 - 2) * 1e0 AS face0 FROM {keys or d.table("supplier")}),
fr AS (SELECT clip_id, kind, rad0, face0, CAST(frame AS INT) AS frame, cos(rad0) AS ux, sin(rad0) AS uy, 2e-2 * frame AS sx, -1e-2 * frame AS sy FROM base {d.numbers(0, 119, "frame")} WHERE NOT (kind = 7 AND frame >= 6)),
clips AS (SELECT clip_id, 960e0 AS w, 540e0 AS h FROM base),
times AS (SELECT clip_id, frame, frame / 30e0 AS t FROM fr),
moved AS (SELECT *, -130e0 - 120e0 * sin(pi() * frame / 119e0) AS swing,
  CASE WHEN frame < 60 THEN -100e0 WHEN kind = 6 THEN -100e0 + least(8e0 * (frame - 60), 40e0) ELSE -100e0 + 8e0 * (frame - 60) - 1e-2 * (frame - 60) * (frame - 60) END AS roll FROM fr),
tracks AS (SELECT clip_id, 0 AS cand, frame, 200e0 + 3e-1 * (frame % 2) AS x, 100e0 AS y FROM fr
  UNION ALL SELECT clip_id, 1, frame, 480e0 + ux * swing + sx, 270e0 + uy * swing + sy FROM moved
  UNION ALL SELECT clip_id, 2, frame, 480e0 + ux * roll + sx, 270e0 + uy * roll + sy FROM moved WHERE frame % 17 <> 16),
seeds AS (SELECT clip_id, 0 AS cand, 33e0 AS d FROM base UNION ALL SELECT clip_id, 1, 28e0 FROM base UNION ALL SELECT clip_id, 2, 30e0 + clip_id % 3 FROM base),
lines AS (SELECT clip_id, frame, rad0 + CASE WHEN clip_id % 2 = 1 THEN pi() ELSE 0e0 END AS rad, 480e0 + sx + 3 * (frame % 7) * ux AS lx, 270e0 + sy + 3 * (frame % 7) * uy AS ly FROM fr WHERE kind <> 4 AND frame % 23 <> 9),
shifts AS (SELECT clip_id, frame, sx, sy FROM fr),
placed AS (SELECT *, CASE WHEN frame < 60 THEN -135e0 - 100e0 * sin(pi() * frame / 60e0) ELSE -135e0 + 6e0 * (frame - 60) END AS a0 FROM fr WHERE kind <> 5),
spread AS (SELECT *, a0 + CASE WHEN (frame + clip_id) % 59 = 7 THEN 50e0 ELSE 0e0 END AS a,
  (a0 + 135e0) * (a0 + 135e0) / 4e3 + CASE WHEN (frame + clip_id) % 37 = 0 THEN 130e0 WHEN (frame + clip_id) % 53 = 5 THEN 42e0 ELSE 0e0 END AS c FROM placed),
heads AS (SELECT clip_id, frame, 480e0 + ux * a - uy * c + sx AS x, 270e0 + uy * a + ux * c + sy AS y FROM spread),
edges AS (SELECT *, rad0 + pi() / 2e0 + radians(face0 + 5e-2 * (frame - 60) + 13e-3 + CASE WHEN (frame + clip_id) % 41 = 3 THEN 40e0 ELSE 0e0 END) AS frad FROM spread WHERE frame % 31 <> 4),
faces AS (SELECT clip_id, frame, 480e0 + ux * (a + 12e0) - uy * c + sx + cos(frad) * ((frame * 7) % 11 - 5) AS fx, 270e0 + uy * (a + 12e0) + ux * c + sy + sin(frad) * ((frame * 7) % 11 - 5) AS fy, frad,
  CASE WHEN (frame + clip_id) % 29 = 1 THEN 3e0 ELSE 5e-1 END AS rms FROM edges)"""


TABLES = ("clips", "times", "tracks", "seeds", "lines", "shifts", "heads", "faces")


def pictures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The model's tables.

    Keys are dealt before they become rows: they fill one small file, so a single task would make the rows of all clips, and hold them while it deals them on.
    """
    d = Spark(sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(spark.table(d.table("supplier")).count() / CLIPS_A_TASK))
    keys = f"(SELECT /*+ REPARTITION({tasks}, s_suppkey) */ s_suppkey FROM {d.table('supplier')})"
    return {t: spark.sql(f"WITH {model(d, keys)} SELECT * FROM {t}") for t in TABLES}


def picture_movers(spark, sf_dir):
    """The ball of each clip, its way and the scale."""
    p = pictures(spark, sf_dir)
    m = ob.movers(p["tracks"], p["seeds"], p["clips"])
    return m.select("clip_id", "cand", "seen", *[rounded(F.col(c)).alias(c) for c in ("mm_per_px", "tux", "tuy")])


def picture_tracks(spark, sf_dir):
    """The ball's places, found among all candidates of each frame by association alone."""
    cands = pictures(spark, sf_dir)["tracks"].withColumnRenamed("cand", "cand_idx")
    found = tracking.resolve_ball(cands, min_move=0.06 * math.hypot(960, 540))
    return found.select("clip_id", "frame", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"))


def picture_heads(spark, sf_dir):
    """The sightings of the head that pass the gate of continuity and sharpness; here all sightings, with or without a ball."""
    p = pictures(spark, sf_dir)
    rows = p["heads"].join(dealt(p["faces"].select("clip_id", "frame", "rms")), ["clip_id", "frame"], "left").withColumn("mm_per_px", F.lit(ob.BALL_MM / 30))
    return ob.accepted_heads(rows).select("clip_id", "frame")


def picture_series(spark, sf_dir):
    """Observations in mm after every gate, and which gate dropped a head."""
    s = ob.clean_heads(ob.observations(**pictures(spark, sf_dir)))
    return s.select("clip_id", "frame", "gate", *[rounded(F.col(c), 3).alias(c) for c in ("ball_x", "ball_y", "hx", "hy", "angle")])


def picture_results(spark, sf_dir):
    """What each clip gave, or why nothing: counts, scale and the capture rate that the ball's slowing implies."""
    p = pictures(spark, sf_dir)
    cleaned = written(ob.clean_heads(ob.observations(**p)), "cleaned")
    ball = ob.movers(p["tracks"], p["seeds"], p["clips"])
    rolled = cleaned.join(dealt(ob.timing(p["times"]).select("clip_id", "container_fps")), "clip_id").withColumnRenamed("clip_id", "k")
    rates = analysis.capture_rate(rolled).select(F.col("k").alias("clip_id"), "rate")
    r = ob.clip_results(p["clips"], p["times"], p["tracks"], p["seeds"], cleaned, ball, rates)
    return r.withColumns({"container_fps": rounded(F.col("container_fps"), 3), "mm_per_px": rounded(F.col("mm_per_px"))})


QUERIES = {f.__name__: f for f in (picture_movers, picture_tracks, picture_heads, picture_series, picture_results)}

_model = model(Duck())
_movers = """
spans AS (SELECT clip_id, cand, arg_min(x, frame) AS xa, arg_min(y, frame) AS ya, arg_max(x, frame) AS xb, arg_max(y, frame) AS yb, count(*) AS seen FROM tracks GROUP BY ALL),
tops AS (SELECT t.clip_id, t.cand, max(sqrt((x - xa) ** 2 + (y - ya) ** 2)) AS peak FROM tracks t JOIN spans s ON t.clip_id = s.clip_id AND t.cand = s.cand GROUP BY ALL),
movers AS (SELECT s.clip_id, s.cand, seen, d, 42.7 / greatest(1, d) AS mm, xb - xa AS dx, yb - ya AS dy, sqrt((xb - xa) ** 2 + (yb - ya) ** 2) AS far
  FROM spans s JOIN tops p ON s.clip_id = p.clip_id AND s.cand = p.cand JOIN seeds e ON s.clip_id = e.clip_id AND s.cand = e.cand
  WHERE seen >= 8 AND peak >= 0.06 * sqrt(960.0 ** 2 + 540.0 ** 2) AND sqrt((xb - xa) ** 2 + (yb - ya) ** 2) >= 0.6 * peak AND sqrt((xb - xa) ** 2 + (yb - ya) ** 2) > 0
  QUALIFY row_number() OVER (PARTITION BY s.clip_id ORDER BY far DESC, s.cand) = 1)"""


def _gate(rows: str) -> str:
    """Recursive CTE ``gated`` over numbered rows (clip_id, i, frame, x, y, mm, rms)."""
    gap = "(CASE WHEN g.lf IS NULL THEN 1 ELSE greatest(1, n.frame - g.lf) END)"
    near = f"(g.lf IS NULL OR sqrt((n.x - g.lx - g.vx * {gap}) ** 2 + (n.y - g.ly - g.vy * {gap}) ** 2) <= 110 / n.mm * (0.7 + 0.25 * {gap}))"
    ok = f"({near} AND coalesce(n.rms * n.mm <= 2.5, false))"
    keep = lambda new, old: f"CASE WHEN {ok} THEN {new} ELSE {old} END"
    speed = lambda p, v: keep(f"CASE WHEN g.lf IS NULL THEN 0e0 ELSE 0.6::DOUBLE * ((n.{p} - g.l{p}) / {gap}) + 0.4::DOUBLE * g.{v} END", f"g.{v}")
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS i FROM ({rows})),
gated AS (SELECT DISTINCT clip_id, 0::BIGINT AS i, NULL::INT AS frame, NULL::INT AS lf, 0e0 AS lx, 0e0 AS ly, 0e0 AS vx, 0e0 AS vy, false AS ok FROM numbered
  UNION ALL SELECT n.clip_id, n.i, n.frame, {keep("n.frame", "g.lf")}, {keep("n.x", "g.lx")}, {keep("n.y", "g.ly")}, {speed("x", "vx")}, {speed("y", "vy")}, {ok}
  FROM gated g JOIN numbered n ON n.clip_id = g.clip_id AND n.i = g.i + 1)"""


_flip = lambda rad: f"CASE WHEN -sin({rad}) * dx + cos({rad}) * dy < 0 THEN -1 ELSE 1 END"
_series = f"""{_movers},
axes AS (SELECT t.clip_id, t.frame, t.t, m.*EXCLUDE (clip_id), l.rad, l.lx, l.ly, s.sx, s.sy, b.x AS px, b.y AS py, CASE WHEN m.dx * cos(rad) + m.dy * sin(rad) < 0 THEN -1 ELSE 1 END AS way
  FROM times t JOIN movers m USING (clip_id) LEFT JOIN lines l USING (clip_id, frame) LEFT JOIN shifts s USING (clip_id, frame) LEFT JOIN tracks b ON b.clip_id = t.clip_id AND b.frame = t.frame AND b.cand = m.cand),
{_gate("SELECT h.clip_id, h.frame, h.x, h.y, a.mm, f.rms FROM heads h JOIN axes a USING (clip_id, frame) LEFT JOIN faces f USING (clip_id, frame) WHERE a.rad IS NOT NULL AND a.px IS NOT NULL")},
kept AS (SELECT g.clip_id, g.frame, h.x, h.y, f.fx, f.fy, f.frad, a.dx, a.dy, a.d FROM gated g JOIN heads h USING (clip_id, frame) JOIN faces f USING (clip_id, frame) JOIN axes a USING (clip_id, frame) WHERE ok),
depths AS (SELECT clip_id, median(((fx - x) * (-1 * sin(frad)) + (fy - y) * cos(frad)) * {_flip("frad")}) AS depth FROM kept GROUP BY 1),
smoothed AS (SELECT *, 0.5::DOUBLE * atan2(avg(sin(2 * frad)) OVER w, avg(cos(2 * frad)) OVER w) AS srad FROM kept WINDOW w AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
contacts AS (SELECT s.clip_id, frame, frad, x - sin(srad) * {_flip("srad")} * (depth + d / 2) AS cx, y + cos(srad) * {_flip("srad")} * (depth + d / 2) AS cy FROM smoothed s JOIN depths USING (clip_id)),
mats AS (SELECT a.clip_id, a.frame, a.t, rad IS NOT NULL AS lined,
  ((px - lx) * (-1 * sin(rad)) + (py - ly) * cos(rad)) * way * mm AS ball_x, ((px - sx - 480) * cos(rad) + (py - sy - 270) * sin(rad)) * way * mm AS ball_y,
  ((cx - lx) * (-1 * sin(rad)) + (cy - ly) * cos(rad)) * way * mm AS hx, ((cx - sx - 480) * cos(rad) + (cy - sy - 270) * sin(rad)) * way * mm AS hy,
  degrees(atan2(way * cos(frad - rad), way * sin(frad - rad))) AS turn FROM axes a LEFT JOIN contacts c USING (clip_id, frame)),
angled AS (SELECT * EXCLUDE (turn), CASE WHEN turn < 0 THEN turn + 180 WHEN turn >= 180 THEN turn - 180 ELSE turn END AS angle FROM mats),
sorted AS (SELECT clip_id, list_sort(list(hx)) AS v, count(hx) AS n FROM angled WHERE hx IS NOT NULL GROUP BY 1),
limits AS (SELECT clip_id, n, v[n // 2 + 1] AS mid, greatest(45, 4 * (v[floor(n * 0.75)::INT + 1] - v[floor(n * 0.25)::INT + 1])) AS tol FROM sorted),
inside AS (SELECT a.clip_id, frame, hy, row_number() OVER (PARTITION BY a.clip_id ORDER BY frame) AS i FROM angled a JOIN limits l USING (clip_id) WHERE hx IS NOT NULL AND NOT (n >= 8 AND abs(hx - mid) > tol)),
paced AS (SELECT clip_id, i, frame, frame AS lf, hy AS ly, true AS ok FROM inside WHERE i = 1
  UNION ALL SELECT n.clip_id, n.i, n.frame, CASE WHEN abs(n.hy - p.ly) <= 60 * (n.frame - p.lf) THEN n.frame ELSE p.lf END, CASE WHEN abs(n.hy - p.ly) <= 60 * (n.frame - p.lf) THEN n.hy ELSE p.ly END, abs(n.hy - p.ly) <= 60 * (n.frame - p.lf)
  FROM paced p JOIN inside n ON n.clip_id = p.clip_id AND n.i = p.i + 1),
voting AS (SELECT a.*, i.frame IS NOT NULL AS inb, coalesce(p.ok, false) AS pace, CASE WHEN p.ok THEN angle END AS vote FROM angled a LEFT JOIN inside i USING (clip_id, frame) LEFT JOIN paced p USING (clip_id, frame)),
ballots AS (SELECT *, list(vote) FILTER (WHERE vote IS NOT NULL) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS near FROM voting),
centres AS (SELECT *, list_transform(near, lambda c: list_sum(list_transform(near, lambda v: least(abs(v - c), 180 - abs(v - c))))) AS cost FROM ballots),
judged AS (SELECT *, near[list_position(cost, list_min(cost))] AS centre FROM centres),
gates AS (SELECT *, CASE WHEN hx IS NULL THEN NULL WHEN NOT inb THEN 'across' WHEN NOT pace THEN 'along' WHEN len(near) >= 4 AND least(abs(vote - centre), 180 - abs(vote - centre)) > 12 THEN 'turned' END AS gate FROM judged)"""

ORACLE_SQL = {
    "picture_movers": f"WITH {_model}, {_movers} SELECT clip_id, cand, seen, {sql_rounded('mm')} AS mm_per_px, {sql_rounded('dx / far')} AS tux, {sql_rounded('dy / far')} AS tuy FROM movers",
    "picture_tracks": f"WITH {_model} SELECT clip_id, t.frame, {sql_rounded('x', 3)} AS x, {sql_rounded('y', 3)} AS y FROM tracks t JOIN base USING (clip_id) WHERE cand = 2 AND kind < 6",
    "picture_heads": f"WITH RECURSIVE {_model}, {_gate('SELECT h.clip_id, h.frame, h.x, h.y, 42.7 / 30::DOUBLE AS mm, f.rms FROM heads h LEFT JOIN faces f USING (clip_id, frame)')} SELECT clip_id, frame FROM gated WHERE ok",
    "picture_series": f"""WITH RECURSIVE {_model}, {_series}
SELECT clip_id, frame, gate, {sql_rounded('ball_x', 3)} AS ball_x, {sql_rounded('ball_y', 3)} AS ball_y, {', '.join(f"CASE WHEN gate IS NULL THEN {sql_rounded(c, 3)} END AS {c}" for c in ('hx', 'hy', 'angle'))} FROM gates""",
    "picture_results": f"""WITH RECURSIVE {_model}, {_series},
spans_t AS (SELECT clip_id, count(*) AS frames, CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) ELSE 30 END AS container FROM times GROUP BY 1),
seen AS (SELECT clip_id, count(*) FILTER (WHERE lined) AS lines, count(*) FILTER (WHERE hx IS NOT NULL AND gate IS NULL) AS heads, count(*) FILTER (WHERE gate IN ('across', 'along')) AS hd, count(*) FILTER (WHERE gate = 'turned') AS fd FROM gates GROUP BY 1),
rolls AS (SELECT clip_id, t, sqrt(ball_x ** 2 + ball_y ** 2) AS y, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM gates WHERE ball_x IS NOT NULL),
halves AS (SELECT clip_id, t - avg(t) OVER (PARTITION BY clip_id) AS x, y FROM rolls WHERE n >= 12 AND i >= n // 2),
powers AS (SELECT clip_id, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS y0, sum(x * y) AS y1, sum(x ** 2 * y) AS y2 FROM halves GROUP BY 1),
curves AS (SELECT clip_id, abs(2 * (s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))) / 1000 AS c FROM powers),
rates AS (SELECT clip_id, r FROM curves JOIN spans_t USING (clip_id), (VALUES (30), (60), (120), (240)) AS v(r) WHERE r >= container - 1 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY abs(c * (r / container) ** 2 - 1.5), r) = 1),
told AS (SELECT c.clip_id, frames, container, m.cand, m.d, m.mm, m.seen, s.lines, s.heads, s.hd, s.fd, r.r,
  CASE WHEN frames < 8 THEN 'clip too short to analyse' WHEN m.cand IS NULL THEN 'no ball-shaped object travelled far enough to have been struck' WHEN lines = 0 THEN 'no target line found on the mat' WHEN heads = 0 THEN 'found the ball but never the putter head' END AS error
  FROM clips c LEFT JOIN spans_t USING (clip_id) LEFT JOIN movers m USING (clip_id) LEFT JOIN seen s USING (clip_id) LEFT JOIN rates r USING (clip_id))
SELECT clip_id, error, frames, {sql_rounded('container', 3)} AS container_fps, {', '.join(f"CASE WHEN error IS NULL THEN {v} END AS {n}" for n, v in {'capture_fps': 'coalesce(r::DOUBLE, container)', 'ball_d': 'd', 'mm_per_px': sql_rounded('mm'), 'ball_frames': 'seen', 'line_frames': 'lines', 'head_frames': 'heads', 'heads_dropped': 'hd', 'faces_dropped': 'fd'}.items())} FROM told""",
}
