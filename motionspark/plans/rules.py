"""The rules as registered queries on the driver's tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.formatting import rounded
from ..operators import observations as ob
from ..operators import rules, series, vision
from ..sources.mp4 import clip_timing
from . import pictures
from .analogues import EV, _table, events, r4
from .dialect import Duck


def axis_ranges(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", F.pmod(F.col("t") / 3600, F.lit(24.0)))
    g = e.groupBy("user_id").agg(rules.nice_range(F.col("value"), 30.0).alias("r"), *[f(c).alias(n) for n, f, c in (("vlo", F.min, "value"), ("vhi", F.max, "value"), ("hlo", F.min, "h"), ("hhi", F.max, "h"))])
    g = g.withColumn("k", rules.ticks(F.col("vlo"), F.col("vhi")))
    return g.select("user_id", rounded(F.col("r.lo")).alias("lo"), rounded(F.col("r.hi")).alias("hi"), "k.step", F.element_at("k.ticks", 1).alias("first_tick"), F.size("k.ticks").cast("long").alias("ticks"), rounded(rules.exaggeration(F.col("vlo"), F.col("vhi"), F.col("hlo"), F.col("hhi"))).alias("exaggeration"))


def aspect_warnings(spark, sf_dir):
    k = F.col("c_custkey").cast("double")
    wide, tall, lean = 100 + F.pmod(k * 7, F.lit(50.0)), 150 + F.pmod(k * 13, F.lit(900.0)), F.pmod(k, F.lit(9.0)) * 4
    zero = F.lit(0.0)
    w = rules.aspect_warning([(zero, zero), (wide, zero), (wide - lean, tall), (lean, tall)], F.lit(400.0), F.lit(2000.0))
    return _table(spark, sf_dir, "customer").select("c_custkey", w.alias("w")).select("c_custkey", rounded(F.col("w.seen")).alias("seen"), rounded(F.col("w.declared")).alias("declared"), "w.suggest_cm")


def calibrations(spark, sf_dir):
    """Mat corners seen through a known perspective: a mapped pixel must be the mat point it came from."""
    k = F.col("s_suppkey").cast("double")
    tilt = 0.0001 * (F.pmod(k, F.lit(5.0)) + 1)
    seen = lambda x, y: ((x * 0.8 + y * 0.05 + 40) / (1 + y * tilt), (y * 0.3 + x * 0.02 + 20) / (1 + y * tilt))
    corners = F.array(*[v for x, y in ((0.0, 0.0), (400.0, 0.0), (400.0, 3000.0), (0.0, 3000.0)) for v in seen(F.lit(x), F.lit(y))])
    h = rules.calibration(corners, F.lit(400.0), F.lit(3000.0))
    px, py = seen(F.pmod(k * 37, F.lit(400.0)), F.pmod(k * 91, F.lit(3000.0)))
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", h.alias("h"), px.alias("px"), py.alias("py"))
    s = s.select("s_suppkey", geometry.apply_homography(F.col("h"), F.col("px"), F.col("py")).alias("p"), geometry.apply_homography(geometry.invert3("h"), F.lit(200.0), F.lit(1000.0)).alias("back"))
    return s.select("s_suppkey", *[rounded(F.col(c), 3).alias(n) for c, n in (("p.x", "mat_x"), ("p.y", "mat_y"), ("back.x", "back_x"), ("back.y", "back_y"))])


def mode_choices(spark, sf_dir):
    k = F.col("c_custkey")
    choice = rules.mode_choice(k * 37 % 600, k % 3 == 0, k % 5 == 0, F.when(k % 7 == 0, "topdown").otherwise("corners"))
    return _table(spark, sf_dir, "customer").select("c_custkey", choice.alias("c")).groupBy("c.mode", "c.face").agg(F.count(F.lit(1)).alias("clips"))


H = (1.1, 0.02, 3.0, -0.01, 0.9, 5.0, 0.0001, 0.0002, 1.0)


def ball_areas(spark, sf_dir):
    h, q, p = F.array(*[F.lit(v) for v in H]), F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 1000
    g = rules.area_gate(h, q, p, q + 60, p + 40)
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", g.alias("g"), rules.size_ok(q, F.nullif(F.col("l_linenumber") * 10.0, F.lit(70.0))).alias("ok"))
    return rows.groupBy("l_returnflag").agg(rounded(F.avg("g.least"), 2).alias("least"), rounded(F.avg("g.most"), 2).alias("most"), F.count_if("ok").alias("sizes_ok"))


def bearings(spark, sf_dir):
    dx, dy = F.col("l_quantity").cast("double") - 25.5, F.col("l_discount").cast("double") * 100 - 4.5
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(geometry.bearing_deg(dx, dy), 3).alias("bearing"), rounded(geometry.face_angle(dx, dy), 3).alias("face"))


def arc_polylines(spark, sf_dir):
    days = events(spark, sf_dir).withColumn("d", F.pmod(F.col("t") / 86400, F.lit(1.0)))
    ends = days.groupBy("event_type").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return rules.polyline(series.fit_parabola(days, ["event_type"], F.col("d"), F.col("value")).join(ends, "event_type"), ["event_type"]).select("event_type", "i", rounded(F.col("along")).alias("along"), rounded(F.col("across"), 2).alias("across"))


def review_residuals(spark, sf_dir):
    """How far points lie from their key's parabola: median and 90th percentile, depth of the curve, share of the rejected in a window, spread before it."""
    days = events(spark, sf_dir).withColumn("d", F.pmod(F.col("t") / 86400, F.lit(1.0)))
    fit = series.fit_parabola(days, ["event_type"], F.col("d"), F.col("value"))
    r = days.join(fit, "event_type").withColumn("r", F.abs(F.col("value") - (F.col("a") + F.col("b") * F.col("d") + F.col("c") * F.col("d") * F.col("d"))))
    q = series.percentiles(r, ["event_type"], "r", {"mid": 0.5, "p90": 0.9})
    rejected = F.col("r") > F.greatest(F.lit(2.0), 2 * F.col("mid"))
    every = r.join(q, "event_type").groupBy("event_type").agg(F.first("mid").alias("mid"), F.first("p90").alias("p90"), F.count_if(rejected).alias("rejected"))
    # Only the first 130 rows of a key are told apart by their number, and each task keeps no more of them.
    early = series.top_k(r, ["event_type"], [F.asc("event_id")], 130).join(q, "event_type").withColumn("i", F.col("rank") - 1)
    start = F.when(F.col("i") < 60, F.col("value"))
    begun = early.groupBy("event_type").agg(F.count_if(rejected & (F.col("i") > 70)).alias("window"), F.stddev_pop(start).alias("sd"), (F.max(start) - F.min(start)).alias("range"))
    g = every.join(begun, "event_type").withColumn("near", F.col("window") / F.nullif(F.col("rejected"), F.lit(0)))
    curve = rules.polyline(fit.select("event_type", "a", "b", "c", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), ["event_type"], 400).groupBy("event_type").agg((F.max("across") - F.min("across")).alias("sagitta"))
    return g.join(curve, "event_type").select("event_type", "rejected", *[rounded(F.col(c), 3).alias(c) for c in ("mid", "p90", "near", "sd", "range", "sagitta")])


def smooth_tracks(spark, sf_dir):
    points = events(spark, sf_dir).withColumn("h", F.pmod(F.col("t") / 3600, F.lit(24.0)))
    kept = vision.smooth_track(points.select("user_id", "event_id", "ts", "value", "h"), ["user_id"], "ts", "value", "h")
    return kept.select("event_id", rounded(F.col("smooth_x")).alias("smooth_x"), rounded(F.col("smooth_y")).alias("smooth_y"))


def strike_frames(spark, sf_dir):
    p = pictures.pictures(spark, sf_dir)
    return rules.strike_frames(p["tracks"], ob.movers(p["tracks"], p["seeds"], p["clips"]))


def clip_summaries(spark, sf_dir):
    """Counts, the ball's first and last place and the range of face angles of each clip's observations."""
    s = ob.clean_heads(ob.observations(**pictures.pictures(spark, sf_dir)))
    ball = F.when(F.col("ball_x").isNotNull(), F.struct("ball_x", "ball_y"))
    g = s.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.count("ball_x").alias("balls"), F.count("angle").alias("faces"), F.min_by(ball, F.when(ball.isNotNull(), F.col("frame"))).alias("a"), F.max_by(ball, F.when(ball.isNotNull(), F.col("frame"))).alias("b"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    return g.select("clip_id", "frames", "balls", "faces", *[rounded(F.col(c), 2).alias(n) for c, n in (("a.ball_x", "first_x"), ("a.ball_y", "first_y"), ("b.ball_x", "last_x"), ("b.ball_y", "last_y"), ("low", "face_low"), ("high", "face_high"))])


def head_choices(spark, sf_dir):
    q, d, t = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    blobs = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("cand_idx"), (q * 6).alias("x"), (d * 2000).alias("y"), (20 + q * 2).alias("bw"), (30 + t * 1000).alias("bh"), ((20 + q * 2) * (30 + t * 1000) * (0.4 + d * 5)).alias("area"), F.lit(150.0).alias("ball_x"), F.lit(100.0).alias("ball_y"), F.lit(30.0).alias("ball_d"), F.lit(1.4).alias("mm_per_px"))
    return rules.choose_head(blobs, ["l_orderkey"]).select("l_orderkey", "cand_idx", rounded(F.col("score")).alias("score"))


def face_choices(spark, sf_dir):
    q, t = F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")
    cands = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("cand_idx"), (q * 3).alias("w"), F.when(F.col("l_linestatus") == "F", t * 60).alias("rms"), (F.col("l_returnflag") == "R").alias("sticker"), F.lit(1.4).alias("mm_per_px"))
    return rules.choose_face(cands, ["l_orderkey"])


def mutual_matches(spark, sf_dir):
    e = events(spark, sf_dir)
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "event_id", "value")
    return rules.mutual_nearest(side("click"), side("purchase"), ["user_id"], "value", "event_id").select("user_id", "event_id", "other")


def near_fragments(spark, sf_dir):
    points = events(spark, sf_dir).withColumn("h", F.pmod(F.col("t") / 3600, F.lit(24.0)))
    return rules.merge_near(points, ["user_id"], "event_id", "value", "h", 3.0).select("event_id", "fragment")


def ordered_dedupe(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.col("value"), F.lit(0.0).alias("zero"))
    return rules.first_of_each(e, ["user_id"], [F.asc("event_id")], "value", "zero", 8.0).select("event_id")


def unmatched(spark, sf_dir):
    """Customers without orders (anti join), and nations with customers but no suppliers (set difference)."""
    customers, orders, suppliers = (_table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    idle = customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("long").alias("key"))
    lone = customers.select("c_nationkey").subtract(suppliers.select("s_nationkey")).select(F.lit("nation").alias("kind"), F.col("c_nationkey").cast("long").alias("key"))
    return idle.unionByName(lone)


def unlabelled(spark, sf_dir):
    """Documents without a label (anti join), and users who clicked but met no error (set difference)."""
    documents, labels, e = (_table(spark, sf_dir, t) for t in ("documents", "labels", "events"))
    bare = documents.join(labels, "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("key"))
    did = lambda what: e.where(F.col("event_type") == what).select("user_id")
    lucky = did("click").subtract(did("error")).select(F.lit("user").alias("kind"), F.col("user_id").cast("long").alias("key"))
    return bare.unionByName(lucky)


def user_overviews(spark, sf_dir):
    """Distinct aggregates and times as text."""
    e = _table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), rules.iso_time(F.min("ts").cast("timestamp")).alias("first"), rules.iso_time(F.max("ts").cast("timestamp")).alias("last"))


def prefs(spark, sf_dir):
    """Preferences written as JSON and read again, a third of them cut off or without a field."""
    k = F.col("c_custkey")
    whole = F.to_json(F.struct(F.concat(F.lit("m"), (k % 4).cast("string")).alias("mode"), (k % 90).cast("double").alias("hue")))
    text = F.when(k % 6 == 0, F.lit("{broken")).when(k % 6 == 1, F.lit('{"mode": "own"}')).otherwise(whole)
    return _table(spark, sf_dir, "customer").select("c_custkey", rules.read_prefs(text, {"mode": "corners", "hue": 320.0}).alias("p")).select("c_custkey", "p.mode", "p.hue")


def clip_timings(spark, sf_dir):
    k = F.col("c_custkey")
    clips = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, 0).when(k % 3 == 1, 240).cast("double").alias("stated_fps"), F.when(k % 2 == 0, 30.0).otherwise(240.0).alias("container_fps"))
    return clip_timing(clips).groupBy("capture_fps", "time_scale", "stretched", "looks_rendered").agg(F.count(F.lit(1)).alias("clips"))


QUERIES = {f.__name__: f for f in (
    axis_ranges, aspect_warnings, calibrations, mode_choices, ball_areas, bearings, arc_polylines, review_residuals, smooth_tracks, strike_frames, clip_summaries, head_choices, face_choices, mutual_matches, near_fragments, ordered_dedupe, unmatched, unlabelled,
    user_overviews, prefs, clip_timings,
)}

_h = lambda x, y: f"((1.1::DOUBLE * ({x}) + 0.02::DOUBLE * ({y}) + 3) / (0.0001::DOUBLE * ({x}) + 0.0002::DOUBLE * ({y}) + 1))"
_area = lambda x, y: f"(pi() / 4 * (42.7::DOUBLE / abs({_h(f'{x} + 1', y)} - {_h(x, y)})) ** 2)"
_areas = ", ".join(_area(x, y) for x, y in (("q", "p"), ("q + 60", "p"), ("q", "p + 40"), ("q + 60", "p + 40")))
_powers = "count(*)::DOUBLE AS s0, sum(d) AS s1, sum(d ** 2) AS s2, sum(d ** 3) AS s3, sum(d ** 4) AS s4, sum(value) AS y0, sum(value * d) AS y1, sum(value * d ** 2) AS y2, min(d) AS lo, max(d) AS hi"
_fits = f"""{EV}, days AS (SELECT *, t / 86400 - floor(t / 86400) AS d FROM ev), p AS (SELECT event_type, {_powers} FROM days GROUP BY 1),
f AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM p),
fit AS (SELECT event_type, lo, hi, (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / det AS a,
  (s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / det AS b, (s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / det AS c FROM f)"""


def _r(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n}::DOUBLE + 0.5::DOUBLE) / 1e{n}::DOUBLE"


_nearest = lambda side, other: f"SELECT l.user_id, l.event_id AS own, r.event_id AS other FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_type = '{side}' AND r.event_type = '{other}' QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.value - r.value), r.value, r.event_id) = 1"

ORACLE_SQL = {
    "axis_ranges": f"""WITH {EV}, g AS (SELECT user_id, min(value) AS vlo, max(value) AS vhi, min(t / 3600 - floor(t / 3600 / 24) * 24) AS hlo, max(t / 3600 - floor(t / 3600 / 24) * 24) AS hhi FROM ev GROUP BY 1),
p AS (SELECT *, vlo - greatest(0.6, (vhi - vlo) * 0.15) AS a, vhi + greatest(0.6, (vhi - vlo) * 0.15) AS b FROM g), s AS (SELECT *, greatest(1, floor((b - a) / 5 + 0.5))::BIGINT AS step FROM p)
SELECT user_id, {r4("(vlo + vhi) / 2 - greatest(vhi - vlo, 30) * 1.18 / 2")} AS lo, {r4("(vlo + vhi) / 2 + greatest(vhi - vlo, 30) * 1.18 / 2")} AS hi, step, (ceil(a / step) * step)::BIGINT AS first_tick, (floor(b / step) - ceil(a / step) + 1)::BIGINT AS ticks,
  {r4("((hhi - hlo + 50) / 280) / (2 * greatest(30, (vhi - vlo) / 2 * 1.35) / 618)")} AS exaggeration FROM s""",
    "aspect_warnings": f"""WITH c AS (SELECT c_custkey, 100 + c_custkey * 7 % 50 AS wide, 150 + c_custkey * 13 % 900 AS tall, c_custkey % 9 * 4 AS lean FROM customer),
s AS (SELECT *, sqrt(lean ** 2 + tall ** 2) / ((wide + wide - 2 * lean) / 2) AS seen FROM c), w AS (SELECT *, wide / (wide - 2 * lean) <= 1.15 AND greatest(seen, 5) / least(seen, 5) > 1.35 AS bad FROM s)
SELECT c_custkey, CASE WHEN bad THEN {r4("seen")} END AS seen, CASE WHEN bad THEN 5.0::DOUBLE END AS declared, CASE WHEN bad THEN floor(400 * seen + 0.5) / 10 END AS suggest_cm FROM w""",
    "calibrations": f"""WITH s AS (SELECT s_suppkey, (s_suppkey * 37 % 400)::DOUBLE AS x, (s_suppkey * 91 % 3000)::DOUBLE AS y, 1 + 1000 * 0.0001::DOUBLE * (s_suppkey % 5 + 1) AS w FROM supplier)
SELECT s_suppkey, {_r("x", 3)} AS mat_x, {_r("y", 3)} AS mat_y, {_r("(200 * 0.8::DOUBLE + 1000 * 0.05::DOUBLE + 40) / w", 3)} AS back_x, {_r("(1000 * 0.3::DOUBLE + 200 * 0.02::DOUBLE + 20) / w", 3)} AS back_y FROM s""",
    "mode_choices": """WITH c AS (SELECT c_custkey * 37 % 600 > 300 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS turn, c_custkey % 3 = 0 AS marked, c_custkey % 7 = 0 AS td FROM customer)
SELECT CASE WHEN turn OR td THEN 'topdown' ELSE 'corners' END AS mode, CASE WHEN turn AND NOT marked THEN 'markerless' ELSE 'markers' END AS face, count(*) AS clips FROM c GROUP BY ALL""",
    "ball_areas": f"""WITH l AS (SELECT l_returnflag, l_quantity::DOUBLE AS q, l_discount::DOUBLE * 1000 AS p, l_linenumber * 10 AS usual FROM lineitem)
SELECT l_returnflag, {_r(f"avg(0.3 * least({_areas}))", 2)} AS least, {_r(f"avg(2.5 * greatest({_areas}))", 2)} AS most, count(*) FILTER (WHERE usual = 70 OR (q > usual * 0.4 AND q < usual * 2.5)) AS sizes_ok FROM l GROUP BY 1""",
    "bearings": f"""WITH l AS (SELECT *, l_quantity::DOUBLE - 25.5 AS dx, l_discount::DOUBLE * 100 - 4.5 AS dy FROM lineitem), a AS (SELECT *, degrees(atan2(dy, dx)) AS f FROM l)
SELECT l_orderkey, l_linenumber, {_r("degrees(atan2(dx, dy))", 3)} AS bearing, {_r("CASE WHEN f > 90 THEN f - 180 WHEN f <= -90 THEN f + 180 ELSE f END", 3)} AS face FROM a""",
    "arc_polylines": f"""WITH {_fits}, n AS (SELECT *, unnest(range(140))::INT AS i FROM fit), x AS (SELECT *, lo + (hi - lo) * i / 139 AS along FROM n)
SELECT event_type, i, {r4("along")} AS along, {_r("a + b * along + c * along * along", 2)} AS across FROM x""",
    "review_residuals": f"""WITH {_fits}, r AS (SELECT d.event_type, d.value, row_number() OVER (PARTITION BY d.event_type ORDER BY event_id) - 1 AS i, abs(value - (a + b * d + c * d * d)) AS r FROM days d JOIN fit f ON d.event_type = f.event_type),
q AS (SELECT event_type, quantile_cont(r, 0.5) AS mid, quantile_cont(r, 0.9) AS p90 FROM r GROUP BY 1),
g AS (SELECT r.event_type, max(mid) AS mid, max(p90) AS p90, count(*) FILTER (WHERE r > greatest(2, 2 * mid)) AS rejected, avg((i > 70 AND i < 130)::INT) FILTER (WHERE r > greatest(2, 2 * mid)) AS near, stddev_pop(value) FILTER (WHERE i < 60) AS sd, max(value) FILTER (WHERE i < 60) - min(value) FILTER (WHERE i < 60) AS range FROM r JOIN q ON r.event_type = q.event_type GROUP BY 1),
c AS (SELECT event_type, max(v) - min(v) AS sagitta FROM (SELECT event_type, a + b * x + c * x * x AS v FROM (SELECT *, unnest(range(400)) / 399.0::DOUBLE AS x FROM fit)) GROUP BY 1)
SELECT event_type, rejected, {", ".join(f"{_r(c, 3)} AS {c}" for c in ("mid", "p90", "near", "sd", "range", "sagitta"))} FROM g JOIN c USING (event_type)""",
    "smooth_tracks": f"""WITH {EV}, p AS (SELECT user_id, event_id, ts, value AS x, t / 3600 - floor(t / 3600 / 24) * 24 AS y, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
m AS (SELECT *, quantile_cont(x, 0.5) OVER w AS sx, quantile_cont(y, 0.5) OVER w AS sy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
o AS (SELECT *, sqrt((x - sx) ** 2 + (y - sy) ** 2) AS off FROM m), b AS (SELECT user_id, greatest(6, 3 * quantile_cont(off, 0.5)) AS bar, count(*) AS all_rows FROM o GROUP BY 1),
k AS (SELECT o.*, off <= bar AS keep, count(*) FILTER (WHERE off <= bar) OVER (PARTITION BY o.user_id) AS remain FROM o JOIN b ON o.user_id = b.user_id),
f AS (SELECT *, quantile_cont(x, 0.5) OVER w AS tx, quantile_cont(y, 0.5) OVER w AS ty FROM k WHERE keep OR n < 5 OR remain < 5 WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT event_id, {r4("CASE WHEN n < 5 THEN x WHEN remain < 5 THEN sx ELSE tx END")} AS smooth_x, {r4("CASE WHEN n < 5 THEN y WHEN remain < 5 THEN sy ELSE ty END")} AS smooth_y FROM f""",
    "strike_frames": f"""WITH {pictures.model(Duck())}, {pictures._movers}, own AS (SELECT t.*, m.d, first_value(x) OVER w AS xa, first_value(y) OVER w AS ya FROM tracks t JOIN movers m ON t.clip_id = m.clip_id AND t.cand = m.cand WINDOW w AS (PARTITION BY t.clip_id ORDER BY frame))
SELECT clip_id, coalesce(min(frame) FILTER (WHERE sqrt((x - xa) ** 2 + (y - ya) ** 2) > 1.2 * d), max(frame)) AS strike FROM own GROUP BY 1""",
    "clip_summaries": f"""WITH RECURSIVE {pictures.model(Duck())}, {pictures._series}
SELECT clip_id, count(*) AS frames, count(ball_x) AS balls, count(angle) FILTER (WHERE gate IS NULL) AS faces, {_r("arg_min(ball_x, frame)", 2)} AS first_x, {_r("arg_min(ball_y, frame)", 2)} AS first_y, {_r("arg_max(ball_x, frame)", 2)} AS last_x, {_r("arg_max(ball_y, frame)", 2)} AS last_y,
  {_r("min(angle) FILTER (WHERE gate IS NULL)", 2)} AS face_low, {_r("max(angle) FILTER (WHERE gate IS NULL)", 2)} AS face_high FROM gates GROUP BY 1""",
    "head_choices": f"""WITH b AS (SELECT l_orderkey, (l_linenumber * 1000000 + l_partkey)::BIGINT AS cand_idx, l_quantity::DOUBLE * 6 AS x, l_discount::DOUBLE * 2000 AS y, 20 + l_quantity::DOUBLE * 2 AS bw, 30 + l_tax::DOUBLE * 1000 AS bh, 0.4 + l_discount::DOUBLE * 5 AS solid, 110 / 1.4::DOUBLE AS want FROM lineitem),
s AS (SELECT *, bw * bh * solid AS area, sqrt((x - 150) ** 2 + (y - 100) ** 2) AS d FROM b),
g AS (SELECT *, area / greatest(1, bw * bh) * 1.6 - abs(least(bw, bh) - want * 0.62) / want - d / (want * 3.5) * 0.5 AS score FROM s WHERE area >= (want / 4) ** 2 AND greatest(bw, bh) BETWEEN want * 0.45 AND want * 3 AND d BETWEEN 27 AND want * 3.5)
SELECT l_orderkey, cand_idx, {r4("score")} AS score FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, cand_idx) = 1""",
    "face_choices": """WITH c AS (SELECT l_orderkey, (l_linenumber * 1000000 + l_partkey)::BIGINT AS i, l_quantity::DOUBLE * 3 AS w, CASE WHEN l_linestatus = 'F' THEN l_tax::DOUBLE * 60 END AS rms, l_returnflag = 'R' AS sticker, 110 / 1.4::DOUBLE AS want FROM lineitem),
b AS (SELECT * FROM c WHERE w BETWEEN want * 0.55 AND want * 1.7 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(w - want), i) = 1),
g AS (SELECT l_orderkey, bool_or(sticker) AS sticker FROM c GROUP BY 1)
SELECT l_orderkey, CASE WHEN rms <= 3 THEN i END AS cand_idx, CASE WHEN rms <= 3 THEN 'edge' WHEN g.sticker THEN 'sticker' END AS source FROM g LEFT JOIN b USING (l_orderkey)""",
    "mutual_matches": f"WITH e AS (SELECT user_id, event_id, value, event_type FROM events), a AS ({_nearest('click', 'purchase')}), b AS ({_nearest('purchase', 'click')}) SELECT a.user_id, a.own AS event_id, a.other FROM a JOIN b ON a.own = b.other AND a.other = b.own",
    "near_fragments": f"""WITH RECURSIVE {EV}, p AS (SELECT user_id, event_id, value AS x, t / 3600 - floor(t / 3600 / 24) * 24 AS y FROM ev),
l AS (SELECT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9),
r AS (SELECT event_id AS node, event_id AS seen FROM p UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node)
SELECT node AS event_id, min(seen) AS fragment FROM r GROUP BY 1""",
    "ordered_dedupe": """WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
k AS (SELECT user_id, i, event_id, [value] AS kept, true AS ok FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN list_min(list_transform(k.kept, lambda v: abs(v - n.value))) >= 8 THEN list_append(k.kept, n.value) ELSE k.kept END, list_min(list_transform(k.kept, lambda v: abs(v - n.value))) >= 8
  FROM k JOIN n ON n.user_id = k.user_id AND n.i = k.i + 1)
SELECT event_id FROM k WHERE ok""",
    "unmatched": "SELECT 'customer' AS kind, c_custkey::BIGINT AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'nation', c_nationkey::BIGINT FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    "unlabelled": "SELECT 'document' AS kind, doc_id::BIGINT AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL (SELECT 'user', user_id::BIGINT FROM events WHERE event_type = 'click' EXCEPT SELECT 'user', user_id FROM events WHERE event_type = 'error')",
    "user_overviews": "SELECT user_id, count(DISTINCT event_type) AS kinds, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS last FROM events GROUP BY 1",
    "prefs": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'corners' WHEN 1 THEN 'own' ELSE 'm' || (c_custkey % 4) END AS mode, CASE WHEN c_custkey % 6 < 2 THEN 320 ELSE c_custkey % 90 END::DOUBLE AS hue FROM customer",
    "clip_timings": """WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 30.0::DOUBLE ELSE 240.0::DOUBLE END AS box, c_custkey % 3 = 1 AS said FROM customer), t AS (SELECT box, CASE WHEN said THEN 240.0::DOUBLE ELSE box END AS cap FROM c)
SELECT cap AS capture_fps, box / cap AS time_scale, abs(box / cap - 1) > 0.02 AS stretched, box < 90 AS looks_rendered, count(*) AS clips FROM t GROUP BY ALL""",
}
