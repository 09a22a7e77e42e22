"""The series operators on the driver's tables: events as sensor series keyed by user, lineitem as pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry, robust
from ..functions.formatting import rounded
from ..operators import series



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, t (seconds from the epoch of the data), value, event_type."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / F.lit(1e6)
    return _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", seconds.alias("t"), "value", "event_type")


EV = "ev AS (SELECT user_id, event_id, ts, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t, value, event_type FROM events)"


def r4(x: str) -> str:
    return f"floor(({x}) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE"


def session_stats_by_event_type(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("event_type").agg(robust.session_stats(F.col("value")).alias("s"))
    return s.select("event_type", rounded(F.col("s.mean")).alias("mean"), rounded(F.col("s.sd")).alias("sd"))


def upper_median_by_flag(spark, sf_dir):
    items, by = _table(spark, sf_dir, "lineitem"), ["l_returnflag"]
    prices = series.upper_median(items, by, "l_extendedprice", "price_median").withColumnRenamed("l_returnflag", "flag")
    return series.upper_median(items, by, "l_quantity", "upper_median").join(prices, F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag")


def percentile_interp(spark, sf_dir):
    found = series.percentiles(events(spark, sf_dir), ["event_type"], "value", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return found.select("event_type", *[rounded(F.col(c)).alias(c) for c in ("p5", "p50", "p95")])


def across_outliers(spark, sf_dir):
    return series.across_outliers(events(spark, sf_dir), ["user_id"], "value", floor=1.0, spread=1.5).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


def rolling_ols_slope(spark, sf_dir):
    hours = events(spark, sf_dir).withColumn("h", F.col("t") / 3600 - F.floor(F.col("t") / 3600 / 2400) * 2400)
    return series.rolling_slope(hours, ["user_id"], "ts", "h", "value").select("event_id", rounded(F.col("slope"), 3).alias("slope"))


def rolling_median_9(spark, sf_dir):
    return series.rolling_median(events(spark, sf_dir), ["user_id"], "ts", "value").select("event_id", rounded(F.col("median")).alias("median"))


def still_islands(spark, sf_dir):
    from pyspark.sql import Window

    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts")))
    return series.still_islands(events(spark, sf_dir), ["user_id"], "ts", step, 30.0)


def take_while_arc(spark, sf_dir):
    kept = series.take_while_arc(events(spark, sf_dir), ["user_id"], "ts", "event_id", "value", 60.0)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), rounded(F.max("arc"), 2).alias("arc"))


def asof_nearest(spark, sf_dir):
    e = events(spark, sf_dir)
    clicks, buys = e.where("event_type = 'click'").select("user_id", "event_id", "t"), e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("at"), F.col("event_id").alias("purchase"))
    return series.nearest(clicks, buys, ["user_id"], "t", "at", "purchase").select("event_id", "nearest_purchase")


def carry_last_good(spark, sf_dir):
    return series.carry_last(events(spark, sf_dir), ["user_id"], "ts", F.when(F.col("value") > 50, F.col("event_id")), "last_good").select("event_id", "last_good")


def unwrap_series(spark, sf_dir):
    folded = events(spark, sf_dir).withColumn("deg", geometry.fold_angle(F.col("value") * 7))
    return series.unwrap(folded, ["user_id"], "ts", "deg").select("event_id", rounded(F.col("deg")).alias("deg"), rounded(F.col("unwrapped"), 3).alias("unwrapped"))


def circular_mean(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("event_type").agg(rounded(robust.circular_mean(F.col("value") * 3.6, F.abs(F.col("value")) + 1), 3).alias("mean_deg"), rounded(robust.circular_mean(F.col("value") * 1.8, F.lit(1.0), 180.0), 3).alias("mean_180"))


def smoothed_normal(spark, sf_dir):
    return series.smoothed_normal(events(spark, sf_dir), ["user_id"], "ts", "value").select("event_id", rounded(F.col("normal"), 3).alias("normal"))


def circ_medoid(spark, sf_dir):
    angles = events(spark, sf_dir).withColumn("a", F.pmod(F.floor(F.col("value") * 7), F.lit(180)).cast("double"))
    return series.medoid(angles, ["user_id"], "ts", "a")


def quadfit_coeffs(spark, sf_dir):
    days = events(spark, sf_dir).withColumn("d", F.col("t") / 86400.0)
    mid = days.groupBy("user_id").agg(F.avg("d").alias("mid"))
    fit = series.fit_parabola(days.join(mid, "user_id"), ["user_id"], F.col("d") - F.col("mid"), F.col("value"))
    return fit.select("user_id", "n", rounded(F.col("a"), 3).alias("a"), rounded(F.col("b"), 3).alias("b"), rounded(F.col("c"), 3).alias("c"))


def tls_line(spark, sf_dir):
    return series.line_of_pixels(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_discount").select("l_returnflag", "l_linestatus", rounded(F.col("theta_deg")).alias("theta_deg"), rounded(F.col("rms")).alias("rms"))


def top_k_per_group(spark, sf_dir):
    return series.top_k(_table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 12).select("o_orderpriority", "rank", "o_orderkey")


def speed_limit_fold(spark, sf_dir):
    from pyspark.sql import Window

    framed = events(spark, sf_dir).withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    return series.speed_limit(framed, ["user_id"], "frame", "value", 20.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.max("frame").alias("last_frame"))


def homography_apply(spark, sf_dir):
    h = F.array(*[F.lit(v) for v in (1.1, 0.02, 3.0, -0.01, 0.9, 5.0, 0.0001, 0.0002, 1.0)])
    p = geometry.apply_homography(h, F.col("l_quantity"), F.col("l_discount") * 100)
    back = geometry.apply_homography(geometry.invert3(h), p["x"], p["y"])
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(p["x"]).alias("x"), rounded(p["y"]).alias("y"), (F.abs(back["x"] - F.col("l_quantity")) < 1e-6).alias("round_trip"))


def point_in_quad(spark, sf_dir):
    quad = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((5.0, 1.0), (45.0, 2.0), (40.0, 9.0), (10.0, 8.0))])
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(geometry.point_in_quad(F.col("l_quantity"), F.col("l_discount") * 100, quad)).alias("inside"), F.count(F.lit(1)).alias("rows"))


def pixel_hue(spark, sf_dir):
    hsv = color.rgb_to_hsv(F.col("l_quantity") * 5, F.col("l_discount") * 2000, F.col("l_tax") * 3000)
    p = _table(spark, sf_dir, "lineitem").select("l_returnflag", hsv.alias("c"))
    return p.groupBy("l_returnflag").agg(rounded(F.avg("c.s")).alias("s"), rounded(F.avg("c.v")).alias("v"), rounded(F.avg(color.hue_distance(F.col("c.h"), F.lit(55.0)))).alias("off_yellow"))


def stride_sample(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    n = events(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy("ts")) - 1, "n": F.count(F.lit(1)).over(w)})
    return n.where(F.col("i") % F.ceil(F.col("n") / 15.0) == 0).select("event_id", "i")


def csv_projection(spark, sf_dir):
    from pyspark.sql import Window

    return events(spark, sf_dir).select((F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).alias("no"), "user_id", "event_id", rounded(F.col("value")).alias("value"))


def arc_fit(spark, sf_dir):
    days = events(spark, sf_dir).withColumn("d", F.col("t") / 86400.0 - F.floor(F.col("t") / 86400.0))
    return series.trimmed_arc(days, ["event_type"], "d", "value").select("event_type", "n", rounded(F.col("a"), 2).alias("a"), rounded(F.col("b"), 2).alias("b"))


QUERIES = {f.__name__: f for f in (
    session_stats_by_event_type, upper_median_by_flag, percentile_interp, across_outliers, rolling_ols_slope, rolling_median_9, still_islands, take_while_arc, asof_nearest, carry_last_good,
    unwrap_series, circular_mean, smoothed_normal, circ_medoid, quadfit_coeffs, tls_line, top_k_per_group, speed_limit_fold, homography_apply, point_in_quad, pixel_hue, stride_sample, csv_projection, arc_fit,
)}

_fold = lambda x: f"CASE WHEN ((({x}) + 90) % 180 + 180) % 180 - 90 = -90 THEN 90 ELSE ((({x}) + 90) % 180 + 180) % 180 - 90 END"
_cd = lambda a, b: f"least(abs({a} - {b}) % 180, 180 - abs({a} - {b}) % 180)"
_cram = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
_sums = lambda x, y: ", ".join([f"sum(({x}) ** {i}) AS s{i}" for i in range(5)] + [f"sum(({y}) * ({x}) ** {i}) AS y{i}" for i in range(3)])
_a = f"(y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / {_cram}"
_b = f"(s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / {_cram}"
_c = f"(s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / {_cram}"


def _trim(src: str, n: int) -> str:
    """CTEs of one round of trimming for the oracle of arc_fit."""
    return f"""f{n} AS (SELECT event_type, s0, {_a} AS a, {_b} AS b, {_c} AS c FROM (SELECT event_type, {_sums("d", "value")} FROM {src} GROUP BY event_type)),
r{n} AS (SELECT e.*, abs(value - (a + b * d + c * d * d)) AS r FROM {src} e JOIN f{n} USING (event_type)),
k{n} AS (SELECT event_type, d, value FROM (SELECT *, greatest(2.0, 2 * median(r) OVER (PARTITION BY event_type)) AS lim FROM r{n}) WHERE r <= lim)"""


ORACLE_SQL = {
    "session_stats_by_event_type": f"SELECT event_type, {r4('avg(value)')} AS mean, {r4('CASE WHEN count(value) >= 2 THEN stddev_pop(value) END')} AS sd FROM events WHERE isfinite(value) GROUP BY 1",
    "upper_median_by_flag": "SELECT l_returnflag, list_sort(list(l_quantity))[count(l_quantity) // 2 + 1] AS upper_median, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS price_median FROM lineitem GROUP BY 1",
    "percentile_interp": f"SELECT event_type, {r4('quantile_cont(value, 0.05)')} AS p5, {r4('quantile_cont(value, 0.5)')} AS p50, {r4('quantile_cont(value, 0.95)')} AS p95 FROM events GROUP BY 1",
    "across_outliers": """WITH b AS (SELECT user_id, count(value) AS n, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT user_id, count(*) AS kept FROM events JOIN b USING (user_id)
WHERE NOT (n >= 8 AND abs(value - v[n // 2 + 1]) > greatest(1.0, 1.5 * (v[floor(n * 0.75)::INT + 1] - v[floor(n * 0.25)::INT + 1]))) GROUP BY 1""",
    "rolling_ols_slope": f"""WITH {EV}, h AS (SELECT *, t / 3600 - floor(t / 3600 / 2400) * 2400 AS h FROM ev),
s AS (SELECT event_id, count(h) OVER w AS n, sum(h) OVER w AS sx, sum(value) OVER w AS sy, sum(h * h) OVER w AS sxx, sum(h * value) OVER w AS sxy FROM h
      WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT event_id, floor((CASE WHEN n >= 2 AND abs(n * sxx - sx * sx) >= 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0 END) * 1000 + 0.5) / 1000 AS slope FROM s""",
    "rolling_median_9": f"SELECT event_id, {r4('quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)')} AS median FROM events",
    "still_islands": """WITH s AS (SELECT *, row_number() OVER w - 1 AS i, abs(value - lag(value) OVER w) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(CASE WHEN step > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s),
r AS (SELECT user_id, g, min(i) AS first, max(i) AS last, count(*) AS rows FROM g GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id, first, last, rows FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) = 1""",
    "take_while_arc": """WITH s AS (SELECT *, coalesce(sqrt((event_id - lag(event_id) OVER w) ** 2 + (value - lag(value) OVER w) ** 2), 0) AS step, abs(value - first(value) OVER w) > 60 AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
a AS (SELECT *, sum(step) OVER w AS arc, max(far::INT) OVER w AS past FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT user_id, count(*) AS rows, floor(max(arc) * 100 + 0.5) / 100 AS arc FROM a WHERE past = 0 GROUP BY 1""",
    "asof_nearest": f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), p AS (SELECT * FROM ev WHERE event_type = 'purchase')
SELECT c.event_id, p.event_id AS nearest_purchase FROM c LEFT JOIN p USING (user_id) QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - p.t), p.t, p.event_id) = 1""",
    "carry_last_good": "SELECT event_id, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS last_good FROM events",
    "unwrap_series": f"""WITH f AS (SELECT *, {_fold("value * 7")} AS deg FROM events),
j AS (SELECT *, deg - lag(deg) OVER (PARTITION BY user_id ORDER BY ts) AS jump FROM f)
SELECT event_id, {r4("deg")} AS deg, floor((deg + 180 * sum(CASE WHEN jump > 90 THEN -1 WHEN jump < -90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)) * 1000 + 0.5) / 1000 AS unwrapped FROM j""",
    "circular_mean": """SELECT event_type, floor(degrees(atan2(sum(sin(radians(value * 3.6::DOUBLE)) * (abs(value) + 1)), sum(cos(radians(value * 3.6::DOUBLE)) * (abs(value) + 1)))) * 1000 + 0.5) / 1000 AS mean_deg,
floor(degrees(atan2(sum(sin(radians(value * 3.6::DOUBLE))), sum(cos(radians(value * 3.6::DOUBLE))))) / 2 * 1000 + 0.5) / 1000 AS mean_180 FROM events GROUP BY 1""",
    "smoothed_normal": """SELECT event_id, floor(degrees(atan2(avg(sin(radians(value * 2))) OVER w, avg(cos(radians(value * 2))) OVER w)) / 2 * 1000 + 0.5) / 1000 AS normal FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)""",
    "circ_medoid": f"""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, ((floor(value * 7) % 180 + 180) % 180)::DOUBLE AS a FROM events),
c AS (SELECT x.user_id, x.i, x.a, sum({_cd("x.a", "y.a")}) AS cost FROM a x JOIN a y USING (user_id) GROUP BY ALL)
SELECT user_id, a AS medoid FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cost, i) = 1""",
    "quadfit_coeffs": f"""WITH {EV}, d AS (SELECT *, t / 86400 - avg(t / 86400) OVER (PARTITION BY user_id) AS x FROM ev),
s AS (SELECT user_id, {_sums("x", "value")} FROM d GROUP BY 1)
SELECT user_id, s0::BIGINT AS n, {", ".join(f"floor(({e}) * 1000 + 0.5) / 1000 AS {k}" for k, e in (("a", _a), ("b", _b), ("c", _c)))} FROM s""",
    "tls_line": f"""WITH m AS (SELECT l_returnflag, l_linestatus, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, {r4("degrees(atan2(2 * xy, xx - yy)) / 2")} AS theta_deg, {r4("sqrt(greatest((xx + yy - sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2, 0))")} AS rms FROM m""",
    "top_k_per_group": "SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, o_orderkey FROM orders QUALIFY rank <= 12",
    "speed_limit_fold": """WITH RECURSIVE f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS frame, value AS y FROM events),
k AS (SELECT user_id, frame AS pos, frame, y, 1 AS kept FROM f WHERE frame = 1
      UNION ALL SELECT k.user_id, k.pos + 1, CASE WHEN abs(f.y - k.y) <= 20 * (f.frame - k.frame) THEN f.frame ELSE k.frame END,
             CASE WHEN abs(f.y - k.y) <= 20 * (f.frame - k.frame) THEN f.y ELSE k.y END, k.kept + CASE WHEN abs(f.y - k.y) <= 20 * (f.frame - k.frame) THEN 1 ELSE 0 END
      FROM k JOIN f ON f.user_id = k.user_id AND f.frame = k.pos + 1)
SELECT user_id, kept::BIGINT AS kept, frame::INT AS last_frame FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1""",
    "homography_apply": f"""SELECT l_orderkey, l_linenumber, {r4("(1.1::DOUBLE * l_quantity + 0.02::DOUBLE * (l_discount * 100) + 3.0::DOUBLE) / (0.0001::DOUBLE * l_quantity + 0.0002::DOUBLE * (l_discount * 100) + 1.0::DOUBLE)")} AS x,
{r4("(-0.01::DOUBLE * l_quantity + 0.9::DOUBLE * (l_discount * 100) + 5.0::DOUBLE) / (0.0001::DOUBLE * l_quantity + 0.0002::DOUBLE * (l_discount * 100) + 1.0::DOUBLE)")} AS y, true AS round_trip FROM lineitem""",
    "point_in_quad": """WITH p AS (SELECT l_returnflag, l_quantity AS x, l_discount * 100 AS y FROM lineitem),
s AS (SELECT l_returnflag, [40 * (y - 1) - 1 * (x - 5), -5 * (y - 2) - 7 * (x - 45), -30 * (y - 9) + 1 * (x - 40), -5 * (y - 8) + 7 * (x - 10)] AS c FROM p)
SELECT l_returnflag, count(*) FILTER (WHERE NOT (list_max(c) > 1e-9 AND list_min(c) < -1e-9)) AS inside, count(*) AS rows FROM s GROUP BY 1""",
    "pixel_hue": f"""WITH c AS (SELECT l_returnflag, l_quantity * 5 / 255 AS r, l_discount * 2000 / 255 AS g, l_tax * 3000 / 255 AS b FROM lineitem),
h AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM c),
q AS (SELECT *, CASE WHEN v > 0 THEN d / v ELSE 0 END AS s, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (((g - b) / d) % 6 + 6) % 6 WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 AS hue FROM h)
SELECT l_returnflag, {r4("avg(s)")} AS s, {r4("avg(v)")} AS v, {r4("avg(least(abs(hue - 55) % 360, 360 - abs(hue - 55) % 360))")} AS off_yellow FROM q GROUP BY 1""",
    "stride_sample": "SELECT event_id, i::INT AS i FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % ceil(n / 15.0) = 0",
    "csv_projection": f"SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts)::INT AS no, user_id, event_id, {r4('value')} AS value FROM events",
    "arc_fit": f"""WITH {EV}, k0 AS (SELECT event_type, t / 86400 - floor(t / 86400) AS d, value FROM ev), {_trim("k0", 1)}, {_trim("k1", 2)}, {_trim("k2", 3)}
SELECT event_type, s0::BIGINT AS n, floor(({_a}) * 100 + 0.5) / 100 AS a, floor(({_b}) * 100 + 0.5) / 100 AS b FROM (SELECT event_type, {_sums("d", "value")} FROM k3 GROUP BY 1)""",
}
