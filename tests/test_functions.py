import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionspark.functions import color, geometry, robust
from motionspark.functions.formatting import fixed, signed
from motionspark.operators import series


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_fold(spark):
    got = one(spark, *[geometry.fold_angle(F.lit(float(v))) for v in (0, 45, 90, 91, 179, 180, -1, -91, -90)])
    assert list(got) == [0, 45, 90, -89, -1, 0, -1, 89, 90]


def test_fold_rounds_as_its_sql_does(spark):
    values = [round(k * 0.37, 2) * 7 for k in range(-400, 400)]
    folded = spark.createDataFrame([(v,) for v in values], "v double").select(geometry.fold_angle(F.col("v"))).collect()
    twice = [math.fmod(math.fmod(v + 90, 180) + 180, 180) - 90 for v in values]
    assert [r[0] for r in folded] == [90 if v == -90 else v for v in twice]


def test_bearing_and_face_are_transposed(spark):
    assert list(one(spark, geometry.bearing_deg(F.lit(0.0), F.lit(1.0)), geometry.face_angle(F.lit(1.0), F.lit(0.0)))) == [0, 0]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-89, 89), min_size=2, max_size=30))
def test_unwrap_moves_by_halves_of_a_turn(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, a double")
    got = [r["unwrapped"] for r in series.unwrap(df, ["k"], "i", "a").orderBy("i").collect()]
    assert all(abs((g - v) / 180 - round((g - v) / 180)) < 1e-9 for g, v in zip(got, values))


def test_homography_round_trip(spark):
    src, dst = ([float(v) for v in p] for p in ((300, 660, 980, 660, 760, 150, 520, 150), (0, 0, 400, 0, 400, 3000, 0, 3000)))
    df = spark.createDataFrame([(src, dst), ([0.0, 0.0, 100.0, 0.0, 200.0, 0.0, 0.0, 100.0], dst)], "s array<double>, d array<double>").withColumn("h", geometry.homography("s", "d"))
    p = geometry.apply_homography(F.col("h"), F.lit(760.0), F.lit(150.0))
    back = geometry.apply_homography(geometry.invert3(F.col("h")), p["x"], p["y"])
    good, bad = df.select(p["x"], p["y"], back["x"], back["y"], "h").collect()
    assert [round(v, 6) for v in good[:4]] == [400, 3000, 760, 150] and bad["h"] is None


def test_solve3(spark):
    got = one(spark, *geometry.solve3([F.lit(float(v)) for v in (2, 1, -1, -3, -1, 2, -2, 1, 2)], [F.lit(float(v)) for v in (8, -11, -3)]))
    assert [round(v, 9) for v in got] == [2, 3, -1]


def test_the_medians_differ(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 4, 8)] + [("none", None)], "k string, x double")
    upper = {r.k: r.m for r in series.upper_median(df, ["k"], "x", "m").collect()}
    between = {r.k: (r.p95, r.p50) for r in series.percentiles(df, ["k"], "x", {"p95": 0.95, "p50": 0.5}).collect()}
    third = {r.k: (r.n, r.q) for r in series.order_statistics(df, ["k"], "x", {"q": lambda n: F.floor(n * 0.75)}).collect()}
    assert upper == {"k": 4, "none": None} and third == {"k": (4, 8), "none": (0, None)}
    assert [round(v, 6) for v in between["k"]] == [7.4, 3] and between["none"] == (0, 0)


def test_session_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("b", None), ("c", 1.0), ("c", 3.0)], "k string, x double")
    got = {r["k"]: tuple(r["s"]) for r in df.groupBy("k").agg(robust.session_stats(F.col("x")).alias("s")).collect()}
    assert got == {"a": (1.0, None), "b": (None, None), "c": (2.0, 1.0)}


def test_speed_limit_is_judged_from_the_last_kept(spark):
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate((0.0, 10.0, 500.0, 20.0, 30.0))], "k int, frame int, y double")
    assert sorted(r["y"] for r in series.speed_limit(df, ["k"], "frame", "y").collect()) == [0, 10, 20, 30]


def test_circular_mean_and_hue(spark):
    df = spark.createDataFrame([(350.0, 1.0), (10.0, 1.0)], "a double, w double")
    assert abs(df.agg(robust.circular_mean(F.col("a"), F.col("w"))).first()[0]) < 1e-9
    c = color.rgb_to_hsv(F.lit(232), F.lit(30), F.lit(168))
    h, d = one(spark, c["h"], color.hue_distance(F.lit(350.0), F.lit(10.0)))
    assert abs(h - 319.0) < 0.2 and d == 20


def test_formats(spark):
    got = one(spark, fixed(F.lit(1234.5)), fixed(F.lit(float("nan"))), signed(F.lit(2.0)), signed(F.lit(-2.0)))
    assert list(got) == ["1234.50", "—", "+2.0", "-2.0"]


def test_nearest_ties_take_the_earlier(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.0), (1, 11.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 4.0, "a"), (1, 6.0, "b"), (1, 10.0, "c")], "k int, at double, v string")
    got = {(r["k"], r["t"]): r["nearest_v"] for r in series.nearest(left, right, ["k"], "t", "at", "v").collect()}
    assert got == {(1, 5.0): "a", (1, 0.0): "a", (1, 11.0): "c", (2, 1.0): None}
