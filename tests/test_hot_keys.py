"""Series operators hold no key's whole series in one row."""

import random

from pyspark.sql import functions as F

from motionspark.operators import series
from motionspark.plans import analogues, rules
from conftest import SMALL


def test_no_series_in_one_row(spark):
    for query in (analogues.upper_median_by_flag, analogues.speed_limit_fold):
        assert "collect_list" not in query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_hot_key(spark):
    """One key with most rows: median, medoid and fold as in plain Python."""
    rows = [(None if i % 9 == 0 else "hot", i, float(i * i % 977)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    for key in (None, "hot"):
        values = sorted(x for k, _, x in rows if k == key)
        got = {r.k: r.m for r in series.upper_median(df, ["k"], "x", "m").collect()}
        assert got[key] == values[len(values) // 2]
        last, kept = None, 0
        for k, i, x in rows:
            if k == key and (last is None or abs(x - last[1]) <= 3.0 * (i - last[0])):
                last, kept = (i, x), kept + 1
        assert series.speed_limit(df, ["k"], "i", "x", 3.0).where(F.col("k").eqNullSafe(F.lit(key))).count() == kept
    found = series.medoid(df.withColumn("a", F.pmod(F.col("x"), F.lit(180.0))), ["k"], "i", "a").collect()
    assert len(found) == 2


def test_medoid_against_all_pairs(spark):
    """Also for angles outside the period, ties, and a key that holds most rows."""
    draw = random.Random(3)
    rows = [(draw.choice("aaaaaabc"), i, draw.choice((draw.randint(-400, 400) * 0.5, float(draw.randint(0, 9))))) for i in range(400)]
    rows += [("one", 1, 7.0), ("tie", 2, 0.0), ("tie", 1, 90.0), ("none", 1, None)]
    found = dict(tuple(r) for r in series.medoid(spark.createDataFrame(rows, "k string, i int, a double"), ["k"], "i", "a").collect())
    want = {}
    for k in {r[0] for r in rows}:
        mine = [(i, a) for key, i, a in rows if key == k and a is not None]
        off = lambda a, b: min((a - b) % 180, (b - a) % 180)
        if mine:
            want[k] = min((round(sum(off(a, b) for _, b in mine), 6), min(i for i, b in mine if b == a), a) for _, a in mine)[2]
    assert found == want


def test_trimmed_arc_has_few_exchanges(spark):
    """Rounds are written, so the plan of the last fit does not repeat them; a key with most points has them spread."""
    draw = random.Random(4)
    rows = [("hot" if i % 10 else "rare", float(x), 1 + 2 * x - 0.5 * x * x + (40 if i % 37 == 0 else draw.random() * 0.1)) for i in range(2_000) for x in [draw.uniform(-3, 3)]]
    fit = series.trimmed_arc(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y")
    assert fit._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 8
    for r in fit.collect():
        assert abs(r.a - 1.05) < 0.05 and abs(r.b - 2) < 0.05 and abs(r.c + 0.5) < 0.05


def test_review_residuals_keep_no_key_whole(spark):
    plan = rules.review_residuals(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
