"""What Spark takes for small because it is made of few keys must not be sent to all tasks by way of the driver."""

import pytest
from conftest import SMALL

from pyspark.sql import functions as F

from motionspark import catalog
from motionspark.operators import heads, rules
from motionspark.plans import pictures

MADE_OF_KEYS = ["stroke_putter", "stroke_tempo", "phase_bands", "picture_movers", "picture_tracks", "picture_heads", "picture_series", "picture_results", "strike_frames", "clip_summaries", "camera_shifts"]


@pytest.mark.parametrize("name", MADE_OF_KEYS)
def test_frames_are_never_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_neighbouring_cells_meet_once(spark, monkeypatch):
    """A point is sent to five cells, not to all nine, and no pair is found twice."""
    found = {}
    real = rules.connected
    monkeypatch.setattr(rules, "connected", lambda links: real(found.setdefault("links", links)))
    rows = [(1, i * 8 + j, float(2 * i), float(2 * j)) for i in range(8) for j in range(8)]
    points = spark.createDataFrame(rows, "u long, e long, x double, y double")
    assert {r.fragment for r in rules.merge_near(points, ["u"], "e", "x", "y", 3.0).collect()} == {0}
    assert found["links"]._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert found["links"].count() == found["links"].select(F.least("a", "b"), F.greatest("a", "b")).distinct().count() == 2 * 8 * 7 + 2 * 7 * 7


def test_impact_takes_few_windows(spark):
    """Each window writes all its rows anew: eight find the ball's start over all frames, and the last two see what rolls alone."""
    plan = catalog.QUERIES["stroke_impact"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    above, _ = plan.split("Join Inner", 1)
    assert plan.count("Window [") <= 10 and above.count("Window [") == 2


def test_followed_clips_are_drawn_once(spark):
    """Seeds are made of keys; of rasters they would draw every clip again."""
    plan = catalog.QUERIES["template_tracks"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


@pytest.mark.parametrize("table", ["times", "tracks", "lines", "shifts", "heads", "faces"])
def test_no_task_makes_the_rows_of_all_clips(spark, monkeypatch, table):
    """Keys fill one small file, which is one task's; they are dealt before they become rows, to as many tasks as the clips need."""
    monkeypatch.setattr(pictures, "CLIPS_A_TASK", 1, raising=False)
    frames = pictures.pictures(spark, SMALL)[table]
    assert frames.rdd.getNumPartitions() >= 10
    of = frames.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("clip_id").alias("clips")).collect()
    assert len(of) > 3 and max(r.clips for r in of) < 6


def test_heads_are_looked_for_once(spark, monkeypatch):
    """Rasters and stills are drawn once each and looked at once, and parts and heads are not dealt to a grouped map of their own."""
    plans, real = [], heads.written
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(heads, "written", lambda df, name: plans.append(plan(df)) or real(df, name))
    found = catalog.QUERIES["head_places"](spark, SMALL)
    assert [p.count("MapInPandas") for p in plans] == [3]
    assert "FlatMapGroupsInPandas" not in plan(found)
