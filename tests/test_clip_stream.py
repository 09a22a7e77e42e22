"""Clips as streams: order of presentation, ends and timers, against batch."""

import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_tracker import HOM, MAT, SCALE, H, W

from motionspark.operators import tracker
from motionspark.plans import strokes
from motionspark.sources import rasters
from motionspark.streaming import clips


@pytest.fixture(scope="module")
def seen(spark, tmp_path_factory):
    """Sightings of two clips of 120 frames about their impact; the first tells its end."""
    folder = f"{tmp_path_factory.mktemp('seen')}/rows"
    obs = strokes.observations(spark, SMALL).where("k IN (104, 112) AND frame BETWEEN 170 AND 289")
    found = tracker.see(rasters.render(obs.repartition(4), W, H, SCALE))
    found.withColumn("last", (F.col("clip_id") == 104) & (F.col("frame") == 289)).write.parquet(folder)
    return spark.read.parquet(folder)


def decoded(frame):
    """When a frame is decoded: in groups of four the last one first, as the frames between refer to it."""
    place = F.pmod(frame - 170, F.lit(4))
    return frame - place + F.when(place == 3, 0).otherwise(place + 1)


def test_stream_equals_batch_at_the_end(spark, seen, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", clips.PROVIDER)
    ordered = seen.withColumn("at", decoded(F.col("frame")))
    for i in range(6):
        ordered.where(F.col("at").between(170 + 20 * i, 189 + 20 * i)).drop("at").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    late = seen.where("clip_id = 112 AND frame = 171").withColumn("last", F.lit(False))
    late.coalesce(1).write.parquet(f"{tmp_path}/in/6")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    query = clips.finish_stream(stream, out, MAT, HOM, W / SCALE, delay=0.03, idle=8.0).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    want = tracker.finish(tracker.track(seen, MAT, HOM), tracker.candidates(seen, MAT), MAT, HOM, W / SCALE)
    want = {r.k: r.rows for r in want.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(*want.columns))).alias("rows")).collect()}
    try:
        deadline = time.time() + 100
        found = {}
        while len(found) < 2 and time.time() < deadline:
            time.sleep(1)
            try:
                rows = spark.read.option("basePath", out).parquet(out).drop("batch")
                found = {r.k: r.rows for r in rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rows")).collect()}
            except Exception:  # nothing has been written yet, or a batch is being written
                assert query.exception() is None
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert set(found) == {104, 112}
    for k in want:
        assert len(found[k]) == 120
        for a, b in zip(found[k], want[k]):
            assert a.frame == b.frame and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-6) for x, y in zip(a, b))
