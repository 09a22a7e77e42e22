"""Runs that are watched, called off midway, and taken up again."""

import os
import time

from pyspark.sql import functions as F

from motionspark.streaming.runs import StreamRun, TableRun


def slowly(seconds):
    def step(df):
        def run(batches):
            for f in batches:
                time.sleep(seconds)
                yield f

        return df.mapInPandas(run, df.schema)

    return step


def test_a_stream_is_called_off_and_goes_on(spark, tmp_path):
    for i in range(8):
        spark.range(10 * i, 10 * i + 10).select(F.floor(F.col("id") / 40).alias("clip_id"), F.col("id").cast("int").alias("frame")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    frames = lambda: spark.readStream.schema("clip_id long, frame int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/cp"
    run = StreamRun(frames(), slowly(0.5), out, checkpoint).start(processingTime="0 seconds")
    deadline = time.time() + 90
    while run.frames < 20 and time.time() < deadline:
        time.sleep(0.1)
    run.abort()
    assert 20 <= run.frames < 80 and run.frames % 10 == 0  # one file at a time
    assert not [f for f in os.listdir(out) if f.startswith("_run")]
    done = spark.read.parquet(out)
    assert done.count() in (run.frames, run.frames + 10) and done.groupBy("batch").count().where("count <> 10").isEmpty()
    again = StreamRun(frames(), slowly(0.0), out, checkpoint).start()
    assert again.wait()
    assert sorted(r.frame for r in spark.read.parquet(out).collect()) == list(range(80))
    assert run.frames + again.frames in (80, 90)  # a batch that was published but not yet counted runs again, over itself


def test_a_table_is_called_off_whole(spark, tmp_path):
    rows = spark.range(0, 400, 1, 16).withColumn("x", F.col("id") * 2)
    out = f"{tmp_path}/tables/out"
    run = TableRun(slowly(1.0)(rows), out).start()
    deadline = time.time() + 60
    while not 0 < run.progress() < 1 and time.time() < deadline:
        time.sleep(0.05)
    assert 0 < run.progress() < 1
    run.abort()
    run.wait()
    assert not os.path.exists(out) and not [f for f in os.listdir(tmp_path / "tables") if not f.startswith(".")] if (tmp_path / "tables").exists() else True
    whole = TableRun(rows, out).start()
    whole.wait()
    assert whole.frames == 400 and spark.read.parquet(out).count() == 400
    TableRun(rows.limit(5), out).start().wait()
    assert spark.read.parquet(out).count() == 5


def test_errors_reach_whoever_waits(spark, tmp_path):
    import pytest

    run = TableRun(spark.range(3).select(F.raise_error(F.lit("no film")).alias("x")), f"{tmp_path}/t/out").start()
    with pytest.raises(Exception, match="no film"):
        run.wait()
    assert not os.path.exists(f"{tmp_path}/t/out")
