"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where that is unset and Spark runs within this machine (tests), a temporary folder; on a cluster that
    would be seen by nobody else, so it is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="motionspark-"))
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_dir(spark)}/motionspark/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both by their keys, however small Spark takes it for.

    Spark takes a plan's size from the files that it reads: frames that are made of keys, and what Python makes of them, look as small as the keys, and
    would go to all tasks by way of the driver.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: used by many later steps, it is computed once and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
