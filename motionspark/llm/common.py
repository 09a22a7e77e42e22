"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import fresh_path, shared_dir, written as staged  # noqa: F401

#: Characters that separate words: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, by Spark's reader (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/motionspark/" in file:
            p = spark._jvm.org.apache.hadoop.fs.Path(file)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
