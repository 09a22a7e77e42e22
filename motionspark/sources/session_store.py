"""The session store: a Parquet table of records, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formatting import rounded

SERIES = ("face_series", "head_path", "ball_path")
EXPORTED = ("face_deg", "path_deg", "face_to_path", "start_line_deg", "ball_speed", "tempo_ratio", "back_len", "miss_at_3m_cm", "fps")


def save(records: DataFrame, path: str) -> None:
    """Replace the stored session; the wide series columns are not kept."""
    records.drop(*SERIES).write.mode("overwrite").parquet(path)


def append(records: DataFrame, path: str) -> None:
    records.drop(*SERIES).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored records; their clips are not at hand any more."""
    return spark.read.parquet(path).withColumn("has_clip", F.lit(False))


def clear(spark: SparkSession, path: str) -> None:
    """Empty the store and keep its columns."""
    kind = spark.read.parquet(path).schema
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(path)


def blank_implausible(records: DataFrame, columns: list[str]) -> DataFrame:
    """Implausible records keep their row and lose the measures in ``columns``."""
    return records.withColumns({c: F.when(F.col("implausible").isNull(), F.col(c)) for c in columns})


def export_csv(records: DataFrame, path: str, session: str = "session", order: str = "t") -> None:
    """CSV with a header: the record's number within its session and numbers to 4 places, blanks for nulls."""
    number = F.row_number().over(Window.partitionBy(session).orderBy(order))
    known = [c for c in EXPORTED if c in records.columns]
    records.select(number.alias("#"), session, order, *[rounded(F.col(c), 4).alias(c) for c in known]).write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of a stated schema, one object a file or line; what cannot be parsed is a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def export_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)
