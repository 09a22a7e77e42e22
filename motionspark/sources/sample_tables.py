"""Sample tables from SQL: a table function over the paths of a table of files.

    sample_tables.register(spark)
    SELECT f.clip, s.* FROM files f, LATERAL mp4_samples(f.path) s WHERE s.key
    SELECT * FROM files f, LATERAL mp4_samples(f.path, true)      -- with the encoded bytes
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import mp4
from .files import Ranges

NAME = "mp4_samples"
TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}


@udtf
class SampleTable:
    """Rows of ``mp4.SAMPLES`` of one file, as a reason alone where it has none; a null path has no rows."""

    @staticmethod
    def analyze(path: AnalyzeArgument, data: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(path.dataType, StringType):
            raise ValueError("mp4_samples: the path is a string")
        if data is not None and not (isinstance(data.dataType, BooleanType) and data.isConstantExpression):
            raise ValueError("mp4_samples: whether to read the bytes is a constant true or false")
        schema = StructType()  # there is no session here that could read DDL
        for column in mp4.SAMPLES.split(", "):
            schema.add(column.split()[0], TYPES[column.split()[1]])
        return AnalyzeResult(schema.add("data", BinaryType()) if data is not None and data.value else schema)

    def eval(self, path: str | None, data: bool = False) -> Iterator[tuple]:
        if path is None:
            return
        with Ranges(path) as file:
            for row in mp4.parse(path, mp4.index_of(file, file.size())):
                encoded = (file.read_at(row[9], row[8]) if row[1] is None else None,) if data else ()
                yield (*row, *encoded)


def register(spark: SparkSession) -> None:
    spark.udtf.register(NAME, SampleTable)
