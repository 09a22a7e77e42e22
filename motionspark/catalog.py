"""The registered queries of the analytics engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analogues, drawings, pictures, rules, sights, stores, stroke_sql, strokes

FLAGSHIP = "stroke_impact"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = strokes.QUERIES | pictures.QUERIES | drawings.QUERIES | sights.QUERIES | stores.QUERIES | rules.QUERIES | analogues.QUERIES
ORACLE_SQL: dict[str, str] = stroke_sql.ORACLES | pictures.ORACLE_SQL | drawings.ORACLE_SQL | sights.ORACLE_SQL | stores.ORACLE_SQL | rules.ORACLE_SQL | analogues.ORACLE_SQL
