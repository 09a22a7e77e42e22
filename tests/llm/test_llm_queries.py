"""Registered corpus queries against their oracle SQL, and on tables without rows."""

import pytest
from conftest import SMALL
from oracle import same_rows

from motionspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], SMALL)


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "embeddings", "labels", "conversations", "pages", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, no_rows, name):
    """No rows, but for the planted conversation of op6."""
    assert queries.QUERIES[name](spark, no_rows).count() == (name == "op6_chat")
