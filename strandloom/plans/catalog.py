"""All core queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import model_queries, sequence_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for part in (model_queries, sequence_queries) for q in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return model_queries.SQL | sequence_queries.SQL
