"""Every query of the engine by name, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aspectdrift.plans import core_queries, model_queries, signal_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = core_queries.QUERIES | model_queries.QUERIES | signal_queries.QUERIES
ORACLE_SQL: dict[str, str] = core_queries.ORACLE | model_queries.ORACLE | signal_queries.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.ols_trend(spark, sf_dir)
