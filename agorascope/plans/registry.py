"""The registered queries of the library proper, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_queries, mining_queries, thread_queries, vector_queries

MODULES = (mining_queries, thread_queries, vector_queries, language_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining_queries.pair_lift(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
