"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_engine.plans import index_queries, job_queries, model_queries, search_queries, store_queries, text_queries
from corpus_engine.plans.search_queries import flagship

MODULES = (search_queries, text_queries, store_queries, model_queries, job_queries, index_queries)

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
