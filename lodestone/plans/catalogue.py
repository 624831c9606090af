"""Every registered query of the retrieval-analytics operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_audit, queries_bundle, queries_core, queries_gates, queries_more, queries_replay, queries_runs, queries_search, queries_text  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["l6_uniform_metrics"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
