"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query. Its columns in ``doubles`` are sums whose last bits
    depend on the order of addition: they are rounded here and in the SQL alike."""
    names = doubles.split()

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) for c in names}) if names else df

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" for c in names)
            SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if names else sql
        return f

    return add
