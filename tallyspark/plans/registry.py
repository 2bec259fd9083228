"""Names, Spark callables and SQL counterparts of the queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows in DuckDB."""
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines report the same type."""
    return df.select(*[F.col(name).cast("double").alias(name) if kind.startswith("decimal")
                       else F.col(name) for name, kind in df.dtypes])
