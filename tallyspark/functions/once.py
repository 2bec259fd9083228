"""Expensive columns that later filters must not repeat."""

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column computed exactly once per row.

    Spark pushes a filter below the projection that makes its column, and so runs
    the column's expression again inside the filter. A column that comes out of a
    one-element explode stays put; filters on other columns still move to the scan.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
