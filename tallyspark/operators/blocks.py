"""Ordered running computations that survive one very long key.

A plain window over (user) puts all rows of a user into one task. Here the order
is cut into blocks: each block is reduced to one row with partial aggregation,
the short list of blocks is scanned per key, and rows are then scanned inside
their block only.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 65_536


def _block(order: str) -> Column:
    return F.floor(F.col(order) / F.lit(BLOCK_ROWS)).cast("bigint")


def carry_forward(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Fill nulls of ``value`` with the last earlier non-null value within ``keys``."""
    block = [*keys, "_block"]
    cut = df.withColumn("_block", _block(order))
    spans = cut.groupBy(*block).agg(F.max_by(
        value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    # The value carried into a block is the last one of any earlier block.
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = spans.select(*block, F.last("_last", ignorenulls=True).over(before).alias("_in"))
    within = Window.partitionBy(*block).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (cut.join(carried, block, "left")
            .withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(within),
                                          F.col("_in")))
            .drop("_block", "_in"))


def running_sum(df: DataFrame, value: Column, keys: list[str], day: str, order: str,
                name: str, ties: tuple = ()) -> DataFrame:
    """Sum of ``value`` over all rows up to this one, by (``day``, ``order``, ``ties``) within
    ``keys``."""
    block = [*keys, day, "_block"]
    cut = df.withColumn("_block", _block(order)).withColumn("_value", value)
    totals = cut.groupBy(*block).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(day, "_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*block, F.coalesce(F.sum("_total").over(before),
                                               F.lit(0)).alias("_in"))
    within = Window.partitionBy(*block).orderBy(order, *ties).rowsBetween(
        Window.unboundedPreceding, 0)
    return (cut.join(offsets, block)
            .withColumn(name, F.col("_in") + F.sum("_value").over(within))
            .drop("_block", "_value", "_in"))
