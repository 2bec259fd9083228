"""Categories by ordered rules."""

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.labels import matched_category
from tallyspark.functions.once import with_once


def classify(tx: DataFrame) -> DataFrame:
    """Add category, confidence and classified_by.

    The rule chain runs once per row, whatever later filters ask of the category.
    """
    is_credit = F.col("tx_type") == "credit"
    found = F.col("_found")
    return (with_once(tx, "_found", matched_category("description", "tx_type"))
            .withColumns({
                "category": F.coalesce(found, F.when(is_credit, V.CREDIT_DEFAULT[0])
                                       .otherwise(V.DEBIT_DEFAULT[0])),
                "confidence": F.when(found.isNotNull(), V.MATCHED_CONFIDENCE)
                .when(is_credit, V.CREDIT_DEFAULT[1]).otherwise(V.DEBIT_DEFAULT[1]),
                "classified_by": F.lit("rule")})
            .drop("_found"))


def fall_through(tx: DataFrame) -> DataFrame:
    """How many transactions ended in the catch-all category."""
    is_misc = F.col("category") == V.DEBIT_DEFAULT[0]
    return tx.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count_if(is_misc).alias("n_misc"),
                  F.round(F.avg(is_misc.cast("int")) * 100, 4).alias("misc_pct"))
