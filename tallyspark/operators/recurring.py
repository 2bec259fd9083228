"""Recurring payments: known services and regular intervals."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.labels import known_subscription, subscription_advice
from tallyspark.functions.money import amount_bucket, rounded
from tallyspark.functions.text import merchant_key

GROUP = ["user_id", "merchant_key", "bucket"]


def match_known(tx: DataFrame) -> DataFrame:
    """Flag rows that name a known subscription service."""
    return (tx.withColumn("recurring_group", known_subscription("description"))
            .withColumn("is_recurring", F.col("recurring_group").isNotNull()))


def with_group_key(tx: DataFrame) -> DataFrame:
    """Add the columns that group payments; a frame that was stored with them keeps them."""
    if {"merchant_key", "bucket"} <= set(tx.columns):
        return tx
    return (tx.withColumn("merchant_key", merchant_key(F.col("description")))
            .withColumn("bucket", amount_bucket(F.col("amount"))))


def interval_groups(tx: DataFrame) -> DataFrame:
    """Gap statistics of debits per (user, merchant key, amount bucket).

    Rows collapse to one per day before the window, so a group is never longer
    than its days. Same-day repeats are gaps of zero: they add to the count only.
    """
    days = (with_group_key(tx.where("tx_type = 'debit'"))
            .groupBy(*GROUP, "tx_date").agg(F.count(F.lit(1)).alias("n")))
    previous = F.lag("tx_date").over(Window.partitionBy(*GROUP).orderBy("tx_date"))
    gaps = days.withColumn("gap", F.datediff("tx_date", previous).cast("double"))
    groups = gaps.groupBy(*GROUP).agg(
        F.sum("n").alias("n"), F.sum("gap").alias("_sum"),
        F.sum(F.col("gap") * F.col("gap")).alias("_squares")).where("n >= 2")
    steps = F.col("n") - 1
    mean = F.coalesce("_sum", F.lit(0.0)) / steps
    variance = F.coalesce("_squares", F.lit(0.0)) / steps - mean * mean
    return (groups.withColumn("mean_gap", mean)
            .withColumn("std_gap", F.sqrt(F.greatest(variance, F.lit(0.0))))
            .withColumn("is_regular", is_regular(F.col("mean_gap"), F.col("std_gap")))
            .drop("_sum", "_squares"))


def is_regular(mean_gap: Column, std_gap: Column) -> Column:
    """True where mean and spread of the gaps fit one of the billing cycles."""
    def fits(days: int) -> Column:
        return ((F.abs(mean_gap - days) / days <= V.CYCLE_MEAN_TOLERANCE)
                & (std_gap <= days * V.CYCLE_STD_TOLERANCE))

    result = fits(V.CYCLES[0])
    for days in V.CYCLES[1:]:
        result = result | fits(days)
    return result


def detect_by_frequency(tx: DataFrame) -> DataFrame:
    """Flag debits of regular groups; their title replaces a known service's name.

    The join carries one row per regular group. A hot group makes the left side
    skewed only, which adaptive execution splits.
    """
    regular = (interval_groups(tx).where("is_regular")
               .select(*GROUP, F.lit("debit").alias("tx_type"),
                       F.initcap("merchant_key").alias("_title")))
    return (with_group_key(tx).join(regular, [*GROUP, "tx_type"], "left")
            .withColumn("is_recurring",
                        F.col("is_recurring") | F.col("_title").isNotNull())
            .withColumn("recurring_group", F.coalesce("_title", "recurring_group"))
            .select(*tx.columns))


def detect_recurring(tx: DataFrame) -> DataFrame:
    """Add is_recurring and recurring_group."""
    return tx.transform(match_known).transform(detect_by_frequency)


def banded(value: Column, bands: list, make) -> Column:
    """First band whose upper limit holds the value; the last band has none."""
    chain = F
    for limit, outcome in bands[:-1]:
        chain = chain.when(value <= limit, make(outcome))
    return chain.otherwise(make(bands[-1][1]))


def recurring_summary(tx: DataFrame) -> DataFrame:
    """One row per user and recurring group; ``rank`` 1 is the user's costliest a month, ties
    by name.

    The mean gap telescopes to (last - first) / (n - 1): one aggregate, no window.
    """
    groups = tx.where("is_recurring").groupBy("user_id", "recurring_group").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        (F.sum("amount").cast("double") / F.count(F.lit(1))).alias("_avg"),
        F.stddev_pop(F.col("amount").cast("double")).alias("_spread"),
        F.min("tx_date").alias("_first"), F.max("tx_date").alias("_last"))
    n = F.col("occurrence_count")
    gap = F.try_divide(F.datediff("_last", "_first").cast("double"), n - 1)
    many = n >= 2
    factor = banded(F.col("_gap"), V.MONTHLY_FACTORS, lambda f: F.lit(f))
    costliest = Window.partitionBy("user_id").orderBy(F.desc("estimated_monthly"), "name")
    return (
        groups.withColumn("_gap", F.when(many, gap))
        .select(
            "user_id", F.col("recurring_group").alias("name"),
            F.when(~many, "Unknown").otherwise(
                banded(F.col("_gap"), V.FREQUENCY_LABELS, F.lit)).alias("frequency"),
            rounded(F.when(~many, F.col("_avg")).otherwise(F.col("_avg") * factor), 2)
            .alias("estimated_monthly"),
            F.col("_last").alias("last_charged"),
            F.when(many, F.date_add("_last", F.floor("_gap").cast("int")))
            .alias("next_estimated"),
            subscription_advice("recurring_group").alias("action"),
            "occurrence_count",
            # Six places first: equal spreads then fall on the same side of a half cent.
            rounded(F.round("_spread", 6), 2).alias("amount_variation"))
        .withColumn("rank", F.row_number().over(costliest)))


def subscriptions(tx: DataFrame) -> DataFrame:
    """Recurring summary of the subscriptions category only."""
    return recurring_summary(tx.where("category = 'subscriptions'"))


def subscription_count(tx: DataFrame) -> DataFrame:
    """Number of distinct recurring services among a user's subscriptions."""
    services = tx.where("category = 'subscriptions' and is_recurring")
    return services.groupBy("user_id").agg(
        F.count_distinct("recurring_group").alias("n_subscriptions"))
