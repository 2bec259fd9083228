"""One wide row per user, from which health and recommendations are read.

The transactions are scanned once. They are first reduced to one row per user and
day (partial aggregation before the shuffle, and a very active user is spread over
its days); weeks, months and the whole period are then grouping sets over those
daily rows, and the spread of weekly and monthly sums is a second, small aggregate.
"""

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.sqltext import rounded
from tallyspark.functions.text import any_of
from tallyspark.operators.summary import IS_CREDIT, IS_DEBIT, sum_where
from tallyspark.schema import MONEY

DEBIT_SLUGS = [slug for _, _, slug, is_income in V.CATEGORIES if not is_income]


def _words(words: list[str]) -> str:
    return f"lower(description) rlike '{any_of(words)}'"


#: Daily sums, each a condition on a transaction.
DAILY_SUMS = {
    "income": IS_CREDIT,
    "expenses": IS_DEBIT,
    **{f"spend_{slug}": f"{IS_DEBIT} and category = '{slug}'" for slug in DEBIT_SLUGS},
    "weekend_spend": f"{IS_DEBIT} and weekday(tx_date) >= 5",
    "eat_out": f"{IS_DEBIT} and category = 'food' and " + _words(V.EAT_OUT_WORDS),
    "groceries": f"{IS_DEBIT} and category = 'food' and " + _words(V.GROCERY_WORDS),
}


def daily_sums(tx: DataFrame) -> DataFrame:
    """Sums per user, day and recurring subscription service (null for all other rows)."""
    service = (F.expr("case when category = 'subscriptions' and is_recurring "
                      "then recurring_group end") if "recurring_group" in tx.columns
               else F.lit(None).cast("string"))
    return tx.withColumn("service", service).groupBy("user_id", "tx_date", "service").agg(
        *[sum_where(condition).alias(name) for name, condition in DAILY_SUMS.items()],
        F.expr(f"count_if({IS_CREDIT})").alias("n_credits"),
        F.expr(f"count_if({IS_DEBIT})").alias("n_debits"))


def user_features(tx: DataFrame) -> DataFrame:
    """Sums, counts, period and spread statistics of every user.

    ``n_subscriptions`` counts recurring services if ``tx`` has recurring groups.
    """
    sums = [*DAILY_SUMS, "n_credits", "n_debits"]
    days = daily_sums(tx).selectExpr(
        "*", "cast(date_trunc('week', tx_date) as date) as week",
        "trunc(tx_date, 'month') as month")
    periods = days.groupingSets(
        [["user_id"], ["user_id", "week"], ["user_id", "month"], ["user_id", "service"]],
        "user_id", "week", "month", "service").agg(
            F.grouping_id().alias("level"),
            *[F.sum(name).alias(name) for name in sums],
            F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"))
    # grouping_id has one bit per column left out: week, month, service from the top.
    whole, weekly, monthly, per_service = 0b111, 0b011, 0b101, 0b110
    week_sum = f"case when level = {weekly} and n_debits > 0 then cast(expenses as double) end"
    month_sum = f"case when level = {monthly} and n_credits > 0 then income end"
    month_double = f"cast({month_sum} as double)"
    wide = periods.groupBy("user_id").agg(
        *[F.expr(f"max(case when level = {whole} then {name} end)").alias(name)
          for name in [*sums, "first_date", "last_date"]],
        F.expr(f"count({week_sum})").alias("n_weeks"),
        F.expr(f"try_divide(stddev_samp({week_sum}), avg({week_sum}))").alias("weekly_cv"),
        F.expr(f"count({month_sum})").alias("n_months"),
        F.expr(f"try_divide(stddev_samp({month_double}), avg({month_double}))")
        .alias("monthly_cv"),
        F.expr(f"min({month_sum})").cast(MONEY).alias("lowest_month"),
        F.expr(f"count(case when level = {per_service} then service end)")
        .alias("n_subscriptions"))
    essentials = " + ".join(f"spend_{c}" for c in V.ESSENTIAL_CATEGORIES)
    return wide.withColumn("net", F.expr("cast(income - expenses as decimal(18,2))")).selectExpr(
        "*",
        "case when income > 0 then try_divide(cast(net as double), cast(income as double)) "
        "else 0D end as savings_rate",
        rounded(f"cast({essentials} as double) "
                "/ greatest(1D, datediff(last_date, first_date) / 30D)", 2)
        + " as monthly_essentials")
