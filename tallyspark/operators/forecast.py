"""Daily cash-flow forecast per user.

The dense daily history is only materialised where it is the result
(``daily_history``). The forecast itself needs sums over it, and days without
transactions add nothing to those sums, so they are computed from the days that
exist plus closed forms for the number of days, weekdays and weights.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.money import rounded
from tallyspark.operators.summary import IS_CREDIT, IS_DEBIT, sum_where
from tallyspark.schema import MONEY

DECAY = (V.EWM_SPAN - 1) / (V.EWM_SPAN + 1)
WEEK = range(7)


def active_days(tx: DataFrame) -> DataFrame:
    """Credits and debits of each user and day with transactions."""
    return tx.groupBy("user_id", "tx_date").agg(
        sum_where(IS_CREDIT).alias("credits"), sum_where(IS_DEBIT).alias("debits"))


def daily_history(tx: DataFrame) -> DataFrame:
    """One row per user and calendar day from first to last, zeros in the gaps."""
    days = active_days(tx)
    span = days.groupBy("user_id").agg(F.min("tx_date").alias("lo"), F.max("tx_date").alias("hi"))
    calendar = span.select("user_id", F.explode(F.sequence("lo", "hi")).alias("tx_date"))
    return (calendar.join(days, ["user_id", "tx_date"], "left")
            .fillna(0, ["credits", "debits"])
            .select("user_id", "tx_date", F.col("credits").cast(MONEY).alias("credits"),
                    F.col("debits").cast(MONEY).alias("debits")))


def _closing_balance() -> Column:
    """Last balance of a group in file order; of two uploads, that with the later id."""
    return F.max_by("balance", F.when(F.col("balance").isNotNull(),
                                      F.struct("row_ord", "upload_id")))


def current_balance(tx: DataFrame) -> DataFrame:
    """Balance of the latest transaction that has one: last of each day, then last day."""
    days = (tx.where("balance is not null").groupBy("user_id", "tx_date")
            .agg(_closing_balance().alias("closing")))
    return days.groupBy("user_id").agg(F.max_by("closing", "tx_date").alias("current_balance"))


def monthly_income(tx: DataFrame) -> DataFrame:
    """Mean of monthly credit sums, over months with credits."""
    months = (tx.where(IS_CREDIT).groupBy("user_id", F.trunc("tx_date", "month").alias("month"))
              .agg(F.sum("amount").alias("income")))
    return months.groupBy("user_id").agg(
        (F.sum("income").cast("double") / F.count(F.lit(1))).alias("monthly_income"))


def _weekday_count(day: int, first: Column, n_days: Column) -> Column:
    """How often a weekday (0 = Monday) occurs in n_days days from a date on."""
    lead = F.pmod(F.lit(day) - F.weekday(first), F.lit(7))
    return F.greatest(F.lit(0), F.ceil((n_days - lead) / F.lit(7.0))).cast("int")


def history_features(tx: DataFrame) -> DataFrame:
    """Per user: balance, span, totals, weighted mean net flow, weekday factors.

    One scan and two shuffles: to (user, day), then to user.
    """
    days = tx.groupBy("user_id", "tx_date").agg(
        sum_where(IS_CREDIT).alias("credits"), sum_where(IS_DEBIT).alias("debits"),
        F.count_if(F.expr(IS_CREDIT)).alias("n_credits"),
        _closing_balance().alias("closing"))
    last = F.max("tx_date").over(Window.partitionBy("user_id"))
    net = (F.col("credits") - F.col("debits")).cast("double")
    weight = F.pow(F.lit(DECAY), F.datediff("last_date", "tx_date"))
    users = days.withColumn("last_date", last).withColumn("net", net).groupBy("user_id").agg(
        F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"),
        F.count(F.lit(1)).alias("n_active"),
        F.sum("credits").cast(MONEY).alias("income"),
        F.sum("debits").cast(MONEY).alias("expenses"),
        F.sum(weight * F.col("net")).alias("weighted_net"),
        F.count_distinct(F.when(F.col("n_credits") > 0, F.trunc("tx_date", "month")))
        .alias("n_income_months"),
        F.max_by("closing", F.when(F.col("closing").isNotNull(), F.col("tx_date")))
        .alias("balance"),
        *[F.coalesce(F.sum(F.when(F.weekday("tx_date") == d,
                                  F.col("credits") - F.col("debits"))), F.lit(0))
          .cast("double").alias(f"net_{d}") for d in WEEK])
    n = F.col("n_days")
    total = (F.col("income") - F.col("expenses")).cast("double")
    overall = total / n

    def factor(day: int) -> Column:
        times = _weekday_count(day, F.col("first_date"), n)
        mean = F.when(times > 0, F.try_divide(F.col(f"net_{day}"), times)).otherwise(overall)
        return F.when(total == 0, F.lit(1.0)).otherwise(
            F.greatest(F.lit(0.2), F.least(F.lit(3.0), F.try_divide(mean, overall))))

    return (users
            .withColumn("n_days", F.datediff("last_date", "first_date") + 1)
            .select(
                "user_id", "first_date", "last_date", "n_days", "n_active", "income", "expenses",
                F.coalesce(F.col("balance").cast("double"), F.lit(0.0)).alias("current_balance"),
                (F.col("weighted_net") * (1 - DECAY) / (1 - F.pow(F.lit(DECAY), n)))
                .alias("ewm_net"),
                F.coalesce(F.try_divide(F.col("income").cast("double"),
                                        F.col("n_income_months")), F.lit(0.0))
                .alias("monthly_income"),
                F.array(*[factor(d) for d in WEEK]).alias("dow_factors")))


def dow_factors(tx: DataFrame) -> DataFrame:
    """Weekday multipliers of each user, one row per weekday."""
    return history_features(tx).select(
        "user_id", F.posexplode("dow_factors").alias("weekday", "factor"))


def forecast_features(tx: DataFrame, as_of: Column | None = None,
                      users: DataFrame | None = None,
                      opening: DataFrame | None = None) -> DataFrame:
    """History features with the forecast's start date (default: the user's last day).

    ``users`` adds users without any transaction; their forecast is empty. ``opening``
    (user_id, balance) states balances to start from in place of the statements' last.
    """
    features = history_features(tx)
    if opening is not None:
        stated = opening.select("user_id", F.col("balance").cast("double").alias("_stated"))
        features = (features.join(stated, "user_id", "left")
                    .withColumn("current_balance", F.coalesce("_stated", "current_balance"))
                    .drop("_stated"))
    if users is not None:
        features = users.select("user_id").distinct().join(features, "user_id", "left")
    return (features.withColumn("as_of", F.col("last_date") if as_of is None else as_of)
            .withColumn("thin", F.col("n_days") < 7))


def _simple_net() -> Column:
    return ((F.col("income") - F.col("expenses")).cast("double")
            / F.greatest("n_active", F.lit(1)))


def forecast_rows(features: DataFrame, horizon: int = V.HORIZON_DAYS) -> DataFrame:
    """One row per user and future day; the cumulative balance is built in place.

    A user's rows come from one array of bounded length, so no window or shuffle
    is needed. Flows and balances are unrounded here.
    """
    def flow(i: Column) -> Column:
        day = F.date_add("as_of", i)
        usual = F.col("ewm_net") * F.element_at("dow_factors", F.weekday(day) + 1)
        payday = (F.dayofmonth(day) >= 25) & (i <= 10)
        return F.when(F.col("thin"), _simple_net()).otherwise(
            usual + F.when(payday, F.col("monthly_income") / 30).otherwise(F.lit(0.0)))

    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.struct(
        i.alias("i"), flow(i).alias("net")))
    start = F.struct(F.col("current_balance").cast("double").alias("balance"),
                     F.array().cast("array<struct<i:int,net:double,balance:double>>")
                     .alias("rows"))

    def add(acc: Column, step: Column) -> Column:
        balance = acc.balance + step.net
        return F.struct(balance.alias("balance"), F.concat(acc.rows, F.array(F.struct(
            step.i.alias("i"), step.net.alias("net"), balance.alias("balance")))).alias("rows"))

    path = F.aggregate("steps", start, add, lambda acc: acc.rows)
    return (features.where("n_days is not null").withColumn("steps", steps)
            .withColumn("path", path)
            .select("user_id", "as_of", "thin", F.explode("path").alias("p"))
            .select("user_id", F.col("p.i").alias("day_no"),
                    F.date_add("as_of", F.col("p.i")).alias("forecast_date"), "thin",
                    F.col("p.net").alias("net_flow"),
                    F.col("p.balance").alias("projected_balance")))


def cashflow_forecast(tx: DataFrame, as_of: Column | None = None,
                      horizon: int = V.HORIZON_DAYS,
                      opening: DataFrame | None = None) -> DataFrame:
    rows = forecast_rows(forecast_features(tx, as_of, opening=opening), horizon)
    return rows.select("user_id", "day_no", "forecast_date",
                       rounded(F.col("net_flow"), 2).alias("net_flow"),
                       rounded(F.col("projected_balance"), 2).alias("projected_balance"))


def forecast_summary(tx: DataFrame, as_of: Column | None = None,
                     horizon: int = V.HORIZON_DAYS,
                     users: DataFrame | None = None,
                     opening: DataFrame | None = None) -> DataFrame:
    """Days until the balance is low, month-end balance, monthly flows per user."""
    features = forecast_features(tx, as_of, users, opening)
    ahead = forecast_rows(features, horizon).groupBy("user_id").agg(
        F.min(F.when(~F.col("thin") & (rounded(F.col("projected_balance"), 2) < V.LOW_BALANCE),
                     F.col("day_no"))).alias("days_until_low"),
        F.max_by(rounded(F.col("projected_balance"), 2), "day_no").alias("month_end_balance"))

    def monthly(column: str) -> Column:
        amount = F.col(column).cast("double")
        return rounded(F.when(F.col("thin"), amount)
                       .otherwise(amount / F.col("n_days") * 30), 2)

    rows = features.join(ahead, "user_id", "left").select(
        "user_id", "days_until_low",
        F.lit(V.LOW_BALANCE).alias("low_balance_threshold"),
        rounded(F.col("current_balance"), 2).alias("current_balance"),
        F.col("month_end_balance").alias("expected_month_end_balance"),
        monthly("income").alias("estimated_monthly_income"),
        monthly("expenses").alias("estimated_monthly_expenses"))
    return rows.fillna(0.0, ["current_balance", "expected_month_end_balance",
                             "estimated_monthly_income", "estimated_monthly_expenses"])
