"""Queries over the cash-flow forecast. The SQL side builds the dense calendar."""

from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.money import rounded
from tallyspark.operators import forecast
from tallyspark.plans import duck, frames
from tallyspark.plans.registry import plain, register

DAILY = """
    select c.user_id, c.tx_date, coalesce(d.credits, 0) as credits,
           coalesce(d.debits, 0) as debits
    from (select user_id, cast(unnest(generate_series(min(tx_date), max(tx_date),
                                                      interval 1 day)) as date) as tx_date
          from {0} group by user_id) c
    left join (select user_id, tx_date, sum(amount) filter (tx_type = 'credit') as credits,
                      sum(amount) filter (tx_type = 'debit') as debits
               from {0} group by user_id, tx_date) d
      on c.user_id = d.user_id and c.tx_date = d.tx_date"""
HISTORY = f"""
    select d.user_id, count(*) as n_days, max(d.tx_date) as last_date,
           sum(power({forecast.DECAY!r}::double, date_diff('day', d.tx_date, l.hi))
               * cast(credits - debits as double))
             / sum(power({forecast.DECAY!r}::double, date_diff('day', d.tx_date, l.hi)))
             as ewm_net,
           avg(cast(credits - debits as double)) as overall,
           cast(sum(credits) as double) as income, cast(sum(debits) as double) as expenses
    from daily d join (select user_id, max(tx_date) as hi from daily group by user_id) l
      on d.user_id = l.user_id group by d.user_id"""
FACTORS = """
    select h.user_id, w.weekday,
           case when abs(h.overall) < 1e-9 then 1.0::double
                else greatest(0.2::double, least(3.0::double,
                     coalesce(d.mean, h.overall) / h.overall)) end as factor
    from history h cross join (select unnest(range(0, 7)) as weekday) w
    left join (select user_id, isodow(tx_date) - 1 as weekday,
                      avg(cast(credits - debits as double)) as mean
               from daily group by 1, 2) d
      on h.user_id = d.user_id and w.weekday = d.weekday"""
INCOME = """
    select user_id, cast(sum(income) as double) / count(*) as monthly_income from (
        select user_id, sum(amount) as income from {0}
        where tx_type = 'credit' group by user_id, date_trunc('month', tx_date))
    group by user_id"""
BALANCE = """
    select user_id, cast(balance as double) as current_balance from (
        select *, row_number() over (partition by user_id order by tx_date desc,
                                     row_ord desc) as rn
        from {0} where balance is not null) where rn = 1"""
AHEAD = f"""
    select u.user_id, s.day_no, u.last_date + cast(s.day_no as int) as forecast_date, u.thin,
           case when u.thin then u.flat else
                u.ewm_net * f.factor
                + case when day(u.last_date + cast(s.day_no as int)) >= 25 and s.day_no <= 10
                       then coalesce(i.monthly_income, 0) / 30 else 0 end end as net_flow,
           coalesce(b.current_balance, 0) as start
    from (select h.*, n_days < 7 as thin,
                 (income - expenses) / greatest(a.n_active, 1) as flat
          from history h join (select user_id, count(distinct tx_date) as n_active
                               from fc_std group by user_id) a on h.user_id = a.user_id) u
    cross join (select unnest(range(1, {V.HORIZON_DAYS + 1})) as day_no) s
    join factors f on f.user_id = u.user_id
         and f.weekday = isodow(u.last_date + cast(s.day_no as int)) - 1
    left join income i on i.user_id = u.user_id
    left join opening b on b.user_id = u.user_id"""
PATH = """
    select *, start + sum(net_flow) over (partition by user_id order by day_no
                          rows between unbounded preceding and current row) as balance
    from ahead"""


def _parts(source: str) -> dict[str, str]:
    return {"daily": DAILY.format(source), "history": HISTORY, "factors": FACTORS,
            "income": INCOME.format(source), "opening": BALANCE.format(source)}


FORECAST = {**_parts("fc_std"), "ahead": AHEAD, "path": PATH}


def _events(spark, sf_dir):
    from tallyspark.operators.standardise import standardise
    from tallyspark.plans import tables
    from tallyspark.plans.tables import event_entries
    return standardise(event_entries(spark, sf_dir, tables.FORECAST_SCALE))


@register("daily_history", duck.query(
    "select user_id, tx_date, cast(credits as double) as credits, "
    "cast(debits as double) as debits from daily", "fc_std", daily=DAILY.format("fc_std")))
def daily_history(spark, sf_dir):
    return plain(forecast.daily_history(_events(spark, sf_dir)))


@register("daily_history_orders", duck.query(
    "select user_id, tx_date, cast(credits as double) as credits, "
    "cast(debits as double) as debits from daily", "std", daily=DAILY.format("std")))
def daily_history_orders(spark, sf_dir):
    return plain(forecast.daily_history(frames.standard(spark, sf_dir)))


@register("ewm_net", duck.query(
    "select user_id, round(ewm_net, 4) as ewm_net from history", "fc_std",
    **_parts("fc_std")))
def ewm_net(spark, sf_dir):
    return forecast.history_features(_events(spark, sf_dir)).select(
        "user_id", F.round("ewm_net", 4).alias("ewm_net"))


@register("dow_factors", duck.query(
    "select user_id, cast(weekday as int) as weekday, round(factor, 6) as factor from factors",
    "fc_std", **_parts("fc_std")))
def dow_factors(spark, sf_dir):
    return forecast.dow_factors(_events(spark, sf_dir)).select(
        "user_id", "weekday", F.round("factor", 6).alias("factor"))


@register("current_balance", duck.query(
    "select * from opening", "std", opening=BALANCE.format("std")))
def current_balance(spark, sf_dir):
    return plain(forecast.current_balance(frames.standard(spark, sf_dir)))


@register("monthly_income", duck.query(
    "select user_id, round(monthly_income, 4) as monthly_income from income", "std",
    income=INCOME.format("std")))
def monthly_income(spark, sf_dir):
    return forecast.monthly_income(frames.standard(spark, sf_dir)).select(
        "user_id", F.round("monthly_income", 4).alias("monthly_income"))


@register("cashflow_forecast", duck.query(
    "select user_id, cast(day_no as int) as day_no, forecast_date, "
    f"{duck.rounded('net_flow', 2)} as net_flow, "
    f"{duck.rounded('balance', 2)} as projected_balance from path",
    "fc_std", **FORECAST))
def cashflow_forecast(spark, sf_dir):
    return forecast.cashflow_forecast(_events(spark, sf_dir))


@register("simple_forecast", duck.query(
    "select user_id, cast(day_no as int) as day_no, forecast_date, "
    f"{duck.rounded('net_flow', 2)} as net_flow, "
    f"{duck.rounded('balance', 2)} as projected_balance from path "
    "where thin", "fc_std", **FORECAST))
def simple_forecast(spark, sf_dir):
    rows = forecast.forecast_rows(forecast.forecast_features(_events(spark, sf_dir))
                                  .where("thin"))
    return rows.select("user_id", "day_no", "forecast_date",
        rounded(F.col("net_flow"), 2).alias("net_flow"),
                       rounded(F.col("projected_balance"), 2).alias("projected_balance"))


@register("forecast_summary", duck.query(f"""
    select u.user_id, cast(min(case when not thin and {duck.rounded('balance', 2)} < {V.LOW_BALANCE}
                               then day_no end) as int) as days_until_low,
           {V.LOW_BALANCE} as low_balance_threshold,
           {duck.rounded('coalesce(any_value(start), 0)', 2)} as current_balance,
           coalesce(max(case when day_no = {V.HORIZON_DAYS} then {duck.rounded('balance', 2)} end), 0)
               as expected_month_end_balance,
           coalesce({duck.rounded("any_value(case when thin then income "
                                     "else income / n_days * 30 end)", 2)}, 0) as estimated_monthly_income,
           coalesce({duck.rounded("any_value(case when thin then expenses "
                                     "else expenses / n_days * 30 end)", 2)}, 0)
               as estimated_monthly_expenses
    from (select distinct cast(cast(floor(c_custkey) as bigint) as string) as user_id
          from customer) u
    left join path p on p.user_id = u.user_id
    left join history h on h.user_id = u.user_id
    group by u.user_id""", "fc_std", **FORECAST))
def forecast_summary(spark, sf_dir):
    """All customers, most of them without any event: their forecast is empty."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("user_id"))
    return forecast.forecast_summary(_events(spark, sf_dir), users=users)
