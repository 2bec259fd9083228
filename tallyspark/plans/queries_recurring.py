"""Queries over recurring payments."""

from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators import recurring
from tallyspark.plans import duck, frames
from tallyspark.plans.registry import plain, register


@register("known_subscriptions", duck.query("""
    select row_ord, description, known_recurring as is_recurring, known_group as recurring_group
    from known""", "known"))
def known_subscriptions(spark, sf_dir):
    return recurring.match_known(frames.normal(spark, sf_dir)).select(
        "row_ord", "description", "is_recurring", "recurring_group")


@register("interval_groups", duck.query("""
    select user_id, merchant_key, bucket, cast(n as bigint) as n, round(mean_gap, 6) as mean_gap,
           round(std_gap, 4) as std_gap, is_regular from ev_intervals""", "ev_intervals"))
def interval_groups(spark, sf_dir):
    groups = recurring.interval_groups(frames.event_standard(spark, sf_dir))
    return groups.select("user_id", "merchant_key", "bucket", "n",
                         F.round("mean_gap", 6).alias("mean_gap"),
                         F.round("std_gap", 4).alias("std_gap"), "is_regular")


@register("frequency_recurring", duck.query("""
    select row_ord, user_id, description, is_recurring, recurring_group from ev_rec""",
    "ev_rec"))
def frequency_recurring(spark, sf_dir):
    return frames.event_annotated(spark, sf_dir).select(
        "row_ord", "user_id", "description", "is_recurring", "recurring_group")


def _bands(value: str, bands: list, show) -> str:
    return duck.case([(f"{value} <= {limit}", show(out)) for limit, out in bands[:-1]],
                     show(bands[-1][1]))


def summary_sql(source: str) -> str:
    return f"""
        select *, cast(row_number() over (partition by user_id
                                          order by estimated_monthly desc, name) as int) as rank
        from (select user_id, recurring_group as name,
               case when n < 2 then 'Unknown'
                    else {_bands('gap', V.FREQUENCY_LABELS, duck.lit)} end as frequency,
               {duck.rounded(f"case when n < 2 then mean else mean * {_bands('gap', V.MONTHLY_FACTORS, duck.lit)} end", 2)}
                   as estimated_monthly,
               hi as last_charged,
               case when n >= 2 then hi + cast(floor(gap) as int) end as next_estimated,
               {duck.subscription_advice('recurring_group')} as action,
               n as occurrence_count, {duck.rounded('round(spread, 6)', 2)} as amount_variation
        from (select user_id, recurring_group, count(*) as n,
                     cast(sum(amount) as double) / count(*) as mean,
                     stddev_pop(cast(amount as double)) as spread, max(tx_date) as hi,
                     (max(tx_date) - min(tx_date)) / nullif(count(*) - 1, 0) as gap
              from {source} where is_recurring group by user_id, recurring_group))"""


@register("recurring_summary", duck.query(summary_sql("rec"), "rec"))
def recurring_summary(spark, sf_dir):
    return recurring.recurring_summary(recurring.detect_recurring(frames.normal(spark, sf_dir)))


@register("recurring_summary_events", duck.query(summary_sql("ev_rec"), "ev_rec"))
def recurring_summary_events(spark, sf_dir):
    return recurring.recurring_summary(frames.event_annotated(spark, sf_dir))


@register("subscriptions", duck.query(summary_sql(
    "(select * from rec where category = 'subscriptions')"), "rec"))
def subscriptions(spark, sf_dir):
    return recurring.subscriptions(frames.annotated(spark, sf_dir))


@register("subscription_count", duck.query("""
    select user_id, count(distinct recurring_group) as n_subscriptions from rec
    where category = 'subscriptions' and is_recurring group by user_id""", "rec"))
def subscription_count(spark, sf_dir):
    return plain(recurring.subscription_count(frames.annotated(spark, sf_dir)))
