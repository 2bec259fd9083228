"""Queries over per-user and per-period aggregates."""

from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators import summary
from tallyspark.operators.classify import fall_through
from tallyspark.operators.sinks import materialise
from tallyspark.plans import duck, frames
from tallyspark.plans.registry import plain, register
from tallyspark.plans.queries_cleaning import DUP
from tallyspark.plans.tables import table

_CATEGORIES = ", ".join(f"({i}, {duck.lit(n)}, {duck.lit(s)}, {str(inc).lower()})"
                        for i, n, s, inc in V.CATEGORIES)
CATEGORIES = f"select * from (values {_CATEGORIES}) as c(category_id, name, slug, is_income)"

MONTHS = """
    select user_id, cast(date_trunc('month', tx_date) as date) as month,
           cast(sum(case when tx_type = 'credit' then amount else 0 end) as double)
               as total_income,
           cast(sum(case when tx_type = 'debit' then amount else 0 end) as double)
               as total_expenses,
           cast(sum(case when tx_type = 'credit' then amount else -amount end) as double)
               as net_savings,
           count(*) as tx_count
    from {0} group by 1, 2"""
SPEND = """
    select t.user_id, cast(date_trunc('month', t.tx_date) as date) as month,
           c.name as category, c.slug, cast(sum(t.amount) as double) as total,
           count(*) as tx_count
    from {0} t join categories c on t.category = c.slug
    where t.tx_type = 'debit' group by 1, 2, 3, 4"""
PERIOD = """
    select *, cast(case when total_income > 0
                        then {round} else 0 end as double)
                  as savings_rate_pct
    from (select user_id,
                 cast(sum(case when tx_type = 'credit' then amount else 0 end) as double)
                     as total_income,
                 cast(sum(case when tx_type = 'debit' then amount else 0 end) as double)
                     as total_expenses,
                 min(tx_date) as period_start, max(tx_date) as period_end,
                 count(*) as tx_count,
                 cast(sum(case when tx_type = 'credit' then amount else -amount end) as double)
                     as net_savings
          from {0} group by user_id)""".replace(
    "{round}", duck.rounded("net_savings / total_income * 100", 2).replace("{", "{{")
    .replace("}", "}}"))


@register("monthly_summary", duck.query(MONTHS.format("lab"), "lab"))
def monthly_summary(spark, sf_dir):
    return plain(summary.monthly_summary(frames.normal(spark, sf_dir)))


@register("category_spend", duck.query(SPEND.format("lab"), "lab", categories=CATEGORIES))
def category_spend(spark, sf_dir):
    return plain(summary.category_spend(frames.labelled(spark, sf_dir)))


@register("period_category_spend", duck.query("""
    select user_id, category, cast(sum(amount) as double) as total from lab
    where tx_type = 'debit' group by user_id, category""", "lab"))
def period_category_spend(spark, sf_dir):
    return plain(summary.period_category_spend(frames.labelled(spark, sf_dir)))


@register("period_summary", duck.query(PERIOD.format("lab"), "lab"))
def period_summary(spark, sf_dir):
    return plain(summary.period_summary(frames.normal(spark, sf_dir)))


@register("dominant_bank", duck.query("""
    select user_id, bank, n from (
        select user_id, bank, count(*) as n,
               row_number() over (partition by user_id order by count(*) desc, bank) as rn
        from lab where bank is not null group by user_id, bank) where rn = 1""", "lab"))
def dominant_bank(spark, sf_dir):
    return summary.dominant_bank(frames.normal(spark, sf_dir))


@register("misc_rate", duck.query("""
    select count(*) as n_total, count(*) filter (category = 'miscellaneous') as n_misc,
           round(avg(case when category = 'miscellaneous' then 1 else 0 end) * 100, 4)
               as misc_pct from lab""", "lab"))
def misc_rate(spark, sf_dir):
    return fall_through(frames.labelled(spark, sf_dir))


@register("running_balance", duck.query("""
    select user_id, row_ord, tx_date,
           cast(250000 + sum(case when tx_type = 'credit' then amount else -amount end) over (
               partition by user_id order by tx_date, row_ord
               rows between unbounded preceding and current row) as double) as running_balance
    from std""", "std"))
def running_balance(spark, sf_dir):
    balances = summary.running_balance(frames.standard(spark, sf_dir), 250_000)
    return plain(balances.select("user_id", "row_ord", "tx_date", "running_balance"))


#: Uploads of one part only, budgets at customer grain and repeated transactions, so
#: that the checks have something to find.
@register("constraint_checks", duck.query(f"""
    select 'tx_type_domain' as check_name, count(*) as violations from tx
    where tx_type is null or tx_type not in ('debit', 'credit')
    union all select 'unique_fingerprint', count(*) from (
        select 1 from tx group by user_id, fingerprint having count(*) > 1)
    union all select 'unique_budget', count(*) from (
        select 1 from budget group by user_id, category, month having count(*) > 1)
    union all select 'unique_snapshot', count(*) from (
        select 1 from snapshots group by user_id, month having count(*) > 1)
    union all select 'upload_reference', count(*) from (
        select distinct upload_id from tx
        where upload_id not in (select upload_id from uploads))
    union all select 'category_reference', count(*) from (
        select distinct category from tx where category not in (select slug from categories))
    """, "entries", **DUP, tx=duck.classified("dup_std"), categories=CATEGORIES,
    budget=duck.tables.derive_sql("customer", frames.BUDGET),
    snapshots="select user_id, cast(date_trunc('month', tx_date) as date) as month from tx "
              "group by 1, 2",
    uploads="select upload_id from tx group by upload_id "
            "having min(tx_date) < date '1995-01-15'"))
def constraint_checks(spark, sf_dir):
    from tallyspark.operators.classify import classify
    # The stored tables that the checks read, each once.
    tx = materialise(classify(frames.repeated(spark, sf_dir)).select(
        "user_id", "upload_id", "tx_date", "tx_type", "amount", "category", "fingerprint"),
        "checked")
    uploads = materialise(tx.groupBy("upload_id").agg(F.min("tx_date").alias("lo"))
                          .where("lo < date'1995-01-15'").select("upload_id"), "uploads")
    snapshots = materialise(summary.monthly_summary(tx), "snapshots")
    budgets = frames.derive(table(spark, sf_dir, "customer"), frames.BUDGET)
    return summary.constraint_checks(tx, uploads, budgets, snapshots)
