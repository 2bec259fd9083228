"""Queries over cleaning steps."""

from pyspark.sql import functions as F

from tallyspark.operators import clean
from tallyspark.operators.sinks import materialise
from tallyspark.plans import duck, frames
from tallyspark.plans.registry import plain, register

DUP = {"dup": frames.repeated_sql(), "dup_std": duck.standardised("dup")}
_FIRST = "row_number() over (partition by {0} order by row_ord, upload_id)"
EXACT = f"""
    select * exclude (rn) from (select *, {_FIRST.format('user_id, fingerprint')} as rn
                                from {{0}}) where rn = 1"""
NEAR = f"""
    select * exclude (rn) from (
        select *, {_FIRST.format("user_id, tx_date, amount, "
                                 "trim(lower(substr(description, 1, 40)))")} as rn
        from {{0}}) where rn = 1"""
FILL = """
    select * replace (last_value(balance ignore nulls) over (
        partition by user_id, upload_id order by row_ord
        rows between unbounded preceding and current row) as balance) from {0}"""
COLUMNS = """user_id, upload_id, row_ord, tx_date, description, raw_desc,
    cast(amount as double) as amount, tx_type, cast(balance as double) as balance, channel,
    merchant, bank, fingerprint"""
CLEANED = {**DUP, "c1": duck.normalised("dup_std"), "c2": EXACT.format("c1"),
           "c3": NEAR.format("c2"), "c4": FILL.format("c3")}


@register("remove_noise", duck.query(f"""
    select row_ord, description from std
    where not regexp_matches(description, {duck.lit(duck.text.noise_pattern())})""", "std"))
def remove_noise(spark, sf_dir):
    return clean.remove_noise(frames.standard(spark, sf_dir)).select("row_ord", "description")


@register("dedup_exact", duck.query(
    f"select row_ord, user_id, fingerprint from ({EXACT.format('dup_std')})",
    "entries", **DUP))
def dedup_exact(spark, sf_dir):
    return clean.drop_exact_duplicates(frames.repeated(spark, sf_dir)).select(
        "row_ord", "user_id", "fingerprint")


@register("dedup_near", duck.query(
    f"select row_ord, user_id, tx_date, description from ({NEAR.format('dup_std')})",
    "entries", **DUP))
def dedup_near(spark, sf_dir):
    return clean.drop_near_duplicates(frames.repeated(spark, sf_dir)).select(
        "row_ord", "user_id", "tx_date", "description")


@register("ffill_balance", duck.query(
    f"select row_ord, upload_id, cast(balance as double) as balance "
    f"from ({FILL.format('std')})", "std"))
def ffill_balance(spark, sf_dir):
    return plain(clean.fill_missing(frames.standard(spark, sf_dir))
                 .select("row_ord", "upload_id", "balance"))


@register("clean_transactions", duck.query(
    f"select {COLUMNS} from c4", "entries", **CLEANED))
def clean_transactions(spark, sf_dir):
    cleaned = clean.clean_transactions(frames.repeated(spark, sf_dir), materialise)
    return plain(clean.newest_first(cleaned))


_CHECKED = ["tx_date", "description", "raw_desc", "amount", "tx_type", "balance", "channel",
            "merchant", "bank", "fingerprint"]


@register("validation_report", duck.query(f"""
    select user_id, count(*) as total_rows, min(tx_date) as start_date,
           max(tx_date) as end_date,
           cast(coalesce(sum(amount) filter (tx_type = 'debit'), 0) as double) as total_debits,
           cast(coalesce(sum(amount) filter (tx_type = 'credit'), 0) as double)
               as total_credits,
           {", ".join(f"count(*) - count({c}) as null_{c}" for c in _CHECKED)},
           concat_ws(' | ',
               case when count(*) - count(tx_date) > 0 then
                    concat(count(*) - count(tx_date), ' rows have unparseable dates — dropped.')
               end,
               case when count(*) filter (amount <= 0) > 0 then
                    concat(count(*) filter (amount <= 0),
                           ' rows have zero or negative amounts.') end,
               case when count(*) filter (tx_type = 'credit') > 0
                     and count(*) filter (tx_type = 'debit') = 0 then
                    'All transactions parsed as credits — check tx_type column mapping.' end)
               as warnings
    from ev_std group by user_id""", "ev_std"))
def validation_report(spark, sf_dir):
    from tallyspark.operators.standardise import standardise
    from tallyspark.plans.tables import event_entries
    report = clean.validation_report(standardise(event_entries(spark, sf_dir)))
    return plain(report.withColumn("warnings", F.array_join("warnings", " | ")))
