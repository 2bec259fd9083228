"""Queries over column expressions: money, dates, descriptions, labels."""

from pyspark.sql import functions as F

from tallyspark.functions import dates, fixed_values as V, labels, money, text
from tallyspark.operators.classify import classify
from tallyspark.operators.clean import normalise_amounts
from tallyspark.plans import duck, frames
from tallyspark.plans.registry import plain, register
from tallyspark.plans.tables import _choose as choose
from tallyspark.plans.tables import derive, derive_sql, entries, table

PRICE = "cast(o_totalprice as decimal(18,2))"
_S = f"cast({PRICE} as string)"

#: Amounts as statements print them, including empty and unreadable cells.
MONEY_TEXT = choose("o_orderkey % 10", [
    f"concat('₦', {_S})", f"concat({_S}, ' DR')",
    f"concat(substr({_S}, 1, 2), ',', substr({_S}, 3), 'CR')", f"concat('-', {_S})", "'N/A'",
    "''", "'nan'", f"concat(' ', {_S}, ' dr ')", f"concat('₦ ', {_S}, ' Cr')", f"{_S}"])
MONEY_ROW = {"o_orderkey": "o_orderkey", "money_text": MONEY_TEXT}
CELLS_ROW = {
    "o_orderkey": "o_orderkey",
    "debit_text": f"case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then {_S} "
                  f"else '0.00' end",
    "credit_text": f"case when o_orderkey % 3 = 1 then '' else concat('₦', {_S}) end",
    "kind": choose("o_orderkey % 8", ["'CR'", "'Credit '", "'DEBIT'", "'deposit'", "'dr'",
                                      "' in'", "'Transfer'", "null"]),
}


@register("parse_money", duck.query(f"""
    select o_orderkey, money_text, {duck.parse_money('money_text')} as value from cells""",
    cells=derive_sql("orders", MONEY_ROW)))
def parse_money(spark, sf_dir):
    return derive(table(spark, sf_dir, "orders"), MONEY_ROW).withColumn(
        "value", money.parse_money(F.col("money_text")))


_SIGNED_PRICE = {"o_orderkey": "o_orderkey",
                 "amount": f"cast(case when o_orderkey % 2 = 0 then {PRICE} else -{PRICE} end "
                           f"as double)"}


@register("fmt_money", duck.query("""
    select o_orderkey, concat('₦', format('{:,.2f}', amount)) as shown,
           concat(case when amount >= 0 then '+' else '-' end, '₦',
                  format('{:,.2f}', abs(amount))) as shown_signed from cells""",
    cells=derive_sql("orders", _SIGNED_PRICE)))
def fmt_money(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "orders"), _SIGNED_PRICE)
    return rows.select("o_orderkey", money.naira(F.col("amount")).alias("shown"),
                       money.naira(F.col("amount"), True).alias("shown_signed"))


@register("signed_amount", duck.query(f"""
    select o_orderkey, money_text, abs(value) as amount,
           case when value < 0 then 'debit' when regexp_matches(money_text, '(?i)cr\\b')
                then 'credit' else 'debit' end as tx_type
    from (select *, {duck.parse_money('money_text')} as value from cells)""",
    cells=derive_sql("orders", MONEY_ROW)))
def signed_amount(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "orders"), MONEY_ROW)
    return rows.withColumn("r", money.signed_amount(F.col("money_text"))).select(
        "o_orderkey", "money_text", "r.amount", "r.tx_type")


@register("split_amounts", duck.query(f"""
    select o_orderkey, case when d > 0 then d else c end as amount,
           case when d > 0 then 'debit' else 'credit' end as tx_type
    from (select o_orderkey, {duck.parse_money("case when debit_text = '' then 'nan' else debit_text end")} as d,
                 {duck.parse_money("case when credit_text = '' then 'nan' else credit_text end")} as c from cells)""",
    cells=derive_sql("orders", CELLS_ROW)))
def split_amounts(spark, sf_dir):
    def value(name):
        return money.parse_money(F.when(F.col(name) != "", F.col(name)))

    rows = derive(table(spark, sf_dir, "orders"), CELLS_ROW)
    return rows.withColumn("r", money.split_amounts(value("debit_text"), value("credit_text"))
                           ).select("o_orderkey", "r.amount", "r.tx_type")


@register("typed_amounts", duck.query(f"""
    select o_orderkey, kind, {duck.parse_money('credit_text')} as amount,
           case when regexp_matches(lower(trim(coalesce(kind, ''))), 'cr|credit|deposit')
                then 'credit' else 'debit' end as tx_type from cells""",
    cells=derive_sql("orders", CELLS_ROW)))
def typed_amounts(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "orders"), CELLS_ROW)
    parsed = money.typed_amount(money.parse_money(F.col("credit_text")), F.col("kind"))
    return rows.withColumn("r", parsed).select("o_orderkey", "kind", "r.amount", "r.tx_type")


_D = "lpad(cast(day(o_orderdate) as string), 2, '0')"
_M = "lpad(cast(month(o_orderdate) as string), 2, '0')"
_Y = "cast(year(o_orderdate) as string)"
_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) as int) * 3 - 2, 3)"
DATE_ROW = {
    "o_orderkey": "o_orderkey",
    "date_text": choose("o_orderkey % 11", [
        f"concat({_D}, '/', {_M}, '/', {_Y})", f"concat({_D}, '-', {_MON}, '-', {_Y})",
        f"concat({_Y}, '-', {_M}, '-', {_D})", f"concat({_Y}, '-', {_M}, '-', {_D}, ' 10:20:30')",
        f"concat({_D}, ' ', {_MON}, ' ', {_Y})", f"concat({_D}, '-', {_M}, '-', {_Y})",
        "'not a date'", f"concat({_D}, '/', {_M}, '/', {_Y}, ' 14:33')",
        f"concat({_D}, ' ', {_MON}, ' ', {_Y}, ' 9:05:59 PM')",
        f"concat({_Y}, '-', {_M}, '-', {_D}, 'T10:20:30.125Z')",
        f"concat({_M}, '/', {_D}, '/', {_Y}, ' 00:00:01.5')"]),
}
#: The layouts' date patterns as strptime formats, in layout order.
STRPTIME = ["%d/%m/%Y", "%d-%b-%Y", "%Y-%m-%d", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%d %b %Y"]
_DAY = ("regexp_replace(date_text, '([0-9])[ T][0-9]+:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?( PM)?Z?$', "
        "'\\1')")
_MIXED_SQL = ", ".join(f"try_strptime({_DAY}, '{f}')" for f in [
    "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y",
    "%d-%b-%Y", "%d %b %Y"])


def _by_layout() -> list[str]:
    """A layout whose pattern has no time of day reads the day alone."""
    return [f"try_strptime({'date_text' if '%H' in f else _DAY}, '{f}')" for f in STRPTIME]


@register("parse_dates", duck.query(f"""
    select o_orderkey, date_text, cast(coalesce({_MIXED_SQL}) as date) as mixed,
           cast({choose('o_orderkey % 6', _by_layout())}
                as date) as by_layout from cells""",
    cells=derive_sql("orders", DATE_ROW)))
def parse_dates(spark, sf_dir):
    by_layout = F
    for i, layout in enumerate(V.LAYOUTS):
        by_layout = by_layout.when(F.col("o_orderkey") % 6 == i,
                                   dates.parse_date(F.col("date_text"), layout[-1]))
    return derive(table(spark, sf_dir, "orders"), DATE_ROW).select(
        "o_orderkey", "date_text", dates.parse_mixed(F.col("date_text")).alias("mixed"),
        by_layout.alias("by_layout"))


def _entry_query(name, column, spark_expr, duck_expr):
    """A text expression over the raw description of every entry."""
    @register(name, duck.query(
        f"select row_ord, raw_desc, {duck_expr('raw_desc')} as {column} from entries",
        "entries"))
    def run(spark, sf_dir):
        return entries(spark, sf_dir).select(
            "row_ord", "raw_desc", spark_expr("raw_desc").alias(column))


def _over_column(function):
    return lambda name: function(F.col(name))


_entry_query("clean_desc", "description", _over_column(text.clean_description),
             duck.clean_description)
_entry_query("detect_channel", "channel", labels.detect_channel, duck.detect_channel)
_entry_query("detect_bank", "bank", labels.detect_bank, duck.detect_bank)
_entry_query("extract_merchant", "merchant", _over_column(text.extract_merchant),
             duck.extract_merchant)
_entry_query("normalize_desc", "description", _over_column(text.normalise_description),
             duck.normalise_description)
_entry_query("merchant_key", "merchant_key", _over_column(text.merchant_key),
             duck.merchant_key)


@register("normalize_tx_type", duck.query("""
    select o_orderkey, kind, case when lower(trim(kind)) in ('cr', 'credit', 'deposit', 'in')
                                  then 'credit' else 'debit' end as tx_type from cells""",
    cells=derive_sql("orders", CELLS_ROW)))
def normalize_tx_type(spark, sf_dir):
    return derive(table(spark, sf_dir, "orders"), CELLS_ROW).select(
        "o_orderkey", "kind", money.normal_type(F.col("kind")).alias("tx_type"))


#: Amounts of both signs, zeros among them.
AMOUNT_ROW = {
    "row_ord": "o_orderkey",
    "amount": f"cast(case when o_orderstatus = 'P' then 0 when o_orderstatus = 'F' then -{PRICE} "
              f"else {PRICE} * cast(0.125 as decimal(4,3)) end as decimal(18,5))",
    "tx_type": "case when o_orderkey % 2 = 0 then 'CR ' else 'Debit' end",
    "balance": "case when o_orderkey % 7 = 0 then 'n/a' "
               "else cast(cast(o_totalprice as decimal(18,2)) as string) end",
}


@register("normalize_amounts", duck.query("""
    select row_ord, cast(amount as double) as amount,
           case when lower(trim(tx_type)) in ('cr', 'credit', 'deposit', 'in')
                then 'credit' else 'debit' end as tx_type,
           try_cast(balance as double) as balance
    from (select * replace (round(abs(amount), 2) as amount) from cells)
    where amount > 0""", cells=derive_sql("orders", AMOUNT_ROW)))
def normalize_amounts(spark, sf_dir):
    return plain(normalise_amounts(derive(table(spark, sf_dir, "orders"), AMOUNT_ROW)))


@register("fingerprint", duck.query(
    "select row_ord, user_id, fingerprint from std", "std"))
def fingerprint(spark, sf_dir):
    return frames.standard(spark, sf_dir).select("row_ord", "user_id", "fingerprint")


@register("amount_bucket", duck.query("""
    select row_ord, cast(amount as double) as amount,
           cast(round_even(amount / 100, 0) * 100 as bigint) as bucket from entries""",
    "entries"))
def amount_bucket(spark, sf_dir):
    return entries(spark, sf_dir).select(
        "row_ord", F.col("amount").cast("double").alias("amount"),
        money.amount_bucket(F.col("amount")).alias("bucket"))


@register("classify_rules", duck.query("""
    select row_ord, description, tx_type, category, confidence, classified_by from classed""",
    "std", classed=duck.classified("std")))
def classify_rules(spark, sf_dir):
    return classify(frames.standard(spark, sf_dir)).select(
        "row_ord", "description", "tx_type", "category", "confidence", "classified_by")


SANITISE_ROW = {
    "o_orderkey": "o_orderkey",
    "value": choose("o_orderkey % 4", ["cast('NaN' as double)", "cast('Infinity' as double)",
                                       "cast('-Infinity' as double)", "o_totalprice"]),
    "note": "o_orderpriority",
}


@register("sanitize", duck.query("""
    select o_orderkey, case when isnan(value) or isinf(value) then null else value end as value,
           note from cells""", cells=derive_sql("orders", SANITISE_ROW)))
def sanitize(spark, sf_dir):
    from tallyspark.operators.ledger import sanitise
    return sanitise(derive(table(spark, sf_dir, "orders"), SANITISE_ROW))
