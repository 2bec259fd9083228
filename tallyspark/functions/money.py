"""Money expressions: parsing, formatting, debit/credit merging."""

from pyspark.sql import Column, functions as F

from tallyspark.functions import fixed_values as V

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: The same over a whole cell, which then needs no other search.
PLAIN_NUMBER = NUMBER.replace("$", r"\z")


def parse_money(text: Column) -> Column:
    """Number in a statement cell; 0 where there is none, null for an empty (NaN) cell."""
    bare = F.regexp_replace(text, r"[₦,\s\u00A0]", "")
    number = F.regexp_extract(F.regexp_replace(bare, "(?i)(DR|CR)$", ""), NUMBER, 0)
    return (F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
            .when(text.isNotNull() & (F.lower(F.trim(text)) != "nan"),
                  F.coalesce(number.try_cast("double"), F.lit(0.0))))


def naira(amount: Column, show_sign: bool = False) -> Column:
    """₦1,234.50, with a leading + or - if asked for."""
    if not show_sign:
        return F.concat(F.lit("₦"), F.format_number(amount, 2))
    sign = F.when(amount >= 0, "+").otherwise("-")
    return F.concat(sign, F.lit("₦"), F.format_number(F.abs(amount), 2))


def plain_number(value: Column, places: int) -> Column:
    """Fixed-point text without thousands separators, ties to even."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def rounded(value: Column, places: int) -> Column:
    """Round by the exact value of the double, ties to even."""
    return plain_number(value, places).cast("double")


def signed_amount(text: Column, value: Column | None = None) -> Column:
    """(amount, tx_type) of one cell: negative or DR or bare is debit, CR is credit.

    ``value``, if given, is a column of :func:`parse_money`.
    """
    value = parse_money(text) if value is None else value
    return F.struct(
        F.abs(value).alias("amount"),
        F.when(value < 0, "debit")
        .when(F.coalesce(text, F.lit("")).rlike(r"(?i)cr\b"), "credit")
        .otherwise("debit").alias("tx_type"))


def split_amounts(debit: Column, credit: Column) -> Column:
    """(amount, tx_type) of separate debit and credit numbers."""
    is_debit = F.coalesce(debit, F.lit(0.0)) > 0
    return F.struct(F.when(is_debit, debit).otherwise(credit).alias("amount"),
                    F.when(is_debit, "debit").otherwise("credit").alias("tx_type"))


def typed_amount(amount: Column, kind: Column) -> Column:
    """(amount, tx_type) of an amount beside a type column."""
    is_credit = F.coalesce(F.lower(F.trim(kind)), F.lit("")).rlike(V.TYPE_COLUMN_CREDIT)
    return F.struct(amount.alias("amount"),
                    F.when(is_credit, "credit").otherwise("debit").alias("tx_type"))


def normal_type(kind: Column) -> Column:
    return F.when(F.lower(F.trim(kind)).isin(*V.CREDIT_WORDS), "credit").otherwise("debit")


def amount_bucket(amount: Column) -> Column:
    """Amount to the nearest hundred, halves to the even hundred."""
    return (F.bround(amount / F.lit(100), 0) * 100).cast("bigint")


def finite(value: Column) -> Column:
    """Null in place of NaN and infinities."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)
