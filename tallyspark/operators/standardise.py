"""Raw entries to standardised transactions."""

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions.once import with_once
from tallyspark.functions.labels import detect_bank, detect_channel
from tallyspark.functions.text import clean_description, extract_merchant, without_references
from tallyspark.schema import MONEY, STANDARD


def fingerprint():
    """Identity of a transaction: hash of date, amount and the first 60 characters."""
    return F.sha2(F.concat_ws("|", F.col("tx_date").cast("string"),
                              F.col("amount").cast(MONEY).cast("string"),
                              F.substring("raw_desc", 1, 60)), 256)


def standardise(entries: DataFrame) -> DataFrame:
    """Clean the description, read labels off it, drop unusable entries.

    One narrow projection: no shuffle, and every expression stays in generated code.
    """
    usable = (
        entries
        .withColumn("raw_desc", F.coalesce("raw_desc", F.lit("")))
        .withColumn("amount", F.abs(F.coalesce(F.col("amount").cast(MONEY),
                                               F.lit(0).cast(MONEY))))
        .withColumn("balance", F.col("balance").cast(MONEY))
        # A description is empty exactly where its raw text is.
        .where(F.col("tx_date").isNotNull() & (F.col("amount") > 0)
               & (F.col("raw_desc") != "")))
    # Filters on the description must not repeat its patterns below. Labels are plain columns,
    # so that those nobody reads are not computed.
    raw = F.col("raw_desc")
    named = (with_once(usable, "_kept", without_references(raw))
             .withColumns({"description": clean_description(raw, F.col("_kept")),
                           "channel": detect_channel("raw_desc"),
                           "merchant": extract_merchant(raw),
                           "bank": detect_bank("raw_desc"),
                           "fingerprint": fingerprint()}))
    return named.select(*STANDARD)
