"""Cleaning: noise rows, normalisation, ordered deduplication, missing values, validation."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.money import normal_type
from tallyspark.functions.text import fill, is_noise, normalise_description
from tallyspark.operators.blocks import carry_forward
from tallyspark.schema import MONEY


def remove_noise(tx: DataFrame) -> DataFrame:
    return tx.where(~F.coalesce(is_noise(F.col("description")), F.lit(False)))


def normalise_amounts(tx: DataFrame) -> DataFrame:
    """Positive two-place amounts, debit/credit types, two-place balances."""
    return (tx.withColumn("amount", F.round(F.abs("amount"), 2).cast(MONEY))
            .where(F.col("amount") > 0)
            .withColumn("tx_type", normal_type(F.col("tx_type")))
            .withColumn("balance", F.col("balance").try_cast(MONEY)))


def normalise_descriptions(tx: DataFrame) -> DataFrame:
    return tx.withColumn("description", normalise_description(F.col("description")))


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """First row per key.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so each
    map task sends one row per key however many copies a key has.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def drop_exact_duplicates(tx: DataFrame) -> DataFrame:
    return keep_first(tx, ["user_id", "fingerprint"], ["row_ord", "upload_id"])


def drop_near_duplicates(tx: DataFrame) -> DataFrame:
    """Same user, date, amount and opening 40 characters, whatever the case."""
    near = F.trim(F.lower(F.substring("description", 1, 40)))
    return keep_first(tx.withColumn("_near", near),
                      ["user_id", "tx_date", "amount", "_near"],
                      ["row_ord", "upload_id"]).drop("_near")


def deduplicate(tx: DataFrame) -> DataFrame:
    return drop_near_duplicates(drop_exact_duplicates(tx))


def fill_missing(tx: DataFrame) -> DataFrame:
    """Carry balances forward in file order; stand-ins for missing text."""
    filled = carry_forward(tx, "balance", ["user_id", "upload_id"], "row_ord")
    return filled.fillna({"description": "Unknown Transaction", "channel": "Unknown",
                          "merchant": ""})


def newest_first(tx: DataFrame) -> DataFrame:
    return tx.orderBy(F.desc("tx_date"), F.desc("amount"), "row_ord", "upload_id")


def clean_transactions(tx: DataFrame,
                       cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """All cleaning stages in order. Rows are left unordered; see ``newest_first``.

    Carrying balances forward reads its input twice. ``cut`` (such as
    ``sinks.materialise``) may store the deduplicated rows in between, which spares
    the second run of the earlier stages on large data.
    """
    for stage in (remove_noise, normalise_amounts, normalise_descriptions, deduplicate):
        tx = tx.transform(stage)
    return fill_missing(cut(tx, "deduplicated") if cut else tx)


def validation_report(tx: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """One row per user: size, range, totals, null counts and warnings.

    ``uploads`` (a frame with user_id) adds users of whom no row is left.
    """
    def total(kind):
        return F.coalesce(F.sum(F.when(F.col("tx_type") == kind, F.col("amount"))),
                          F.lit(0)).cast(MONEY)

    checked = [c for c in tx.columns if c not in ("user_id", "upload_id", "row_ord")]
    report = tx.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("tx_date").alias("start_date"),
        F.max("tx_date").alias("end_date"),
        total("debit").alias("total_debits"),
        total("credit").alias("total_credits"),
        F.count_if(F.col("amount") <= 0).alias("_bad_amounts"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in checked])
    if uploads is not None:
        counts = ["total_rows", "total_debits", "total_credits", "_bad_amounts",
                  *[f"null_{c}" for c in checked]]
        report = (uploads.select("user_id").distinct().join(report, "user_id", "left")
                  .fillna(0, counts))
    texts = V.VALIDATION_WARNINGS
    warnings = F.array_compact(F.array(
        F.when(F.col("total_rows") == 0, texts["empty"]),
        F.when(F.col("null_tx_date") > 0,
               fill(texts["dates"], n=F.col("null_tx_date").cast("string"))),
        F.when(F.col("_bad_amounts") > 0,
               fill(texts["amounts"], n=F.col("_bad_amounts").cast("string"))),
        F.when((F.col("total_credits") > 0) & (F.col("total_debits") == 0),
               texts["all_credits"])))
    return report.withColumn("warnings", warnings).drop("_bad_amounts")
