"""From statement files to annotated transactions and a record of every upload."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators.classify import classify
from tallyspark.operators.clean import (clean_transactions, keep_first, normalise_amounts,
                                        remove_noise)
from tallyspark.operators.recurring import detect_recurring
from tallyspark.operators.standardise import standardise
from tallyspark.sources import statements

UPLOAD_KEY = ["user_id", "upload_id"]


class Processed(NamedTuple):
    """``transactions`` are cleaned and annotated; ``uploads`` has a row for every file."""

    transactions: DataFrame
    uploads: DataFrame


def load_classifier(spark: SparkSession, path: str):
    """The learned classifier saved at ``path``; None if there is none."""
    from pyspark.ml import PipelineModel
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return PipelineModel.load(path) if there else None


def annotate(tx: DataFrame, model=None) -> DataFrame:
    """Recurring payments, and categories by the learned classifier if there is one."""
    found = detect_recurring(tx)
    if model is None:
        return classify(found)
    from tallyspark.operators.learn import score_classifier
    return score_classifier(found, model)


def run_pipeline(files: DataFrame, cut: Callable[[DataFrame, str], DataFrame] | None = None,
                 model=None, processed_at: Column | None = None,
                 model_path: str | None = None) -> Processed:
    """Read, standardise, clean and annotate described files (see ``statements.read_files``).

    A file that cannot be read, or of which no transaction is left, is a failed upload with
    its reason; the others go on. ``cut`` (such as ``sinks.materialise``) stores frames that
    several steps read. Categories are by ``model``, else by the classifier saved at
    ``model_path`` if there is one, else by the rules.
    """
    if model is None and model_path:
        model = load_classifier(files.sparkSession, model_path)
    keep = cut or (lambda df, name: df)
    scanned = keep(statements.scan(files.where("status = 'pending'")), "scanned")
    standard = keep(standardise(statements.map_rows(scanned)), "standard")
    cleaned = keep(clean_transactions(standard, cut), "cleaned")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*UPLOAD_KEY).agg(F.count(F.lit(1)).alias(name))

    # An upload whose rows another one repeats is no failure: it counts before duplicates go.
    valid = count(normalise_amounts(remove_noise(standard)), "_valid")
    period = cleaned.groupBy(*UPLOAD_KEY).agg(
        F.count(F.lit(1)).alias("tx_count"), F.min("tx_date").alias("period_start"),
        F.max("tx_date").alias("period_end"))
    banks = keep_first(cleaned.where("bank is not null").groupBy(*UPLOAD_KEY, "bank")
                       .agg(F.count(F.lit(1)).alias("_n")), UPLOAD_KEY, [F.desc("_n"), "bank"])
    states = files.select(*UPLOAD_KEY, "filename", "file_type", "file_size_kb",
                          F.col("error_message").alias("_refused"))
    for part in (scanned.select(*UPLOAD_KEY, F.col("error_message").alias("_unread")),
                 count(standard, "_read"), valid, period,
                 banks.select(*UPLOAD_KEY, F.col("bank").alias("bank_detected"))):
        states = states.join(part, UPLOAD_KEY, "left")
    error = F.coalesce("_refused", "_unread", F.when(F.col("_read").isNull(), V.NO_TRANSACTIONS)
                       .when(F.col("_valid").isNull(), V.ALL_REMOVED))
    uploads = states.select(
        *UPLOAD_KEY, "filename", "file_type", "file_size_kb", "bank_detected", "period_start",
        "period_end", F.coalesce("tx_count", F.lit(0)).alias("tx_count"),
        F.when(error.isNull(), "complete").otherwise("failed").alias("status"),
        error.alias("error_message"),
        (F.current_timestamp() if processed_at is None else processed_at).alias("processed_at"))
    return Processed(annotate(cleaned, model), uploads)
