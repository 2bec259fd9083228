"""Incremental ingestion with Structured Streaming.

New statement files (or table rows) arrive as micro-batches; every batch is
standardised, cleaned, classified and appended to the store, skipping transactions
whose fingerprint the store already has. Uniqueness has no time limit, so it is
checked against the store and not against stream state.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.operators.clean import clean_transactions
from tallyspark.operators.ledger import new_transactions
from tallyspark.operators.pipeline import annotate, run_pipeline
from tallyspark.operators.sinks import (by_month, held, materialise, month_of, paths_like,
                                        same_months, shared_folder)
from tallyspark.operators.stores import add_to_state
from tallyspark.operators.standardise import standardise
from tallyspark.plans.tables import derive, entry_columns
from tallyspark.sources.statements import describe_files


def table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table, one file or a folder of parts, as a stream of entries."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    # A pattern, as the stream takes any other path for a folder.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parque[t]")
    return derive(rows, entry_columns("spark"))


def file_stream(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """New statement files under ``<folder>/<user>/`` as described files."""
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
             .load(folder))
    return describe_files(files)


def prepare(entries: DataFrame) -> DataFrame:
    """Entries to the annotated transactions of one batch: all stages of the pipeline."""
    return annotate(clean_transactions(standardise(entries), materialise))


def append_batch(batch: DataFrame, batch_id: int, store: str, state: str | None = None) -> None:
    """Append what is new. A batch that is retried replaces its own folder only, so a
    transaction is stored once however often its batch runs. The batch is computed once; of
    the store, only its months are read. ``state`` names a store of monthly totals that the
    new transactions are added to, once a batch."""
    spark = batch.sparkSession
    target = f"{store}/batch={batch_id}"
    with held(batch, "stream-batch") as fresh:
        if paths_like(spark, store):
            schema = batch.withColumn("batch", F.lit(0)).withColumn("month", month_of()).schema
            earlier = spark.read.schema(schema).option("basePath", store).parquet(store)
            fresh = new_transactions(fresh, same_months(earlier, fresh)
                                     .where(F.col("batch") < batch_id))
        by_month(fresh).write.mode("overwrite").partitionBy("month").parquet(target)
    if state:
        add_to_state(spark.read.schema(batch.schema).parquet(target), state, batch=batch_id)


def run_available(entries: DataFrame, store: str | None = None,
                  progress: str | None = None) -> DataFrame:
    """Process all entries available now and return the stored transactions."""
    spark = entries.sparkSession
    store = store or shared_folder(spark, "stream-store")
    progress = progress or shared_folder(spark, "stream-progress")
    query = (entries.writeStream.option("checkpointLocation", progress)
             .foreachBatch(lambda batch, i: append_batch(prepare(batch), i, store))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(store).drop("batch", "month")


def run_files(files: DataFrame, store: str, status: str, progress: str,
              state: str | None = None) -> None:
    """Process new statement files; one status row per file is kept beside the store.

    A file is processing, then complete, or failed with its reason. Rows of a batch that is
    run again replace its own. ``state`` as in :func:`append_batch`.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        known = materialise(batch, "stream-files")
        target = f"{status}/batch={batch_id}"
        done = run_pipeline(known, materialise)
        columns = done.uploads.columns
        waiting = known.withColumn("status", F.when(F.col("status") == "pending", "processing")
                                   .otherwise(F.col("status")))
        (waiting.select(*[F.col(c) if c in waiting.columns else
                          F.lit(None).cast(dict(done.uploads.dtypes)[c]).alias(c)
                          for c in columns]).write.mode("overwrite").parquet(target))
        append_batch(done.transactions, batch_id, store, state)
        done.uploads.write.mode("overwrite").parquet(target)

    query = (files.writeStream.option("checkpointLocation", progress)
             .foreachBatch(handle).trigger(availableNow=True).start())
    query.awaitTermination()
