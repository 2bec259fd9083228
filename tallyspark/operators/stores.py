"""Tables that are rewritten by parts: versioned buckets of users, and monthly running totals.

Users are hashed to buckets. A write reads and writes the buckets of its users only, as a new
version, and then a manifest of one row that says which version each bucket has. Readers follow
the newest complete manifest, so a failed or running write changes nothing for them, and the
buckets it doesn't touch keep their files. The manifest is bounded by the number of buckets, which
is fixed when the store is made; it is all that reaches the driver. One writer at a time.

A batch with a number is merged once: a number that is not above the last one is skipped, so a
stream may run a batch again.
"""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from tallyspark.operators import ledger, summary
from tallyspark.operators.sinks import dropped, held, paths_like
from tallyspark.schema import MONEY

#: Buckets of a new store. More make smaller rewrites and more files.
BUCKETS = 256
MANIFEST = ("version long, batch long, buckets int, row_schema string, "
            "places map<int, long>")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete, oldest first."""
    done = paths_like(spark, f"{path}/manifest/version=*/_SUCCESS")
    return sorted(int(p.split("version=")[-1].split("/")[0]) for p in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Row | None:
    """The manifest of a version, by default the newest; None for a store not yet written."""
    known = versions(spark, path)
    if not known:
        return None
    chosen = known[-1] if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={chosen}").first()


def _rows(spark: SparkSession, path: str, found: Row, buckets=None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(found.row_schema))
    folders = [f"{path}/rows/version={v}/bucket={b}" for b, v in sorted(found.places.items())
               if buckets is None or b in buckets]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of a named one that is still kept."""
    found = manifest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no complete version in {path}")
    return _rows(spark, path, found)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def merge(incoming: DataFrame, path: str,
          merged_by: Callable[[DataFrame, DataFrame], DataFrame],
          users: DataFrame | None = None, batch: int | None = None,
          buckets: int = BUCKETS) -> None:
    """Write ``merged_by(stored, incoming)`` for the buckets of the incoming rows (and of
    ``users``); it sees the stored rows of these buckets only. The batch is computed once."""
    spark = incoming.sparkSession
    last = manifest(spark, path)
    if last and batch is not None and last.batch is not None and batch <= last.batch:
        return
    buckets = last.buckets if last else buckets
    version = last.version + 1 if last else 0
    with held(incoming, "merge") as fresh:
        of_users = fresh.select("user_id")
        if users is not None:
            of_users = of_users.unionByName(users.select("user_id"))
        touched = {r[0] for r in of_users.select(bucket_of(buckets)).distinct().collect()}
        stored = _rows(spark, path, last, touched) if last else fresh.limit(0)
        target = f"{path}/rows/version={version}"
        (merged_by(stored, fresh).select(*incoming.columns, bucket_of(buckets).alias("bucket"))
         .hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(target))
    filled = {int(p.rsplit("bucket=", 1)[1]) for p in paths_like(spark, f"{target}/bucket=*")}
    places = {b: v for b, v in (last.places if last else {}).items() if b not in touched}
    places |= {b: version for b in filled}
    newest = batch if batch is not None else last.batch if last else None
    row = (version, newest, buckets, last.row_schema if last else incoming.schema.json(), places)
    (spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite")
     .parquet(f"{path}/manifest/version={version}"))


def upsert(incoming: DataFrame, path: str, keys: list[str], **options) -> None:
    """Incoming rows replace stored rows with the same keys, ``user_id`` among them."""
    merge(incoming, path, lambda old, new: ledger.upsert(old, new, keys), **options)


def replace(incoming: DataFrame, path: str, users: DataFrame, **options) -> None:
    """All rows of the users are replaced by the incoming ones."""
    merge(incoming, path, lambda old, new: ledger.replace_for_users(old, new, users),
          users=users, **options)


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the manifests before the newest ``keep`` and the versions of rows that no kept
    manifest names. For times without readers of those."""
    known = versions(spark, path)
    kept = known[-keep:]
    used = {v for k in kept for v in manifest(spark, path, k).places.values()} | set(kept)
    for version in known[:-keep]:
        dropped(spark, f"{path}/manifest/version={version}")
    for folder in paths_like(spark, f"{path}/rows/version=*"):
        if int(folder.rsplit("version=", 1)[1]) not in used:
            dropped(spark, folder)


# -- monthly running totals --------------------------------------------------

STATE_KEYS = ["user_id", "month", "category", "tx_type"]


def month_state(tx: DataFrame) -> DataFrame:
    """What summaries need of a batch: a row for each user, month, category and type."""
    return tx.groupBy("user_id", F.trunc("tx_date", "month").alias("month"), "category",
                      "tx_type").agg(
        F.sum("amount").cast("decimal(28,2)").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.min("tx_date").alias("first_day"), F.max("tx_date").alias("last_day"))


def merged_states(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.unionByName(fresh).groupBy(*STATE_KEYS).agg(
        F.sum("total").cast("decimal(28,2)").alias("total"), F.sum("n").alias("n"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def add_to_state(tx: DataFrame, path: str, **options) -> None:
    """Add a batch of new transactions, of late months too; the history isn't read again."""
    merge(month_state(tx), path, merged_states, **options)


def _income_and_expenses() -> list[Column]:
    return [summary.sum_where(summary.IS_CREDIT, "total").alias("total_income"),
            summary.sum_where(summary.IS_DEBIT, "total").alias("total_expenses")]


def monthly_summary(state: DataFrame) -> DataFrame:
    """As :func:`summary.monthly_summary` over all transactions of the state."""
    signed = F.when(F.expr(summary.IS_CREDIT), F.col("total")).otherwise(-F.col("total"))
    return state.groupBy("user_id", "month").agg(
        *_income_and_expenses(), F.sum(signed).cast(MONEY).alias("net_savings"),
        F.sum("n").alias("tx_count"))


def category_spend(state: DataFrame) -> DataFrame:
    """As :func:`summary.category_spend`."""
    names = summary.categories(state.sparkSession).select("slug", F.col("name").alias("_name"))
    spend = state.where(summary.IS_DEBIT)
    return (spend.join(F.broadcast(names), spend.category == names.slug)
            .select("user_id", "month", F.col("_name").alias("category"), "slug",
                    F.col("total").cast(MONEY).alias("total"), F.col("n").alias("tx_count")))


def period_summary(state: DataFrame) -> DataFrame:
    """As :func:`summary.period_summary`."""
    return summary.with_rate(state.groupBy("user_id").agg(
        *_income_and_expenses(), F.min("first_day").alias("period_start"),
        F.max("last_day").alias("period_end"), F.sum("n").alias("tx_count")))
