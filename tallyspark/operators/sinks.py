"""Parquet stores with the write rules of the ledger.

A store is a folder of parquet. A rewrite goes to a new folder beside the old one,
so a lost executor or a failed job leaves the old version readable.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.operators.ledger import new_transactions, replace_for_users, upsert


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder that the cluster names.

    Only a one-machine session (``local[...]``) without that setting gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        root = tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallyspark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several consumers read, and read it back.

    Its files outlive any executor, and every consumer scans only its own columns. They lie
    below the folder's ``tallyspark`` and belong to the caller, who drops them with the job's
    other checkpoints once no frame made from them is read any more.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [status.getPath().toString() for status in found]


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no frame in use reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A frame that is computed once, written to the shared folder, and deleted at the end of
    the block; what is made from it must be written before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        dropped(df.sparkSession, path)


def month_of() -> Column:
    """Partition of a transaction in a store."""
    return F.coalesce(F.date_format("tx_date", "yyyy-MM"), F.lit("none"))


def same_months(store: DataFrame, tx: DataFrame) -> DataFrame:
    """The rows of a store, partitioned by ``month``, in the months of ``tx``, which is read
    twice: give a stored frame. The join is on the partition column, so Spark prunes the store's
    partitions by the months it finds at run time. The months are broadcast: the calendar bounds
    them, twelve for each year from 1 to 9999."""
    months = tx.select(month_of().alias("month")).where("month > ''").distinct()
    return store.join(F.broadcast(months), "month", "left_semi")


def by_month(tx: DataFrame) -> DataFrame:
    """Rows with their ``month``, together by month: few files each, and adaptive execution
    splits a month too large for one task."""
    return tx.withColumn("month", month_of()).hint("rebalance", "month")


def append_transactions(tx: DataFrame, path: str, exists: bool = True) -> None:
    """Append the transactions whose fingerprint is new for their user.

    The incoming rows are computed once. Equal fingerprints have equal dates, so of the store,
    partitioned by month, only the months of the incoming rows are read.
    """
    with held(tx, "append") as batch:
        known = same_months(stored_months(tx, path), batch) if exists else batch.limit(0)
        (by_month(new_transactions(batch, known))
         .write.mode("append").partitionBy("month").parquet(path))


def stored_months(tx: DataFrame, path: str) -> DataFrame:
    """A store of transactions like ``tx``; its months are text."""
    return tx.sparkSession.read.schema(tx.withColumn("month", month_of()).schema).parquet(path)


def write_upsert(spark: SparkSession, old_path: str | None, new_path: str, incoming: DataFrame,
                 keys: list[str]) -> None:
    """Write the merged table to a new folder."""
    merged = incoming if old_path is None else upsert(spark.read.parquet(old_path), incoming,
                                                      keys)
    merged.write.mode("errorifexists").parquet(new_path)


def write_replacement(spark: SparkSession, old_path: str, new_path: str, incoming: DataFrame,
                      users: DataFrame) -> None:
    """Write the table with the users' rows replaced to a new folder."""
    merged = replace_for_users(spark.read.parquet(old_path), incoming, users)
    merged.write.mode("errorifexists").parquet(new_path)
