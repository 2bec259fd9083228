"""What the corpus operators share: shared storage, shipping the package, word splitting."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Separators of words: space and the ASCII controls tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a one-machine session (``local[...]``) without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once, survives lost
    executors and has no lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a frame as a bucketed table in the shared folder and read it back: joins on ``key``
    leave its rows where they are and shuffle the other side alone."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, name)
    table = f"corpus_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
     .option("path", path).saveAsTable(table))
    return spark.table(table)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that no frame in use reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_corpus_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "tallyspark_llm.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder in (top, os.path.join(top, "llm")):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name),
                              os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    context.addPyFile(path)
    context._corpus_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A prefix like ``name`` that no column starts with."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that Spark computes once a row, whatever refers to it later."""
    return df.select("*", F.explode(F.array(value)).alias(name))
