"""A training corpus from ``documents``, in five stages.

Each stage takes what its predecessor kept, as a written Parquet table, and all but the last
return the columns of ``documents``. No stage has a switch for size; see the operators' modules
for what each does with nulls, repeated rows and empty tables.
"""

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspark.llm import decontaminate, neardup, packing, pii, quality  # noqa: E402
from tallyspark.llm.common import read, written  # noqa: E402
from tallyspark.llm.queries import PII_KEY, vocabulary  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut failing lines out; rejected documents go."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 80 percent of five-word shingles stays."""
    return neardup.deduplicate(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.remove_overlapping(docs, read(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses get pseudonyms of their format."""
    return pii.pseudonymise(docs, PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in sequences of at most 2048."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates),
          ("benchmark decontamination", decontamination), ("pii", pseudonyms),
          ("packing", packed)]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
