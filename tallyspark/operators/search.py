"""Fuzzy search of transaction descriptions."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions.once import with_once
from tallyspark.functions.text import trigram_similarity, trigrams
from tallyspark.operators import postings


def trigram_search(tx: DataFrame, text: str, threshold: float = 0.3) -> DataFrame:
    """Descriptions similar to a text, with their similarity and number of uses.

    The text's trigrams are a constant, so every description is scored on its own:
    no pairs, no join. Equal descriptions are counted before they are scored.
    """
    uses = tx.groupBy("description").agg(F.count(F.lit(1)).alias("n"))
    score = trigram_similarity(trigrams(F.col("description")), trigrams(F.lit(text)))
    return (with_once(uses, "similarity", F.round(score, 6))
            .where(F.col("similarity") >= threshold))


def _words(col: Column) -> Column:
    """The words that trigrams are cut from, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many texts hold a trigram of each bucket; ``rows`` has their ``words``."""
    counts = (rows.select("words").mapInArrow(lambda b: postings.bucket_counts(b),
                                              "bucket long, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(postings.BUCKETS, np.int64)
    for r in counts:
        total[r.bucket] = r.n
    return total


def _postings(rows: DataFrame, counts: np.ndarray, asked: np.ndarray | None,
              threshold: float) -> DataFrame:
    """(gram, bucket, key, size, place, sketch_0 ...) from (key, words), without a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast((counts, asked))
    sketch = ", ".join(f"sketch_{w} long" for w in range(postings.SKETCH_WORDS))
    return rows.select("key", "words").mapInArrow(
        lambda b: postings.rare_postings(b, *shared.value, threshold),
        f"gram long, bucket long, key long, size long, place long, {sketch}")


def _may_reach(threshold: float) -> Column:
    """False for postings ``l`` and ``r`` of one trigram only if their texts cannot be similar
    or share a rarer trigram.

    Two texts share at most the trigrams from their first common one on, and at most those of
    either text whose bit the other has too.
    """
    needed = f"ceil((l.size + r.size) * {threshold / (1 + threshold)!r}D - 1e-9D)"

    def missing(one: str, other: str) -> str:
        return " + ".join(f"bit_count({one}.sketch_{w} & ~{other}.sketch_{w})"
                          for w in range(postings.SKETCH_WORDS))

    return F.expr(" and ".join(
        [f"r.size >= l.size * {threshold!r}D - 1e-9D", f"l.size >= r.size * {threshold!r}D - 1e-9D"]
        + [f"{side}.size - {side}.place + 1 >= {needed}" for side in "lr"]
        + [f"l.size - ({missing('l', 'r')}) >= {needed}",
           f"r.size - ({missing('r', 'l')}) >= {needed}"]))


def search_many(texts: DataFrame, searches: DataFrame, threshold: float = 0.5,
                text_col: str = "description", search_col: str = "search",
                cut=lambda df, name: df) -> DataFrame:
    """(search, text, similarity, n): all pairs of a distinct search and a distinct text whose
    trigram similarity reaches the threshold, with the text's number of uses.

    A text as similar as that shares one of a search's rarest trigrams, and its number of
    trigrams lies within the threshold; so only postings of rare trigrams are joined, and of the
    texts' only those of trigrams that a search's postings may have. Pairs whose
    places and sketches rule the threshold out are left in the join, and what is left is verified
    on whole trigram sets. Texts without a letter or digit are found by none.
    ``cut`` stores frames that several steps read: texts once, without their trigrams.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1")

    def worded(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col(f"{name}_key").alias("key"), _words(F.col(name)).alias("words"))

    uses = texts.groupBy(F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    stored = cut(uses.where(_words(F.col("text")) != "")
                 .withColumn("text_key", F.monotonically_increasing_id()), "texts")
    asked = cut(searches.select(F.col(search_col).alias("search")).distinct()
                .where(_words(F.col("search")) != "")
                .withColumn("search_key", F.monotonically_increasing_id()), "searches")
    counts = _bucket_counts(worded(stored, "text"))
    left = cut(_postings(worded(asked, "search"), counts, None, threshold), "asked")
    wanted = np.zeros(postings.BUCKETS, bool)
    wanted[[r.bucket for r in left.select("bucket").distinct().collect()]] = True
    right = _postings(worded(stored, "text"), counts, wanted, threshold)
    met = cut(left.alias("l").join(right.alias("r"), F.col("l.gram") == F.col("r.gram"))
              .where(_may_reach(threshold))
              .select(F.col("l.key").alias("search_key"), F.col("r.key").alias("text_key"))
              .distinct(), "pairs")
    # Trigrams are made of the texts that met, after the join, so texts alone are moved.
    both = stored.join(met, "text_key").join(asked, "search_key")
    exact = trigram_similarity(trigrams(F.col("search")), trigrams(F.col("text")))
    return (with_once(both, "exact", exact).where(F.col("exact") >= threshold)
            .select("search", "text", F.round("exact", 6).alias("similarity"), "n"))
