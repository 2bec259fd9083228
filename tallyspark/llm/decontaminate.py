"""Benchmark decontamination by spaced seeds. Main path: DataFrame expressions only.

A seed is the hash of a few tokens at the fixed offsets of a mask; tokens between the offsets
are ignored, so a replaced word spoils few seeds. Seeds of the benchmark are joined with seeds
of all document positions; around each hit the whole item is laid over the document on that
diagonal and compared word by word.

A document overlaps an item if, on one diagonal,

* at least ``IDENTITY`` percent of the item's words are at their places (all of them if the
  item has fewer than ``SPAN``), or
* some stretch scores ``STRETCH`` or more (a word in place: +1, a wrong one: -2).

Words are runs of letters and digits in lower case; in scripts written without spaces each
letter is a word. Items of fewer than ``SPAN`` words are searched by one unspaced seed over all
their words; only items without a word are ignored.
Equal items are searched once: ``item_id`` is the smallest id and ``n_items`` their number.

Documents are exploded to positions, hashed and probed inside one generated stage; only hits
leave it, so nothing of the corpus is shuffled but hits. A short item that occurs many times in a
document leaves the stage once. The seed table is broadcast if it has at most ``BROADCAST_SEEDS``
rows (some 32 bytes each); with a larger one (text digest, position, seed) is shuffled to its seed,
and the words of the texts that were hit come by a second join, once a text.

``overlaps`` reports every overlap. ``remove_overlapping`` takes an item of fewer than
``EVIDENCE`` words as evidence only where it stands alone as a line of the document: words like
"yes" or "New York" within a sentence show no leak.

Defined cases: null or empty texts overlap nothing; a null ``doc_id`` is a key like others;
repeated rows of a document give one row; other columns are not read.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: Offsets of the tokens that count. No text that the verifier accepts is missed by all of them:
#: a text of five words or more that none hits has less than ``IDENTITY`` percent of its words
#: in place, and no stretch of it scores above 3 (worked out over all texts in the tests).
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4))
LEAST_TOKENS = 1
IDENTITY = 75
STRETCH = 12
BROADCAST_SEEDS = 2_000_000
#: Items of this many words or more may have words replaced.
SPAN = 5
#: Items of fewer words remove a document only as a whole line of it. Of the 10,000 documents of
#: table 0.1, the first one, two, three, four and five words of its benchmark items lie in 9,869,
#: 5,773, 342, 248 and 247, and the first fifteen words in as many as five.
EVIDENCE = 4

# Scripts written without spaces, read character by character.
UNSPACED = (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}"
            r"\p{IsMyanmar}]")


def token_hashes(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")
                  ).otherwise(text)
    tokens = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def seeds_at(tokens: Column, i: Column, masks, sizes=None) -> Column:
    """One hash for each mask laid at position ``i``; null where the mask passes the end or its
    condition in ``sizes`` fails."""
    fits = [i + (mask[-1] + 1) <= F.size(tokens) for mask in masks]
    if sizes:
        fits = [fit & size for fit, size in zip(fits, sizes)]
    return F.array(*[
        F.when(fit, F.xxhash64(F.lit(k), *[F.get(tokens, i + o) for o in mask]))
        for k, (fit, mask) in enumerate(zip(fits, masks))])


def seeds(tokens: DataFrame, masks, least: int, sizes=None) -> DataFrame:
    """(all columns, at, seed) for every position; ``h`` holds the token hashes."""
    at = tokens.where(F.size("h") >= least).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("at"))
    return (at.select("*", F.explode(seeds_at(F.col("h"), F.col("at"), masks, sizes)).alias("seed"))
            .where("seed is not null"))


def best_stretch(same: Column) -> Column:
    """Highest score of a stretch: +1 for a word in place, -2 for another."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc, hit):
        now = F.greatest(acc["now"] + F.when(hit, 1).otherwise(-2), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))
    return F.aggregate(same, start, step, lambda acc: acc["best"])


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct items: smallest id, number of equal ones, token hashes."""
    return (benchmark.select(F.col(item_col).alias("item"),
                             token_hashes(F.col(text_col)).alias("h"))
            .where(F.size("h") >= LEAST_TOKENS).groupBy("h")
            .agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n_items"))
            .select(F.xxhash64("h").alias("item_key"), "item", "n_items", F.col("h").alias("ih")))


def diagonal() -> Column:
    """Where the item would start if its seed lay on the document's."""
    return (F.col("at") - F.col("item_at")).alias("token_start")


def once_a_text(hits: DataFrame, *keys: str) -> DataFrame:
    """One row for each diagonal of an item; an item of fewer than ``SPAN`` words matches whole
    wherever its seed hits, so its first place stands for all. Reduced before the exchange."""
    place = F.when(F.col("item_size") >= SPAN, F.col("token_start"))
    return (hits.groupBy(*keys, "item_key", "item_size", place.alias("place"))
            .agg(F.min("token_start").alias("token_start")).drop("place"))


def alone_on_a_line(documents: DataFrame, items: DataFrame, keys: list[str],
                    text_col: str) -> DataFrame:
    """Keys of the documents with a line that is an item of fewer than ``EVIDENCE`` words."""
    weak = items.where(F.size("ih") < EVIDENCE).select(F.col("ih").alias("line_h"))
    n = weak.count()
    if not n:
        return documents.select(*keys).limit(0)
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\r\n]+"), token_hashes)
    short = F.filter(lines, lambda h: F.size(h).between(1, EVIDENCE - 1))
    return (documents.select(*keys, F.explode(short).alias("line_h"))
            .join(F.broadcast(weak) if n <= BROADCAST_SEEDS else weak, "line_h", "left_semi")
            .select(*keys))


def overlaps(documents: DataFrame, benchmark: DataFrame, keys=("doc_id",), text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and distinct item that overlap: the document's ``keys``,
    ``item_id``, ``n_items``, ``item_tokens``, ``matched`` (words in place on the best
    diagonal), ``stretch`` (its best score) and ``token_start`` (where the item would start)."""
    items = items_of(benchmark, item_col, item_text_col)
    # Masks over whole items of fewer than SPAN words, each for the items of its length alone.
    short = sorted(r[0] for r in items.select(F.size("ih")).where(F.size("ih") < SPAN)
                   .distinct().collect())
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    sizes = [F.size("ih") >= SPAN] * len(MASKS) + [F.size("ih") == n for n in short]
    least = min(mask[-1] for mask in masks) + 1
    table = (seeds(items.withColumn("h", F.col("ih")), masks, least, sizes)
             .select("seed", "item_key", F.col("at").alias("item_at"),
                     F.size("ih").alias("item_size")).distinct())
    docs = documents.select(*[F.col(k).alias(f"key{n}") for n, k in enumerate(keys)],
                            F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"),
                            token_hashes(F.col(text_col)).alias("h"))
    ids = [f"key{n}" for n in range(len(keys))]
    if table.count() <= BROADCAST_SEEDS:
        found = (seeds(docs, masks, least).join(F.broadcast(table), "seed")
                 .select(*ids, "h", "item_key", "item_size", diagonal()))
    else:
        found = (seeds(docs, masks, least).select("text_md5", "at", "seed").join(table, "seed")
                 .select("text_md5", "item_key", "item_size", diagonal()))
        found = docs.join(once_a_text(found, "text_md5"), "text_md5")
    start = F.col("token_start")
    # The part of the document below the item, cut at the document's ends.
    under = F.slice("h", F.greatest(start, F.lit(0)) + 1,
                    F.greatest(F.least(F.col("item_size") + F.least(start, F.lit(0)),
                                       F.size("h")), F.lit(0)))
    hits = once_a_text(found.select(*ids, "item_key", "item_size", start, under.alias("under")),
                       *ids, "under")
    shift = F.greatest(-F.col("token_start"), F.lit(0))
    laid = (hits.join(items, "item_key")
            .withColumn("same", F.transform("ih", lambda t, k: F.coalesce(
                t == F.get("under", k - shift), F.lit(False))))
            .select(*ids, "item", "n_items", "token_start",
                    F.size("same").cast("long").alias("item_tokens"),
                    F.size(F.filter("same", lambda x: x)).cast("long").alias("matched"),
                    best_stretch(F.col("same")).cast("long").alias("stretch"))
            .where((100 * F.col("matched") >= F.col("item_tokens")
                    * F.when(F.col("item_tokens") < SPAN, 100).otherwise(IDENTITY))
                   | (F.col("stretch") >= STRETCH)))
    best = (laid.groupBy(*ids, "item", "n_items", "item_tokens")
            .agg(F.max(F.struct("matched", "stretch", -F.col("token_start"))).alias("best")))
    return best.select(*[F.col(f"key{n}").alias(k) for n, k in enumerate(keys)],
                       F.col("item").alias("item_id"), "n_items", "item_tokens",
                       F.col("best.matched").alias("matched"),
                       F.col("best.stretch").alias("stretch"),
                       (-F.col("best.col3")).cast("long").alias("token_start"))


def remove_overlapping(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text") -> DataFrame:
    """The documents that overlap no item, all columns kept; an item of fewer than ``EVIDENCE``
    words counts only as a line of its own. Rows are told apart by id and the digest of their
    text, so equal or null ids of different texts do no harm."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    known = documents.select(F.col(id_col).alias("k_id"), digest.alias("k_md5"),
                             F.col(text_col).alias("k_text"))
    keys = ["k_id", "k_md5"]
    strong = (overlaps(known, benchmark.where(F.size(token_hashes(F.col(item_text_col)))
                                              >= EVIDENCE),
                       tuple(keys), "k_text", item_col, item_text_col).select(*keys))
    weak = alone_on_a_line(known, items_of(benchmark, item_col, item_text_col), keys, "k_text")
    found = strong.unionByName(weak).distinct()
    return documents.join(found, documents[id_col].eqNullSafe(found["k_id"])
                          & (digest == found["k_md5"]), "left_anti")
