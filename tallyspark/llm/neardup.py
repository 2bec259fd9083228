"""MinHash near-duplicates with odd sketches.

1. Every text gets its shingle set, ``BANDS * ROWS`` MinHash samples of it, one key for each
   band of ``ROWS`` samples, and an odd sketch: each (sample number, sample) flips one bit of a
   512-bit map. Equal texts (by MD5) form one class; only classes go on.
2. Classes that share a band key meet in a bucket. Each bucket compares all its members with
   one hub, its least class. A pair stays a candidate if its set sizes allow the similarity and
   the XOR of its sketches has few enough ones: ``d`` differing samples flip ``2d`` bits, so the
   population count estimates high similarities closely. ``MOST_ONES`` stands for a similarity
   five standard deviations below the threshold.
3. Candidates are confirmed on their full sets, and links make components.
4. Buckets that still hold several components are compared across components: small ones by
   a join, large ones in blocks of ``BLOCK`` members a side, so that no task holds a bucket.
   Blocks have the full sets, and of a dense group only links that join components leave them.
   So no link is lost that shares a bucket, whatever the hub, and no group is paired out.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8^6)^40 < 6e-6; more similar
pairs far less.

Words are runs of anything but ASCII white space, A-Z in lower case; a text with fewer words
than a shingle is one shingle. Texts without words (null, empty) are linked with nothing.
Repeated rows are classes of equal texts. Null ids are no component's id unless all its ids
are null. Other columns aren't read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.common import fresh, ship, written
from tallyspark.llm.components import components

ROWS, BANDS = 6, 40
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
SIMILARITY = 80  # percent
SMALL_BUCKET = 32
BLOCK = 1024
CACHED_WORDS = 500_000

_words: dict = {}


def most_ones(percent: int) -> int:
    """Population count of the XOR of two sketches that a pair at the threshold exceeds with
    a chance of some 1e-7: mean plus five deviations of samples and of bits."""
    similarity = percent / 100
    flips = 2 * SAMPLES * (1 - similarity)
    stay = math.exp(-2 * flips / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - stay)
    samples = 2 * math.sqrt(SAMPLES * similarity * (1 - similarity)) * stay
    bits = math.sqrt(SKETCH_BITS / 4 * (1 - stay * stay))
    return math.ceil(mean + 5 * math.hypot(samples, bits))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word):
        import xxhash
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    known = _words.setdefault("hashes", _WordHashes())
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        if not words:
            out.append(np.empty(0, "u8"))
            continue
        h = np.fromiter(map(known.__getitem__, words), "u8", len(words))
        width = min(size, len(h))
        n = len(h) - width + 1
        acc = np.full(n, width, "u8")
        for k in range(width):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
        out.append(np.unique(acc))
    return out


class Signer:
    """Band keys and odd sketches of shingle sets."""

    def __init__(self):
        random = np.random.default_rng(20)
        self.times = random.integers(0, 2**31, (SAMPLES, 1), "u4") * np.uint32(2) + np.uint32(1)
        self.plus = random.integers(0, 2**32, (SAMPLES, 1), "u4")
        self.fold = random.integers(0, 2**63, (BANDS, ROWS), "u8") * np.uint64(2) + np.uint64(1)
        self.band = np.arange(1, BANDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
        self.number = np.arange(1, SAMPLES + 1, dtype="u8") << np.uint64(32)

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (shingles >> np.uint64(32)).astype("u4")
        least = np.full(SAMPLES, 2**32 - 1, "u4")
        for at in range(0, len(x), 2048):
            part = self.times * x[at:at + 2048]
            part += self.plus
            np.minimum(least, part.min(axis=1), out=least)
        wide = least.astype("u8")
        keys = _mix((wide.reshape(BANDS, ROWS) * self.fold).sum(axis=1, dtype="u8") + self.band)
        bits = _mix(wide | self.number) % np.uint64(SKETCH_BITS)
        odd = (np.bincount(bits.astype("i8"), minlength=SKETCH_BITS) & 1).astype("u1")
        return keys.view("i8"), np.packbits(odd, bitorder="little").view("<i8")


def _lists(arrays: list, kind=pa.int64()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("i4")
    values = np.concatenate(arrays) if arrays else np.empty(0, "i8")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, class, n_shingles, bands, sketch) of (doc_id, class, text); no bands for empty
    sets."""
    def sign(batches):
        signer = Signer()
        none = np.empty(0, "i8")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(2).to_pylist(), size)
                signed = [signer.sign(s) if len(s) else (none, none) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([len(s) for s in sets], pa.int64()),
                     _lists([s[0] for s in signed]), _lists([s[1] for s in signed])],
                    ["doc_id", "class", "n_shingles", "bands", "sketch"])
    return rows.mapInArrow(sign, "doc_id long, class binary, n_shingles long, "
                                 "bands array<long>, sketch array<long>")


def sets_of(rows: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text)."""
    def hashes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists([s.view("i8") for s in sets])], ["node", "shingles"])
    return rows.mapInArrow(hashes, "node long, shingles array<long>")


def class_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def differing(a: Column, b: Column) -> Column:
    """Ones in the XOR of two sketches."""
    total = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return total


def candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and sketches allow the similarity."""
    small = classes.select("node", "n_shingles", "sketch")
    a = small.toDF("a", "a_n", "a_sketch")
    b = small.toDF("b", "b_n", "b_sketch")
    return (pairs.join(a, "a").join(b, "b")
            .where((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
                   & (differing(F.col("a_sketch"), F.col("b_sketch")) <= most_ones(percent)))
            .select("a", "b"))


def full_sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the given nodes, from their texts.

    The digests wanted grow with the corpus, so they are joined by shuffle at every size and
    never pass through the driver.
    """
    wanted = nodes.distinct().join(classes.select("node", "class"), "node").select("class", "node")
    one = (texts.join(wanted.select("class").hint("merge"), "class", "left_semi")
           .groupBy("class").agg(F.first("text").alias("text"))
           .join(wanted.hint("merge"), "class").select("node", "text"))
    return written(sets_of(one, size), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int,
              percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar. ``pairs`` is a written table."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = full_sets(nodes, classes, texts, size)
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
            .where(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both))
            .select("a", "b"))


def across(members: DataFrame, classes: DataFrame, texts: DataFrame, size: int,
           percent: int) -> DataFrame:
    """Links between different components of the same bucket, hubs left out. ``members`` is a
    written table of (bucket, node, size, component)."""
    few = members.where(F.col("size") <= SMALL_BUCKET).select("bucket", "node", "component")
    other = few.toDF("bucket", "b", "b_component")
    pairs = (few.join(other, "bucket").where("node < b and component <> b_component")
             .select(F.col("node").alias("a"), "b").distinct())
    small = written(candidates(pairs, classes, percent), "pairs")
    links = written(confirmed(small, classes, texts, size, percent), "confirmed")
    many = members.where(F.col("size") > SMALL_BUCKET)
    if many.isEmpty():
        return links
    sets = full_sets(many.select("node"), classes, texts, size)
    blocks = F.ceil(F.col("size") / BLOCK)
    rows = (many.join(classes.select("node", "n_shingles", "bands", "sketch").join(sets, "node"),
                      "node")
            .withColumn("block", F.pmod(F.xxhash64("node"), blocks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select("bucket", F.least("block", "other").alias("low"),
                    F.greatest("block", "other").alias("high"),
                    "node", "component", "block", "n_shingles", "bands", "sketch", "shingles"))
    large = rows.groupBy("bucket", "low", "high").applyInArrow(block_links(percent),
                                                               "a long, b long")
    return links.union(large)


def block_links(percent: int):
    """Compares the members of two blocks of a bucket, or of one with itself.

    A pair is compared in the first bucket its texts share, if its components are apart, its
    sizes and sketches allow the similarity, and no link found here joins them yet. So of a
    dense group only links that join something leave the block.
    """
    most = most_ones(percent)

    def compare(key, table):
        table = table.combine_chunks()

        def matrix(name):
            column = table[name].chunk(0) if table[name].num_chunks else table[name]
            return column.flatten().to_numpy().reshape(table.num_rows, -1)
        bucket, low, high = (k.as_py() for k in key)
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        n, bands = table["n_shingles"].to_numpy(), matrix("bands")
        sketch = matrix("sketch").view("u8")
        shingles = [np.asarray(x.values) for x in table["shingles"]]
        names, label = np.unique(table["component"].to_numpy(), return_inverse=True)
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b = [], []
        for k, i in enumerate(left):
            others = left[k + 1:] if low == high else right
            ones = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
            fits = others[(label[others] != label[i]) & (ones <= most)
                          & (100 * np.minimum(n[others], n[i])
                             >= percent * np.maximum(n[others], n[i]))]
            if band and len(fits):
                fits = fits[~(bands[fits, :band] == bands[i, :band]).any(axis=1)]
            for j in fits:
                if label[j] == label[i]:
                    continue
                both = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return compare


def classify(documents: DataFrame, size: int = 5, percent: int = SIMILARITY,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``documents``: ``doc_id``, ``class`` (MD5 of the text),
    ``n_shingles`` and ``component`` (the least node it is linked with, directly or not; null
    for empty sets). A node is a number given to each class when the classes are written."""
    ship(documents.sparkSession)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"),
                             class_of(F.col(text_col)).alias("class"),
                             F.col(text_col).cast("string").alias("text"))
    signed = written(signatures(texts, size), "signed")
    classes = written(signed.where("n_shingles > 0").groupBy("class")
                      .agg(F.first("n_shingles").alias("n_shingles"),
                           F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
                      .withColumn("node", F.monotonically_increasing_id()), "classes")
    in_bands = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = (in_bands.groupBy("bucket").agg(F.min("node").alias("hub"),
                                           F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = written(in_bands.join(hubs, "bucket"), "met")
    texts = texts.select("class", "text")
    pairs = met.where("node <> hub").select(F.col("node").alias("a"),
                                            F.col("hub").alias("b")).distinct()
    links = written(confirmed(written(candidates(pairs, classes, percent), "pairs"), classes,
                              texts, size, percent), "confirmed")
    labels = components(links)

    # What the hubs could not decide: buckets with several components, hubs aside.
    placed = (met.where("size > 2 and node <> hub")
              .join(labels.toDF("node", "found"), "node", "left")
              .select("bucket", "node", "size", F.coalesce("found", "node").alias("component")))
    split = (placed.groupBy("bucket").agg(F.min("component").alias("low"),
                                          F.max("component").alias("high"))
             .where("low <> high").select("bucket"))
    members = written(placed.join(split, "bucket"), "members")
    if not members.isEmpty():
        new = written(across(members, classes, texts, size, percent), "confirmed")
        if not new.isEmpty():
            labels = components(links.union(new))
    nodes = (classes.select("class", "node").join(labels.toDF("node", "found"), "node", "left")
             .select("class", F.coalesce("found", "node").alias("component")))
    return (signed.select("doc_id", "class", "n_shingles").join(nodes, "class", "left")
            .select("doc_id", "class", "n_shingles", "component"))


def groups(documents: DataFrame, size: int = 5, percent: int = SIMILARITY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``n_shingles``, ``component_id`` (the least
    doc_id that can be reached) and ``kept`` (it is its own component's)."""
    found = written(classify(documents, size, percent, id_col, text_col), "components")
    least = (found.where("component is not null").groupBy("component")
             .agg(F.min("doc_id").alias("least")))
    return (found.join(least, "component", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def deduplicate(documents: DataFrame, size: int = 5, percent: int = SIMILARITY,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates, all columns kept: one row of each component, that
    with the least id (null last; equal ids: least MD5). Texts without words all stay."""
    found = written(classify(documents, size, percent, id_col, text_col), "components")
    own = fresh(documents.columns, "best_")
    times = found.where("component is not null").groupBy("component", "doc_id", "class") \
        .agg(F.count(F.lit(1)).alias("times"))
    best = (times.groupBy("component").agg(F.min(F.struct(*[
        F.col("doc_id").isNull().alias("gone"), "doc_id", "class", "times"])).alias("best"))
        .select(F.col("best.doc_id").alias(f"{own}id"), F.col("best.class").alias(f"{own}class"),
                F.col("best.times").alias(f"{own}times")))
    hit = documents.join(best, (class_of(F.col(text_col)) == F.col(f"{own}class"))
                         & F.col(id_col).cast("long").eqNullSafe(F.col(f"{own}id")))
    single = hit.where(F.col(f"{own}times") == 1).select(*documents.columns)
    repeated = (hit.where(F.col(f"{own}times") > 1).dropDuplicates([f"{own}class"])
                .select(*documents.columns))
    wordless = documents.where(~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return single.unionByName(repeated).unionByName(wordless)
