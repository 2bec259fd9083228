"""Shards of near equal bytes by Karmarkar-Karp differencing over groups of equal texts.

A partial partition is a list of ``shards`` sums. Differencing takes the two with the largest
spread and adds one's largest sum to the other's smallest, and so on, so that large differences
cancel out. Equal texts are one indivisible group.

1. Group sizes are added up by Spark. Each task differences its groups in blocks of at most
   ``BLOCK``, which leaves one partial partition for a block.
2. Partial partitions are differenced ``FAN`` at a time, round by round, until one is left;
   a round is a table of sums, small against the data, and a task holds ``FAN`` of them.
3. Groups follow the renamings of their block to their shard, and rows follow their group.

Rows are numbered in their shard without gaps: rows written by one task are numbered in that
task's part of the shard, and parts are laid one after another by a sum over counts. So neither
a shard nor a group of copies is ever gathered in one place.

Defined cases: null text counts as empty; repeated rows and equal or null ids are rows like
others; fewer groups than shards leave shards empty; an empty table gives no rows; other
columns aren't read. A group larger than a shard's share stays whole, as the method demands.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm.common import ship, written

SHARDS = 24
ROW_BYTES = 8
BLOCK = 20_000
FAN = 256


def difference(partials: np.ndarray) -> np.ndarray:
    """For every partial partition (a row of sums) the part that each of its sums goes to."""
    count, k = partials.shape
    order = np.argsort(-partials, axis=1, kind="stable")
    sums = np.take_along_axis(partials, order, axis=1)
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    sums = {i: s for i, s in enumerate(sums)}
    steps = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        place = np.argsort(-both, kind="stable")
        number = count + len(steps)
        steps.append((a, b, place.astype("u2")))
        sums[number] = both = both[place]
        heapq.heappush(heap, (int(both[-1] - both[0]), number))
    parts = {heap[0][1]: np.arange(k, dtype="u2")}
    for number in range(count + len(steps) - 1, count - 1, -1):
        a, b, place = steps[number - count]
        mine = np.empty(k, "u2")
        mine[place] = parts.pop(number)
        parts[a], parts[b] = mine, mine[::-1].copy()
    out = np.empty((count, k), "i4")
    for i in range(count):
        out[i, order[i]] = parts[i]
    return out


def blocks(shards: int, block: int):
    """Differences the groups of a task in blocks."""
    def run(batches):
        from pyspark import TaskContext
        partition, number, keys, sizes = TaskContext.get().partitionId(), 0, [], []

        def flush():
            partials = np.zeros((len(sizes), shards), "i8")
            partials[:, 0] = sizes
            part = difference(partials)[:, 0]
            n = len(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(np.full(n, (partition << 32) + number)), pa.array(part)],
                ["group", "bytes", "unit", "part"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                keys += some.column(0).to_pylist()
                sizes += some.column(1).to_pylist()
                while len(keys) >= block:
                    rest = keys[block:], sizes[block:]
                    del keys[block:], sizes[block:]
                    yield flush()
                    number, (keys, sizes) = number + 1, rest
        if keys:
            yield flush()
    return run


def combine(shards: int):
    """Differences the partial partitions of some units."""
    def run(key, table):
        units, where = np.unique(table["unit"].to_numpy(), return_inverse=True)
        partials = np.zeros((len(units), shards), "i8")
        partials[where, table["part"].to_numpy()] = table["bytes"].to_numpy()
        to = difference(partials)
        n = len(units)
        return pa.table({"unit": pa.array(np.repeat(units, shards)),
                         "part": pa.array(np.tile(np.arange(shards, dtype="i4"), n)),
                         "next_unit": pa.array(np.full(n * shards, key[0].as_py())),
                         "next_part": pa.array(to.ravel())})
    return run


def assign(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(group, shard) of (group binary, bytes long)."""
    ship(groups.sparkSession)
    placed = written(groups.select("group", "bytes").mapInArrow(
        blocks(shards, block), "group binary, bytes long, unit long, part int"), "placed")
    sums = placed.groupBy("unit", "part").agg(F.sum("bytes").alias("bytes"))
    renamed = None
    while True:
        units = sums.select("unit").distinct().count()
        fan = -(-units // FAN)
        step = written(
            sums.withColumn("next_unit", F.pmod(F.xxhash64("unit"), F.lit(max(fan, 1))))
            .groupBy("next_unit").applyInArrow(
                combine(shards), "unit long, part int, next_unit long, next_part int"), "step")
        sums = (sums.join(step, ["unit", "part"]).groupBy("next_unit", "next_part")
                .agg(F.sum("bytes").alias("bytes"))
                .toDF("unit", "part", "bytes"))
        if renamed is None:
            renamed = step.toDF("unit", "part", "to_unit", "to_part")
        else:
            renamed = (renamed.join(step.toDF("to_unit", "to_part", "u", "p"),
                                    ["to_unit", "to_part"])
                       .select("unit", "part", F.col("u").alias("to_unit"),
                               F.col("p").alias("to_part")))
        if fan <= 1:
            break
    return (placed.join(renamed, ["unit", "part"])
            .select("group", F.col("to_part").cast("int").alias("shard")))


def shard(documents: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
          text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: ``doc_id``, ``size`` (UTF-8 bytes plus ``ROW_BYTES``), ``text_crc32``, ``shard``
    and ``slot`` (its place in the shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group")), "sized")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    # Each task notes its number and the order of its rows: both are fixed once written.
    put = written(rows.join(assign(groups, shards, block), "group").select(
        "doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().alias("at")), "put")
    counts = put.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    first = counts.select("shard", "task",
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "task").orderBy("at"))
    return (put.withColumn("own", own).join(first, ["shard", "task"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("first") + F.col("own") - 1).cast("long").alias("slot")))
