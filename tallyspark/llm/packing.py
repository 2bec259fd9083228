"""Packing of token ids into training sequences: bounded-space online best fit.

Each partition keeps at most ``windows`` open sequences. A document's ids fill whole sequences
first; the rest goes to the open sequence it fits best. When it fits none and no more may be
opened, the fullest is emitted: as it is if it lacks at most ``slack`` ids, else filled with
the head of the piece. Sequences still open at the end of a partition are its leftovers. They
are merged in groups of ``MERGE`` partitions, round by round, the fullest filled from the
emptiest, until one group remains; so one sequence at most stays partly filled at the end.

Memory: a partition holds ``windows`` sequences, a merge ``MERGE * windows``. Pieces are written
to the shared folder once, so tasks that are lost are run again without packing others anew;
a partition's packing depends on its rows only.

Defined cases: null and empty texts are documents of the end id alone; repeated rows and equal
or null ids are packed like others; an empty table gives no pieces; other columns aren't read.
"""

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import ship, shared_folder
from tallyspark.llm.tokens import encoder

SIZE = 2048
WINDOWS = 64
SLACK = 8
MERGE = 64

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, source long, leftover boolean")
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                   ("offset", pa.int64()), ("source", pa.int64()), ("leftover", pa.bool_())])


class Packer:
    """Open sequences of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, windows: int, slack: int):
        self.size, self.most, self.slack = size, windows, slack
        self.open: list = []    # (free, number), least free first
        self.pieces: dict = {}  # number -> pieces
        self.made = 0

    def add(self, piece):
        """Place a piece; yields the sequences that are done."""
        doc, start, ids, tokens = piece
        whole = len(ids) // 4 // self.size * self.size
        for at in range(0, whole, self.size):
            yield [(doc, start + at, ids[4 * at:4 * (at + self.size)], tokens)]
        start, ids = start + whole, ids[4 * whole:]
        while ids:
            need = len(ids) // 4
            k = bisect_left(self.open, (need, -1))
            if k < len(self.open):
                free, number = self.open.pop(k)
            elif len(self.open) < self.most:
                free, number = self.size, self.made
                self.made += 1
                self.pieces[number] = []
            else:
                free, number = self.open.pop(0)
                if free <= self.slack:
                    yield self.pieces.pop(number)
                    continue
            part = min(need, free)
            self.pieces[number].append((doc, start, ids[:4 * part], tokens))
            start, ids = start + part, ids[4 * part:]
            if part == free:
                yield self.pieces.pop(number)
            else:
                insort(self.open, (free - part, number))

    def rest(self):
        """The open sequences, fullest first."""
        return [self.pieces[number] for _, number in self.open]


def merge(sequences: list, size: int) -> tuple[list, list]:
    """Fill the fullest from the emptiest: full sequences, and at most one that isn't."""
    used = [(sum(len(p[2]) // 4 for p in s), s) for s in sequences]
    used.sort(key=lambda x: -x[0])
    full, low, high = [], 0, len(used) - 1
    while low <= high:
        count, pieces = used[low]
        pieces = list(pieces)
        while count < size and high > low:
            other, donors = used[high]
            doc, start, ids, tokens = donors[-1]
            part = min(size - count, len(ids) // 4)
            pieces.append((doc, start, ids[:4 * part], tokens))
            count, other = count + part, other - part
            donors = donors[:-1] + ([(doc, start + part, ids[4 * part:], tokens)]
                                    if 4 * part < len(ids) else [])
            used[high] = other, donors
            high -= not donors
        if count < size:
            return full, [pieces]
        full.append(pieces)
        low += 1
    return full, []


def rows(sequences, first: int, source: int, leftover: bool) -> pa.RecordBatch:
    out = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, ids, tokens, first + k, offset, source, leftover))
            offset += n
    columns = zip(*out) if out else [()] * len(ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", size: int = SIZE, windows: int = WINDOWS,
         slack: int = SLACK, special_as_text: bool = False) -> DataFrame:
    """Pieces of packed sequences: ``doc_id``, ``start`` (the document's ids before the piece),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and
    ``offset``. Each document ends with ``end_id``."""
    spark = documents.sparkSession
    ship(spark)
    end = end_id.to_bytes(4, "little")

    def pack_partition(batches):
        from pyspark import TaskContext
        source = TaskContext.get().partitionId()
        packer, number = Packer(size, windows, slack), 0
        encode = encoder(tokenizer, special_as_text).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, done = batch.slice(at, 256), []
                texts = encode(part.column(1).to_pylist())
                for doc, ids in zip(part.column(0).to_pylist(), texts):
                    ids += end
                    done.extend(packer.add((doc, 0, ids, len(ids) // 4)))
                if done:
                    yield rows(done, (source << 32) + number, source, False)
                    number += len(done)
        if rest := packer.rest():
            yield rows(rest, (source << 32) + number, source, True)

    packed = documents.select(F.col(id_col).cast("long").alias("doc_id"),
                              F.col(text_col).cast("string").alias("text"))
    return _merged(spark, _written(packed.mapInArrow(pack_partition, SCHEMA)), size)


def _written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "packed")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(SCHEMA).parquet(path)


def merger(size: int, place: int, last: bool):
    """Merges one group's leftovers; ids of its sequences start at ``place`` and the group."""
    def merge_group(key, table):
        group = key[0].as_py()
        found: dict = {}
        for row in sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"])):
            found.setdefault(row["sequence_id"], []).append(
                (row["doc_id"], row["start"], row["ids"], row["doc_tokens"]))
        full, part = merge(list(found.values()), size)
        first = place + (group << 32)
        both = [rows(full + (part if last else []), first, group, False)]
        if part and not last:
            both.append(rows(part, first + len(full), group, True))
        return pa.Table.from_batches(both)
    return merge_group


def _merged(spark, pieces: DataFrame, size: int) -> DataFrame:
    """Merge leftovers until one group of them has been merged."""
    done = pieces.where("not leftover")
    left, level = pieces.where("leftover"), 0
    groups = left.agg(F.max("source")).first()[0]
    while groups is not None:
        level += 1
        groups //= MERGE
        last, place = groups == 0, level << 56

        merged = _written(left.withColumn("unit", F.floor(F.col("source") / MERGE).cast("long"))
                          .groupBy("unit").applyInArrow(merger(size, place, last), SCHEMA))
        done = done.unionByName(merged.where("not leftover"))
        left = merged.where("leftover")
        groups = None if last else groups
    return done.drop("source", "leftover")

