"""Token-id files as directly addressable codes: any id is read without decoding others.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id; each
level has a bitmap that says which ids go on, and the next level holds the chunks of just
those. The place of an id in the next level is the number of ones before it, which a rank
directory (ones before every block of 512 bits) gives in constant time. The last level has no
bitmap.

File (little-endian): ``DACTOK01``, then six 64-bit integers (partition, ids in the partition
before this file, documents, ids, levels, ids of a rank block), document ids, a null flag for
each, ids of each document, then each level: count, chunks, and unless last its bitmap and rank
directory (32-bit). A file has at most ``FILE_IDS`` ids, or one document. ``ENDMARK`` closes it.

Files are written by Spark's text writer, whose rows are whole files and whose line separator
is the end mark: text columns hold any bytes and are written as they are. So the output
committer of the job handles lost tasks, and any store that Spark writes to will do. Files are
read with the ``binaryFile`` source.

Defined cases: null and empty texts are documents of the end id alone; null ids come first;
documents with equal ids are ordered by a hash of their text; an empty table makes no files.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyspark.llm.common import ship
from tallyspark.llm.tokens import encoder

MAGIC = b"DACTOK01"
ENDMARK = "\nEND-OF-DACTOK\n"
HEADER = "<8s6q"
BLOCK = 512
FILE_IDS = 4_000_000


def encode_levels(ids: np.ndarray) -> list[bytes]:
    """The levels of an id array."""
    out = []
    while True:
        out += [struct.pack("<q", len(ids)), (ids & 255).astype("u1").tobytes()]
        more = ids >> 8
        on = more > 0
        if not on.any():
            return out
        bits = np.packbits(on, bitorder="little")
        blocks = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype="<u4")
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4")
        out += [bits.tobytes(), ranks.tobytes()]
        ids = more[on]


def encode_file(partition: int, before: int, docs: list, counts: list, ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    n_levels = (len(levels) + 2) // 4  # four parts a level, two for the last
    return b"".join([
        struct.pack(HEADER, MAGIC, partition, before, len(docs), len(ids), n_levels, BLOCK),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], "u1").tobytes(),
        np.array(counts, "<i8").tobytes(), *levels])


class TokenFile:
    """One file in memory. ``tf[i]`` reads id ``i`` alone; ``ids()`` decodes all."""

    def __init__(self, content):
        self.data = memoryview(content)
        (magic, self.partition, self.before, n_docs, self.n_ids, n_levels,
         self.block) = struct.unpack_from(HEADER, self.data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)
        ids = np.frombuffer(self.data, "<i8", n_docs, at)
        nulls = np.frombuffer(self.data, "u1", n_docs, at + 8 * n_docs)
        self.docs = [None if gone else int(d) for d, gone in zip(ids, nulls)]
        self.counts = np.frombuffer(self.data, "<i8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        self.levels = []
        for level in range(n_levels):
            (n,) = struct.unpack_from("<q", self.data, at)
            chunks = np.frombuffer(self.data, "u1", n, at + 8)
            at += 8 + n
            bits = ranks = None
            if level < n_levels - 1:
                bits = np.frombuffer(self.data, "u1", (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(self.data, "<u4", -(-n // self.block), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))
        if bytes(self.data[at:at + len(ENDMARK)]) not in (b"", ENDMARK.encode()):
            raise ValueError("token file has no end mark")

    def __len__(self):
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // self.block * self.block
            inside = np.unpackbits(bits[first >> 3:(i >> 3) + 1], bitorder="little")[:i - first]
            i = int(ranks[i // self.block]) + int(inside.sum())
        return value

    def ids(self) -> np.ndarray:
        found = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype("<u4")
            if bits is not None:
                on = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
                value[on] |= found << 8
            found = value
        return found


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0,
          id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS,
          special_as_text: bool = False) -> None:
    """Encode whole texts, in ascending order of ``id_col``, into token files below ``path``."""
    ship(documents.sparkSession)
    end = end_id.to_bytes(4, "little")

    def files(batches):
        from pyspark import TaskContext
        partition, before = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer, special_as_text).encode
        docs, counts, parts, n = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([encode_file(partition, before, docs, counts, ids)], pa.binary())],
                ["file"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = encode(part.column(1).to_pylist())
                for doc, ids in zip(part.column(0).to_pylist(), texts):
                    ids += end
                    if n and n + len(ids) // 4 > file_ids:
                        yield flush()
                        before, docs, counts, parts, n = before + n, [], [], [], 0
                    docs.append(doc)
                    counts.append(len(ids) // 4)
                    parts.append(ids)
                    n += len(ids) // 4
        if n:
            yield flush()

    tie = F.xxhash64("text")
    (documents.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
     .repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
     .mapInArrow(files, "file binary")
     .select(F.col("file").cast("string").alias("value"))
     .write.option("lineSep", ENDMARK).option("maxRecordsPerFile", 1).text(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below ``path``: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    return _located(spark, path, _documents(spark, path, lambda raw: raw, "ids binary"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with ``ids_crc32`` in place of the ids."""
    return _located(spark, path, _documents(spark, path, zlib.crc32, "ids_crc32 long"))


def _documents(spark, path, value, column: str) -> DataFrame:
    ship(spark)
    schema = f"doc_id long, part long, inside long, n_tokens long, {column}"
    arrow = pa.int64() if column.endswith("long") else pa.binary()
    names = ["doc_id", "part", "inside", "n_tokens", column.split()[0]]

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                raw = memoryview(file.ids().tobytes())
                ends = np.cumsum(file.counts)
                starts = ends - file.counts
                found = [value(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                if column.endswith("binary"):
                    found = [bytes(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.docs, pa.int64()),
                     pa.array(np.full(len(starts), file.partition)),
                     pa.array(starts + file.before), pa.array(file.counts.copy()),
                     pa.array(found, arrow)], names)

    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(decode, schema))


def _located(spark, path, docs: DataFrame) -> DataFrame:
    """Add what the partitions before hold; one row for each partition that wrote files."""
    def headers(batches):
        for batch in batches:
            found = [struct.unpack_from(HEADER, x.as_buffer()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[1] for h in found], pa.int64()),
                 pa.array([h[2] + h[4] for h in found], pa.int64())], ["part", "ids"])

    size = struct.calcsize(HEADER)
    parts = (spark.read.format("binaryFile").load(path)
             .select(F.substring("content", 1, size).alias("content"))
             .mapInArrow(headers, "part long, ids long")
             .groupBy("part").agg(F.max("ids").alias("ids")))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = parts.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return (docs.join(first, "part").withColumn("start", F.col("first") + F.col("inside"))
            .drop("part", "inside", "first"))
