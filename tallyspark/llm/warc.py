"""WARC archives: deduplicating writer, and a reader that verifies record boundaries by chains.

Writing. A record is a row of Spark's text writer; the line separator is the blank line pair
that ends every WARC record, so the files are plain WARC/1.1 and any store that Spark writes to
holds them. Of records with equal payloads of ``LEAST_REVISIT`` bytes or more, that with the
least page id is a ``response``; the others are ``revisit`` records with HTTP headers only.
Rows that repeat the response's page id and payload are responses too.

Reading. Files are split and read in parallel by the text source, with the record boundary
``\\r\\n\\r\\nWARC/1.`` as line separator: each line is the text from one boundary to the next.
Payloads can hold the same bytes, so a line is only a candidate: its header's length gives the
offset of its successor. Then

1. each split sums its lines, which gives every candidate its offset in the file;
2. inside a split, every candidate is followed to the first offset outside (its exit), and
   each line notes the record that holds it if the split's first candidate is a record;
3. pointer jumping over the splits' entries, from offset 0, doubles the reach each round;
4. where the chain enters a split at its first candidate, which is nearly always so, the notes
   hold; lines of the other splits are followed again from the true entry;
5. a record that is one line is done; lines of others are put together by record.

Blocks are written once with their notes and not shuffled, but for records of several lines.

So a file of any size is read by many tasks, and rounds grow with the logarithm of its splits.

Defined cases: null html is an empty payload; null ids and urls are written as empty fields;
an empty table gives no records; a file that doesn't start with a record gives none; a chain
ends at a successor that isn't a boundary; gzip members are not read.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyspark.llm.common import ship, shared_folder, written

LEAST_REVISIT = 100
#: Tables of digests or splits (some 120 bytes a row) are broadcast up to this size.
BROADCAST_ROWS = 200_000
END = "\r\n\r\n"
MAGIC = "WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def small(table: DataFrame) -> DataFrame:
    """A table of short rows, to be broadcast if it has at most ``BROADCAST_ROWS``; else Spark
    joins it by shuffle. ``table`` is a written table."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of the records."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha2(payload, 256).alias("payload_digest"))
    # Only payloads that occur again matter; without them no payload is moved.
    first = written(rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
                    .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
                    .where("pages > 1").drop("pages"), "first")
    return (rows.join(small(first), "payload_digest", "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")),
                                            F.col("first"))).drop("first"))


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", **columns) -> None:
    """Write a record for each page to archives below ``path``."""
    rows = planned(pages, **columns)
    revisit = F.col("refers_to").isNotNull()

    def number(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"), number("page_id"), F.lit(">\r\nWARC-Date: "),
        F.lit(date), F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:x-page:"), number("refers_to"),
                                 F.lit(f">\r\nWARC-Profile: {REVISIT}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    (rows.select(F.concat(head, block).alias("value"))
     .write.option("lineSep", END).text(path))


def parse_head(line: bytes) -> tuple[int, int] | None:
    """Lengths of header and block of a line that starts after the magic; None if it has no
    header."""
    end = line.find(b"\r\n\r\n")
    if end < 0 or line[1:3] != b"\r\n" or not line[:1].isdigit():
        return None
    length = None
    for field in line[3:end].split(b"\r\n"):
        name, colon, value = field.partition(b":")
        if not colon or not name or name != name.strip():
            return None
        if name.lower() == b"content-length":
            if length is not None or not value.strip().isdigit():
                return None
            length = int(value)
    return None if length is None else (end + 4, length)


LINES = ("file string, split long, place long, size long, next long, body_at long, "
         "noted long, text binary")


def locate(batches):
    """Lines of splits with their places, counted from the start of their split's first line.

    ``text`` is what follows the magic; ``body_at`` is where the block starts in it and
    ``next`` the successor's place, if the line has a header. ``noted`` is the place of the
    record that holds the line, provided that the split's first candidate is one.
    """
    kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]
    names = ["file", "split", "place", "size", "next", "body_at", "noted", "text"]
    now, place, noted, expected = None, 0, None, None
    magic, end = len(MAGIC), len(END)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            out = []
            for file, split, line in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                if now != (file, split):
                    now, place, noted, expected = (file, split), 0, None, None
                first = split == 0 and place == 0
                fits = not first or line.startswith(MAGIC.encode())
                text = line[magic:] if first and fits else line
                found = parse_head(text) if fits else None
                start = place if first else place - magic
                size = len(line) + end + magic
                after = start + magic + sum(found) + end if found else None
                if found and (expected is None or start == expected):
                    noted, expected = start, after
                held = noted if expected is not None and start < expected else None
                out.append((file, split, start, size, after, found and found[0], held, text))
                place += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)


def exits(key, table):
    """For each candidate of a split: the first offset outside that its chain comes to; null if
    the chain ends inside."""
    place, after = table["place"].to_pylist(), table["next"].to_pylist()
    found = dict(zip(place, after))
    last = max(place)
    ends: dict = {}
    for p in sorted(found, reverse=True):
        step = found[p]
        if step is not None:
            ends[p] = step if step > last else ends.get(step)
    kept = sorted(ends)
    n = len(kept)
    return pa.table({"file": pa.array([key[0].as_py()] * n, pa.string()),
                     "split": pa.array([key[1].as_py()] * n, pa.int64()),
                     "place": pa.array(kept, pa.int64()),
                     "exit": pa.array([ends[p] for p in kept], pa.int64())})


def owners(key, table):
    """For each line of a split the record that holds it; null before the split's entry."""
    rows = sorted(zip(table["place"].to_pylist(), table["next"].to_pylist(),
                      table["entry"].to_pylist()))
    out, expected, owner = [], rows[0][2], None
    for place, after, _ in rows:
        if place == expected and after is not None:
            owner, expected = place, after
        out.append(owner if owner is not None and place < expected else None)
    n = len(rows)
    return pa.table({"file": pa.array([key[0].as_py()] * n, pa.string()),
                     "split": pa.array([key[1].as_py()] * n, pa.int64()),
                     "place": pa.array([r[0] for r in rows], pa.int64()),
                     "next": pa.array([r[1] for r in rows], pa.int64()),
                     "owner": pa.array(out, pa.int64())})


def reachable(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes (file, at) that ``jumps`` (file, at, to) reach from ``starts``, by pointer jumping:
    after round t the nodes up to 2^t steps away are known and a jump is 2^t steps long."""
    reached, size = written(starts, "reached"), -1
    while True:
        count = reached.count()
        if count == size:
            return reached
        size = count
        far = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = written(reached.union(far).distinct(), "reached")
        then = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = written(jumps.join(then, ["file", "to"]).select("file", "at",
                                                               F.col("then").alias("to")), "jumps")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: ``file``, ``offset``, ``head`` (header fields)
    and ``block``."""
    ship(spark)
    lines = (spark.read.option("lineSep", END + MAGIC).text(path)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("split"),
                     F.col("value").cast("binary").alias("line")).mapInArrow(locate, LINES))
    stored = shared_folder(spark, "lines")
    lines.write.option("compression", "zstd").parquet(stored)
    lines = spark.read.schema(LINES).parquet(stored)
    key = ["file", "split"]
    narrow = lines.select(*key, "place", "size", "next", "noted")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1)
    last = F.when(F.col("place") == F.col("noted"), F.struct("place", "next"))
    # The first line of a later split starts where the lines of the splits before it end.
    base = written(narrow.groupBy(key).agg(F.sum("size").alias("size"),
                                           F.min("noted").alias("guess"),
                                           F.max(last).alias("last"))
                   .withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))), "base")
    found = written(narrow.groupBy(key)
                    .applyInArrow(exits, "file string, split long, place long, exit long")
                    .join(base, key)
                    .select(*key, "place", (F.col("base") + F.col("place")).alias("at"),
                            (F.col("base") + F.col("exit")).alias("to")), "exits")
    starts = found.where("at = 0").select("file", "at")
    targets = found.select("file", F.col("to").alias("at")).union(starts).distinct()
    jumps = found.join(targets, ["file", "at"], "left_semi").select("file", "at", "to")
    reached = reachable(jumps, starts)
    # A record's chain enters a split once; the least place is that entry.
    entry = (found.join(reached, ["file", "at"], "left_semi")
             .groupBy(key).agg(F.min("place").alias("entry")))
    entered = written(base.join(entry, key, "left").withColumn(
        "right", F.col("entry").eqNullSafe(F.col("guess"))), "entered")
    wrong = entered.where("not right").select(*key, "entry")
    again = written(narrow.join(small(written(wrong, "wrong")), key).groupBy(key)
                    .applyInArrow(owners, "file string, split long, place long, next long, "
                                          "owner long"), "again")
    ends = (again.where("place = owner").groupBy(key)
            .agg(F.max(F.struct("place", "next")).alias("own")))
    final = F.when(F.col("right"), F.col("last")).otherwise(F.col("own"))
    splits = written(
        entered.join(ends, key, "left").withColumn("final", final)
        .withColumn("final", F.when(F.col("final").isNotNull(), F.struct(
            (F.col("base") + F.col("final.place")).alias("offset"),
            (F.col("base") + F.col("final.next")).alias("until"))))
        .withColumn("carried", F.last("final", True).over(before))
        .select(*key, "base", "right", "carried"), "splits")
    again = again.select(*key, "place", "owner")
    placed = lines.join(small(splits), key)
    # Lines before a split's entry belong to the last record before, as far as it goes.
    own = F.coalesce(F.col("base") + F.col("owner"),
                     F.when(F.col("base") + F.col("place") < F.col("carried.until"),
                            F.col("carried.offset")))
    kept = placed.where("right").withColumn("owner", F.col("noted"))
    redone = placed.where("not right").join(again, [*key, "place"])
    columns = ["file", own.alias("offset"), (F.col("base") + F.col("place")).alias("at"), "next",
               "place", "body_at", "text"]
    rows = kept.select(columns).unionByName(redone.select(columns)).where("offset is not null")
    length = F.col("next") - F.col("place") - len(MAGIC) - F.col("body_at") - len(END)
    whole = ((F.col("at") == F.col("offset"))
             & (F.octet_length("text") >= F.col("body_at") + length))
    single = rows.where(whole).select("file", "offset", "next", "place", "body_at", "text")
    # Bytes that looked like a boundary go back between the lines of a record.
    line = F.struct("at", "next", "place", "body_at", F.col("text").cast("string").alias("text"))
    several = (rows.where(~F.coalesce(whole, F.lit(False))).groupBy("file", "offset")
               .agg(F.sort_array(F.collect_list(line)).alias("lines"))
               .where(F.get("lines", F.lit(0))["at"] == F.col("offset"))
               .select("file", "offset", *[F.get("lines", F.lit(0))[c].alias(c)
                                           for c in ("next", "place", "body_at")],
                       F.array_join(F.transform("lines", lambda x: x["text"]), END + MAGIC)
                       .cast("binary").alias("text")))
    return single.unionByName(several).select(
        "file", "offset", F.expr("substring(text, 4, body_at - 7)").cast("string").alias("head"),
        length.alias("length"),
        F.substring("text", F.col("body_at").cast("int") + 1, length.cast("int")).alias("block"))


def field(name: str) -> Column:
    """Value of a header field; null if there is none."""
    value = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def pages_of(records: DataFrame) -> DataFrame:
    """Per ``response`` or ``revisit``: ``page_id``, ``record_type``, ``url``, ``payload``,
    ``payload_bytes``, ``payload_digest`` and ``refers_to``. Bytes and digest of a response are
    those of the payload read; a revisit states those of the payload it refers to."""
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    payload = F.substring("block", (F.octet_length(http) + len(END) + 1).cast("int"),
                          F.lit(2**31 - 1))
    rows = (records.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("id"),
        field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("to"),
        field("WARC-Payload-Digest").alias("digest"), http.alias("head"), payload.alias("payload"))
        .where("record_type in ('response', 'revisit')"))
    revisit = F.col("record_type") == "revisit"

    def number(c):
        return F.regexp_extract(c, r"<urn:x-page:(-?[0-9]+)>", 1).try_cast("long")

    return rows.select(
        number("id").alias("page_id"), "record_type", "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, field("Content-Length").cast("long"))
        .otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest", "^sha256:", ""))
        .otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.when(revisit, number("to")).alias("refers_to"))
