"""Product codes of vectors, trained with norm-of-sum bounds.

A vector is cut into equal parts; each part position has a codebook, trained by k-means rounds.
For every part a row keeps its entry and two distances with the round they were measured in
(their stamps): to its own entry, and to the next one. The codebooks of all rounds are kept, so
a bound is carried to the present by the net displacement of the entries since its stamp, the
norm of the sum of their steps. That is never more than the sum of the steps' norms, and an
entry that went to and fro costs nothing.

* Own distance plus net displacement of the own entry is below the next distance less the
  greatest net displacement of the others: the entry stays, and the vector isn't read.
* Else the vector is fetched and the own distance measured afresh; that may settle it.
* Else the part is rescanned exactly against all entries, and both bounds get a new stamp.

Bounds are compared with a margin above the rounding of square roots; ties are always settled
by a rescan, in exact integers, with the lower index. So codes equal those of plain k-means.

Vectors lie bucketed by row number; the bounds are a narrow table written every round, and only
rows that a bound can't settle travel to the vectors. Codebook sums are changed by what moves.
The driver holds the codebooks of all rounds: rounds x parts x entries x part length numbers.

Defined cases: null vectors and those with null or non-finite components are dropped, and so
are those whose length isn't ``dimensions``, by default the commonest length that can be cut
into the parts (of equally common ones the greatest); repeated rows count as often as they
occur; null ids come last when codebooks start; with fewer vectors than entries there are as
many entries as vectors; null labels are one label; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import bucketed, removed, shared_folder, ship, written
from tallyspark.llm.vectors import blobs, finite, from_blobs, lists, matrix, numbered

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Relative margin of a bound, far above the rounding of its square roots and sums.
MARGIN = 1e-9
#: The next distance where a codebook has one entry only.
NONE_NEXT = 2**62

BOUNDS = ("rid long, code binary, own_stamp binary, next_stamp binary, "
          "own array<long>, next array<long>")
SUMS = "part int, entry int, n long, sums array<long>"


class History:
    """The codebooks of all rounds and the net displacement between any two of them."""

    def __init__(self, start: np.ndarray):
        self.books = [start]  # each of shape (parts, entries, length)

    @property
    def round(self) -> int:
        return len(self.books) - 1

    def moved(self) -> np.ndarray:
        """(stamp, part, entry): net displacement from the stamp's round to the present."""
        now = self.books[-1].astype("f8")
        return np.sqrt(np.array([((now - b) ** 2).sum(axis=2) for b in self.books]))

    def others(self) -> np.ndarray:
        """(stamp, part, entry): the greatest net displacement of all other entries."""
        moved = self.moved()
        out = np.zeros_like(moved)
        for e in range(moved.shape[2]):
            rest = np.delete(moved, e, axis=2)
            out[:, :, e] = rest.max(axis=2) if rest.shape[2] else 0.0
        return out


class Bounds:
    """Entries, stamps and squared distances of a batch of rows, one column for each part."""

    def __init__(self, columns, parts: int):
        self.code, self.own_stamp, self.next_stamp = (
            from_blobs(c, parts).copy() for c in columns[:3])
        self.own, self.next = (matrix(c, parts).copy() for c in columns[3:])

    def arrays(self, rows=slice(None)) -> list[pa.Array]:
        return [*[blobs(x[rows]) for x in (self.code, self.own_stamp, self.next_stamp)],
                lists(self.own[rows]), lists(self.next[rows])]

    def unsettled(self, moved: np.ndarray, others: np.ndarray) -> np.ndarray:
        """(row, part): may another entry be as near as the own one?"""
        part = np.arange(self.code.shape[1])
        upper = np.sqrt(self.own) + moved[self.own_stamp, part, self.code]
        lower = np.sqrt(self.next) - others[self.next_stamp, part, self.code]
        return upper * (1 + MARGIN) >= lower * (1 - MARGIN)


def rescan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, its squared distance and the next entry's, for parts of one position."""
    far = np.column_stack([((x - e) ** 2).sum(axis=1) for e in book])
    code = far.argmin(axis=1)
    own = far[np.arange(len(x)), code]
    far[np.arange(len(x)), code] = NONE_NEXT
    return code.astype("u1"), own, far.min(axis=1)


def refresh(x: np.ndarray, bounds: Bounds, history: History, unsettled: np.ndarray) -> None:
    """Settle the parts that bounds can't, in place; ``x`` is (row, part, length)."""
    now, book = history.round, history.books[-1]
    moved, others = history.moved(), history.others()
    for p in range(x.shape[1]):
        rows = np.flatnonzero(unsettled[:, p])
        own = ((x[rows, p] - book[p][bounds.code[rows, p]]) ** 2).sum(axis=1)
        bounds.own[rows, p], bounds.own_stamp[rows, p] = own, now
    still = unsettled & bounds.unsettled(moved, others)
    for p in range(x.shape[1]):
        rows = np.flatnonzero(still[:, p])
        if len(rows):
            bounds.code[rows, p], bounds.own[rows, p], bounds.next[rows, p] = rescan(
                x[rows, p], book[p])
            bounds.own_stamp[rows, p] = bounds.next_stamp[rows, p] = now


class Changes:
    """What moved parts add to their entries and take away."""

    def __init__(self, parts: int, entries: int, length: int):
        self.n = np.zeros((parts, entries), "i8")
        self.sums = np.zeros((parts, entries, length), "i8")

    def add(self, x: np.ndarray, code: np.ndarray, sign: int, rows: np.ndarray) -> None:
        """``rows`` (row, part) tells which parts count."""
        for p in range(code.shape[1]):
            at = np.flatnonzero(rows[:, p])
            np.add.at(self.n[p], code[at, p], sign)
            np.add.at(self.sums[p], code[at, p], sign * x[at, p])

    def arrays(self) -> list[pa.Array]:
        part, entry = np.nonzero(self.n.astype(bool) | self.sums.any(axis=2))
        return [pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
                pa.array(self.n[part, entry]), lists(self.sums[part, entry])]


def _types(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64())}
    return [(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))]


def _batch(rid: pa.Array | None, bounds: list, changes: list) -> pa.RecordBatch:
    """A batch of rows with bounds, or of changes; the other columns are null."""
    fields = _types(f"{BOUNDS}, {SUMS}")
    given = [rid, *bounds] if rid is not None else changes
    none = [pa.nulls(len(given[0]), kind) for _, kind in fields]
    at = 0 if rid is not None else 6
    none[at:at + len(given)] = given
    return pa.RecordBatch.from_arrays(none, [name for name, _ in fields])


def first_assignment(vectors: DataFrame, history: History) -> DataFrame:
    """Bounds of all rows against the first codebooks, and the sums of the entries."""
    parts, entries, length = history.books[0].shape

    def scan(batches):
        changes = Changes(parts, entries, length)
        for batch in batches:
            x = matrix(batch.column(1), parts * length).reshape(-1, parts, length)
            found = [rescan(x[:, p], history.books[0][p]) for p in range(parts)]
            code, own, far = (np.column_stack([f[k] for f in found]) for k in range(3))
            stamp = np.zeros_like(code)
            changes.add(x, code, 1, np.ones(code.shape, bool))
            yield _batch(batch.column(0), [blobs(code), blobs(stamp), blobs(stamp),
                                           lists(own), lists(far)], [])
        yield _batch(None, [], changes.arrays())
    return vectors.select("rid", "x").mapInArrow(scan, f"{BOUNDS}, {SUMS}")


def tested(bounds: DataFrame, history: History) -> DataFrame:
    """The bounds with ``wanted``: a bit for each part that they can't settle."""
    parts = history.books[0].shape[0]
    moved, others = history.moved(), history.others()

    def scan(batches):
        for batch in batches:
            unsettled = Bounds(batch.columns[1:], parts).unsettled(moved, others)
            wanted = blobs(np.packbits(unsettled, axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, wanted, pa.array(unsettled.any(axis=1))],
                [*batch.schema.names, "wanted", "open"])
    return bounds.mapInArrow(scan, f"{BOUNDS}, wanted binary, open boolean")


def reassigned(vectors: DataFrame, open_rows: DataFrame, history: History) -> DataFrame:
    """New bounds of the rows that need their vectors, and what moves between entries."""
    parts, entries, length = history.books[0].shape

    def scan(batches):
        changes = Changes(parts, entries, length)
        for batch in batches:
            bounds = Bounds(batch.columns[1:6], parts)
            before = bounds.code.copy()
            wanted = np.unpackbits(from_blobs(batch.column(6), -(-parts // 8)), axis=1)
            x = matrix(batch.column(7), parts * length).reshape(-1, parts, length)
            refresh(x, bounds, history, wanted[:, :parts].astype(bool))
            other = bounds.code != before
            changes.add(x, before, -1, other)
            changes.add(x, bounds.code, 1, other)
            yield _batch(batch.column(0), bounds.arrays(), [])
        yield _batch(None, [], changes.arrays())
    names = [f.split(" ")[0] for f in BOUNDS.split(", ")]
    return (vectors.select("rid", "x").join(open_rows, "rid").select(*names, "wanted", "x")
            .mapInArrow(scan, f"{BOUNDS}, {SUMS}"))


def final_codes(vectors: DataFrame, rows: DataFrame, history: History, kinds: dict) -> DataFrame:
    """(vec_id, label, code, error) against the last codebooks."""
    parts, _, length = history.books[0].shape

    def scan(batches):
        for batch in batches:
            bounds = Bounds(batch.columns[2:7], parts)
            x = matrix(batch.column(7), parts * length).reshape(-1, parts, length)
            # The error needs the own distance of every part.
            refresh(x, bounds, history, np.ones(bounds.code.shape, bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([r.tobytes().hex() for r in bounds.code], pa.string()),
                 pa.array(bounds.own.sum(axis=1))], ["vec_id", "label", "code", "error"])
    names = [f.split(" ")[0] for f in BOUNDS.split(", ")][1:]
    return (vectors.join(rows, "rid").select("vec_id", "label", *names, "x")
            .mapInArrow(scan, f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
                              "code string, error long"))


def commonest_length(embeddings: DataFrame, vec_col: str, parts: int) -> int | None:
    v = F.col(vec_col).cast("array<double>")
    row = (embeddings.where(finite(v) & (F.size(v) > 0) & (F.size(v) % parts == 0))
           .groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.desc("d")).first())
    return row.d if row else None


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS, scale: int = SCALE, dimensions: int | None = None,
           id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding"
           ) -> tuple[DataFrame, History]:
    """(vec_id, label, code, error) of every kept row, and the codebooks of all rounds.

    At most 256 entries: a code has one byte for each part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = embeddings.sparkSession
    ship(spark)
    types = dict(embeddings.dtypes)
    kinds = {"vec_id": types[id_col], "label": types[label_col]}
    dimensions = dimensions or commonest_length(embeddings, vec_col, parts)
    if not dimensions:
        empty = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
        return spark.createDataFrame([], empty), History(np.zeros((parts, 0, 0), "i8"))
    v = F.col(vec_col).cast("array<double>")
    vectors = bucketed(numbered(embeddings, scale, (F.size(v) == dimensions) & finite(v),
                                {id_col: "vec_id", label_col: "label"}, vec_col),
                       "parts", "rid")
    first = vectors.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x") \
        .limit(entries).collect()
    start = np.array([r.x for r in first], "i8").reshape(len(first), parts, -1)
    history = History(start.transpose(1, 0, 2).copy())
    shape = history.books[0].shape
    n, sums = np.zeros(shape[:2], "i8"), np.zeros(shape, "i8")
    names = [f.split(" ")[0] for f in BOUNDS.split(", ")]
    table, path = None, None
    for _ in range(rounds):
        if table is None:
            new = first_assignment(vectors, history)
        else:
            rows = tested(table.where("rid is not null").select(*names), history)
            new = rows.where(~F.col("open")).select(*names).unionByName(
                reassigned(vectors, rows.where("open").drop("open"), history),
                allowMissingColumns=True)
        old, path = path, shared_folder(spark, "bounds")
        new.write.parquet(path)
        table = spark.read.schema(f"{BOUNDS}, {SUMS}").parquet(path)
        if old:
            removed(spark, old)
        changes = (table.where("rid is null").groupBy("part", "entry").agg(
            F.sum("n").alias("n"),
            F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(shape[2])]).alias("sums")))
        for row in changes.collect():
            n[row.part, row.entry] += row.n
            sums[row.part, row.entry] += np.array(row.sums, "i8")
        used = (n > 0)[:, :, None]
        history.books.append(np.where(used, sums // np.maximum(n, 1)[:, :, None],
                                      history.books[-1]))
    if table is None:  # no round: against the first codebooks
        table = written(first_assignment(vectors, history), "bounds")
    rows = table.where("rid is not null").select(*names)
    out = written(final_codes(vectors, rows, history, kinds), "codes")
    if path:
        removed(spark, path)
    return out, history


def codes(embeddings: DataFrame, **options) -> DataFrame:
    """Per kept row: ``vec_id``, ``code`` (hex), ``error``, ``label_error`` and
    ``codebooks_sha256``."""
    found, history = encode(embeddings, **options)
    numbers = ",".join(map(str, history.books[-1].reshape(-1).tolist()))
    same = found.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return (found.join(same, F.col("label").eqNullSafe(F.col("same")))
            .select("vec_id", "code", "error", "label_error",
                    F.lit(hashlib.sha256(numbers.encode()).hexdigest())
                    .alias("codebooks_sha256")))
