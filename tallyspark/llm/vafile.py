"""K-means over a VA-file.

Every vector is approximated by one cell for each dimension, ``BITS`` bits each, cut at
approximate quantiles. The approximations are a narrow table of their own, and a round scans
that table only: lookup tables turn cells into their middles and half widths, which give an
interval for the distance to every centroid. Both distances of a pair of centroids depend on the
same place inside the cells, so an interval is stated relative to the centroid nearest the
middle, which is never wider than two intervals apart. Centroids whose interval lies above that
centroid's are out. Vectors are fetched only where intervals overlap, or where the round moves
them: centroid sums are kept and changed by what moves, so a vector that stays is not read.

Vectors lie bucketed by row number; a fetch shuffles the narrow rows that ask for one and
leaves the vectors where they are. A round has no state but the centroids before and after it:
what a vector was assigned to before is worked out from its cells again. So a lost executor
costs the tasks it ran. The driver holds centroids and cell limits, bounded by their numbers.

Distances are exact integers, ties go to the smaller number, and the result is that of plain
k-means, whatever the cells.

Defined cases: null vectors, vectors of another length and those with null or non-finite
components are dropped; repeated rows count as often as they occur and start several centroids
if chosen; null ids come last when centroids are chosen; with fewer vectors than centroids
each starts one; an empty table gives an empty result; other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import bucketed, ship, written
from tallyspark.llm.vectors import (blobs, finite, from_blobs, lists, matrix, numbered)

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
BITS = 6


class Grid:
    """Cells of every dimension: ``cuts`` has the least value of each cell but the first."""

    def __init__(self, cuts: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        self.cuts, self.bits = cuts, bits
        low = np.column_stack([least, cuts])
        high = np.column_stack([cuts - 1, most])
        self.middle, self.half = (low + high) / 2, (high - low) / 2

    def encode(self, x: np.ndarray) -> np.ndarray:
        cells = np.column_stack([np.searchsorted(c, x[:, d], side="right")
                                 for d, c in enumerate(self.cuts)]).astype("u1")
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return np.packbits(bits.reshape(len(x), -1), axis=1)

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half widths of the cells."""
        d = len(self.cuts)
        bits = np.unpackbits(codes, axis=1)[:, :d * self.bits].reshape(len(codes), d, self.bits)
        cells = np.packbits(bits, axis=2)[:, :, 0] >> (8 - self.bits)
        at = np.arange(d)
        return self.middle[at, cells], self.half[at, cells]

    @property
    def width(self) -> int:
        """Bytes of an approximation."""
        return -(-len(self.cuts) * self.bits // 8)


def grid_of(vectors: DataFrame, bits: int) -> Grid:
    shares = [k / 2**bits for k in range(1, 2**bits)]
    rows = (vectors.select(F.posexplode("x").alias("d", "v")).groupBy("d")
            .agg(F.min("v").alias("least"), F.max("v").alias("most"),
                 F.percentile_approx("v", shares, 1000).alias("cuts")).orderBy("d").collect())
    return Grid(np.array([r.cuts for r in rows], "i8"), np.array([r.least for r in rows], "i8"),
                np.array([r.most for r in rows], "i8"), bits)


def overlapping(middle: np.ndarray, half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For every vector and centroid: may it be the nearest, as far as the cells tell?"""
    c = centroids.astype("f8")
    size = (middle * middle).sum(axis=1)[:, None] + (c * c).sum(axis=1)
    at_middle = size - 2 * middle @ c.T
    best = at_middle.argmin(axis=1)
    out = np.zeros(at_middle.shape, bool)
    for k in np.unique(best):
        rows = np.flatnonzero(best == k)
        # The distance to centroid j less that to k is linear in the place in the cells.
        slack = 2 * half[rows] @ np.abs(c - c[k]).T + 1e-9 * size[rows]
        out[rows] = at_middle[rows] - at_middle[rows, k][:, None] <= slack
    return out


def nearest(x: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and exact squared distance, of those that may be nearest."""
    best = np.full(len(x), -1, "i4")
    least = np.full(len(x), np.iinfo("i8").max, "i8")
    for k, centroid in enumerate(centroids):
        rows = np.flatnonzero(may[:, k])
        far = ((x[rows] - centroid) ** 2).sum(axis=1)
        closer = far < least[rows]
        best[rows[closer]], least[rows[closer]] = k, far[closer]
    return best, least


def first_centroids(vectors: DataFrame, count: int) -> np.ndarray:
    """Vectors with the smallest hashes of their ids; equal hashes by components."""
    rows = (vectors.select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
                           .alias("hash"), "x")
            .orderBy(F.col("hash").asc_nulls_last(), "x").limit(count).collect())
    return np.array([r.x for r in rows], "i8")


def asked(cells: DataFrame, grid: Grid, before: np.ndarray | None, after: np.ndarray
          ) -> DataFrame:
    """(rid, before, after): rows whose vector is needed, with the centroids that may be
    nearest before and after as bits."""
    def scan(batches):
        for batch in batches:
            middle, half = grid.look_up(from_blobs(batch.column(1), grid.width))
            now = overlapping(middle, half, after)
            if before is None:
                was = np.zeros((len(now), 0), bool)
                open_ = np.ones(len(now), bool)
            else:
                was = overlapping(middle, half, before)
                open_ = ((now.sum(axis=1) > 1) | (was.sum(axis=1) > 1)
                         | (now.argmax(axis=1) != was.argmax(axis=1)))
            rows = np.flatnonzero(open_)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), blobs(np.packbits(was[rows], axis=1)),
                 blobs(np.packbits(now[rows], axis=1))], ["rid", "before", "after"])
    return cells.mapInArrow(scan, "rid long, before binary, after binary")


def bits_of(column: pa.Array, count: int) -> np.ndarray:
    return np.unpackbits(from_blobs(column, -(-count // 8)), axis=1)[:, :count].astype(bool)


def moves(vectors: DataFrame, wanted: DataFrame, before: np.ndarray | None,
          after: np.ndarray) -> DataFrame:
    """(cluster, n, sums): what the vectors that move add to their clusters and take away."""
    k, d = after.shape

    def total(batches):
        n, sums = np.zeros(k, "i8"), np.zeros((k, d), "i8")
        for batch in batches:
            x = matrix(batch.column(0), d)
            to, _ = nearest(x, bits_of(batch.column(2), k), after)
            if before is None:
                moved = np.arange(len(x))
            else:
                out, _ = nearest(x, bits_of(batch.column(1), k), before)
                moved = np.flatnonzero(out != to)
                np.subtract.at(n, out[moved], 1)
                np.subtract.at(sums, out[moved], x[moved])
            np.add.at(n, to[moved], 1)
            np.add.at(sums, to[moved], x[moved])
        some = np.flatnonzero(n.astype(bool) | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some]), lists(sums[some])],
            ["cluster", "n", "sums"])

    parts = (vectors.join(wanted, "rid").select("x", "before", "after")
             .mapInArrow(total, "cluster int, n long, sums array<long>"))
    return parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(d)])
        .alias("sums"))


def digest(numbers: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, numbers.reshape(-1).tolist())).encode()).hexdigest()


def cluster(embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS,
            bits: int = BITS, dimensions: int = DIMENSIONS, scale: int = SCALE,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept row, and the final centroids."""
    spark = embeddings.sparkSession
    ship(spark)
    v = F.col(vec_col).cast("array<double>")
    vectors = bucketed(numbered(embeddings, scale, (F.size(v) == dimensions) & finite(v),
                                {id_col: "vec_id"}, vec_col), "vectors", "rid")
    now = first_centroids(vectors, count)
    schema = f"vec_id {dict(embeddings.dtypes)[id_col]}, cluster int, distance long"
    if not len(now):
        return spark.createDataFrame([], schema), now
    grid = grid_of(vectors, bits)

    def encode(batches):
        for batch in batches:
            code = grid.encode(matrix(batch.column(1), dimensions))
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs(code)], ["rid", "code"])
    cells = written(vectors.select("rid", "x").mapInArrow(encode, "rid long, code binary"),
                    "cells")

    n, sums, before = np.zeros(len(now), "i8"), np.zeros(now.shape, "i8"), None
    for _ in range(rounds):
        for row in moves(vectors, asked(cells, grid, before, now), before, now).collect():
            n[row.cluster] += row.n
            sums[row.cluster] += np.array(row.sums, "i8")
        filled = (n > 0)[:, None]
        before, now = now, np.where(filled, sums // np.maximum(n, 1)[:, None], now)

    def label(batches):
        for batch in batches:
            best, least = nearest(matrix(batch.column(1), dimensions),
                                  bits_of(batch.column(2), len(now)), now)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best), pa.array(least)],
                ["vec_id", "cluster", "distance"])
    final = vectors.join(asked(cells, grid, None, now), "rid")
    return written(final.select("vec_id", "x", "after").mapInArrow(label, schema),
                   "assigned"), now


def clusters(embeddings: DataFrame, **options) -> DataFrame:
    """Per kept row: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``
    and ``centroid_sha256``."""
    assigned, centroids = cluster(embeddings, **options)
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    total = sum(r.s for r in sums)
    each = embeddings.sparkSession.createDataFrame(
        [(r.cluster, r.s, total, digest(centroids[r.cluster])) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each centroid.
    return assigned.join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
