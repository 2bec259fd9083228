"""Embedding rows as exact integers, shared by the operators on vectors.

Components are read as doubles, multiplied by a power of two and floored. The results must lie
within ``MOST`` either way, so that squared distances are exact in 64 bits; a table with a finite
component beyond that is refused with an error.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST = 2**27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    def floor(x):
        value = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(x) * scale <= MOST, value).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}")).cast("bigint"))
    return F.transform(vector, floor)


def numbered(embeddings: DataFrame, scale: int, keep: Column, columns: dict[str, str],
             vec_col: str) -> DataFrame:
    """(rid, the given columns renamed, x) of the rows to keep; ``rid`` tells rows apart and
    holds still once the frame is written."""
    v = F.col(vec_col).cast("array<double>")
    return embeddings.where(keep).select(
        F.monotonically_increasing_id().alias("rid"),
        *[F.col(c).alias(name) for c, name in columns.items()], whole(v, scale).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(rows: np.ndarray, kind=pa.int64()) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * np.int32(width)),
                                    pa.array(rows.reshape(-1), kind))


def blobs(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def from_blobs(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), width)
