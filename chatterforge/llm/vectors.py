"""What the two vector operators share: usable rows, integer components, sums that tasks add up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are integers of at most this size, so that squared distances fit 64 bits.
MOST = 1 << 27
#: Components that are worked on at once in a task.
BLOCK = 1 << 20


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor values that are no finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; an error names a component beyond ``MOST``."""
    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        told = F.raise_error(F.concat(F.lit("a vector component is too large for 64-bit distances: "), x.cast("string")))
        return F.when(F.abs(F.lit(float(scale)) * x.cast("double")) < float(MOST), y.cast("int")).otherwise(told.cast("int"))

    return F.transform(vector, whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def summed(found: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """k x (d + 1) sums of the components and counts of the vectors that each of k entries got."""
    total = np.zeros((k, vectors.shape[1] + 1), np.int64)
    chosen = (found[None, :] == np.arange(k)[:, None]).astype(np.int64)
    total[:, :-1], total[:, -1] = chosen @ vectors, chosen.sum(axis=1)
    return total


def totals(parts: DataFrame, column: str) -> list[int]:
    """The place-wise sums of an array column that each task filled once; as many numbers as the array has."""
    places = parts.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("place", "n"))
    rows = places.groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    return [int(r["n"]) for r in sorted(rows, key=lambda r: r["place"])]


def moved(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry's floored mean of what it got (Python integers, any size); those that got nothing stay."""
    new = [[s // row[-1] for s in row[:-1]] if row[-1] else list(map(int, entry)) for entry, row in zip(entries, sums.tolist())]
    return np.array(new, np.int64).reshape(entries.shape)
