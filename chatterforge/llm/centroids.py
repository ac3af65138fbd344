"""Centroid clustering by Lloyd's rounds with partial-distance search.

Dimensions are taken in the order of their variance over all vectors, the largest first.  For each vector, the squared
differences to all centroids are added up over the first few dimensions; the centroid that looks nearest is
measured to its end and sets the bound.  For every other centroid the sum goes on in blocks of dimensions, and the
centroid is abandoned once its partial sum is strictly above the current best.  Survivors are summed over all
dimensions.  Sums are integers, so a partial sum never exceeds the whole one, and of equally near
centroids the one with the smaller number wins: the result is that of exhaustive search.

The table is read once a round and no row is shuffled: each task hands out one array of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.vectors import BLOCK, finite, integers, matrix, moved, summed, totals
from chatterforge.runtime import delete_folder, materialize, scratch_folder

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1:"
#: Dimensions that are added before a centroid can be abandoned.
STEP = 8


class Search:
    """Nearest centroids of blocks of vectors; ``terms`` counts the squared differences that were added."""

    def __init__(self, centroids: np.ndarray, order: np.ndarray, step: int = STEP):
        self.order, self.step, self.terms = order, step, 0
        self.centroids = centroids[:, order]

    def _ahead(self, x: np.ndarray, rows: np.ndarray, k: np.ndarray | int, partial: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Partial sums of some rows with the next dimensions added."""
        d = x[rows, begin:end] - self.centroids[k, begin:end]
        self.terms += d.size
        return partial + (d * d).sum(axis=-1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the centroid, squared distance) of each vector."""
        x, every = vectors[:, self.order], np.arange(len(vectors))
        dim = x.shape[1]
        head = np.stack([self._ahead(x, every, k, np.zeros(len(x), np.int64), 0, self.step) for k in range(len(self.centroids))], axis=1)
        at = head.argmin(axis=1)
        best = self._ahead(x, every, at, head[every, at], self.step, dim)
        promising = at.copy()
        for k in range(len(self.centroids)):
            alive = np.flatnonzero((promising != k) & (head[:, k] <= best))
            partial = head[alive, k]
            for begin in range(self.step, dim, self.step):
                if not len(alive):
                    break
                partial = self._ahead(x, alive, k, partial, begin, begin + self.step)
                stays = partial <= best[alive]
                alive, partial = alive[stays], partial[stays]
            better = (partial < best[alive]) | (k < at[alive])
            at[alive[better]], best[alive[better]] = k, partial[better]
        return at, best


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, max(1, BLOCK // dim)):
            batch = whole.slice(start, max(1, BLOCK // dim))
            yield batch, matrix(batch["vec"], dim)


def _moments(dim: int):
    """One array of the count, sums and sums of squares for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, [0] * dim, [0] * dim
        for _, x in _blocks(batches, dim):
            n += len(x)
            # Python's integers hold the squares of any number of rows.
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
            squares = [a + b for a, b in zip(squares, (x.astype(np.float64) ** 2).sum(axis=0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *map(float, total), *squares]], pa.list_(pa.float64()))], ["moments"])

    return run


def by_variance(rows: DataFrame, dim: int) -> np.ndarray:
    """Dimensions by falling variance; the order only steers how soon centroids are abandoned, never the result."""
    parts = rows.select("vec").mapInArrow(_moments(dim), "moments array<double>").select(F.posexplode("moments").alias("place", "n"))
    sums = {r["place"]: r["n"] for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    flat = np.array([sums[i] for i in range(1 + 2 * dim)])
    mean, mean_square = flat[1 : dim + 1] / flat[0], flat[dim + 1 :] / flat[0]
    return np.argsort(-(mean_square - mean**2), kind="stable")


def _sums(centroids: np.ndarray, order: np.ndarray):
    """One array for each task: for each centroid the sums and count of what it got, then the terms that were added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = Search(centroids, order), np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for _, x in _blocks(batches, centroids.shape[1]):
            total += summed(search.nearest(x)[0], x, len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel().tolist(), search.terms]], pa.list_(pa.int64()))], ["sums"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, order)
        for batch, x in _blocks(batches, centroids.shape[1]):
            at, best = search.nearest(x)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(at.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


class Clusters:
    """Final centroids, and the squared differences added in each round beside those of exhaustive search."""

    def __init__(self, centroids: np.ndarray, terms: list[int], all_terms: int):
        self.centroids, self.terms, self.all_terms = centroids, terms, all_terms

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dim: int = DIM,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, Clusters]:
    """``vec_id, cluster, distance`` of every vector with ``dim`` finite components, and the clusters.

    Other vectors, nulls among them, are left out.  Centroids start as the vectors whose ``seed`` and id have the smallest
    SHA-256; rows without an id come last, and rows that share one are ordered by vector.
    Repeated rows count as often as they stand there and get the same cluster; with fewer rows than centroids there are as
    few centroids.  An empty table gives an empty result.  Components beyond 2^27 after scaling raise
    an error, as distances would not fit 64 bits.  Other columns are not read.
    """
    spark = vectors.sparkSession
    found = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
    rows = found.where(finite(F.col("vec")) & (F.size("vec") == dim)).withColumn("vec", integers(F.col("vec"), scale))
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    start = rows.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "vec").limit(k).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint"
    if not start:
        return spark.createDataFrame([], schema), Clusters(np.zeros((0, dim), np.int64), [], 0)
    centroids = np.array([r["vec"] for r in start], np.int64)
    order = by_variance(rows, dim)
    folder, terms, n = scratch_folder(spark, "centroids"), [], 0
    for i in range(rounds):
        rows.select("vec").mapInArrow(_sums(centroids, order), "sums array<bigint>").write.parquet(f"{folder}/{i}")
        *sums, added = totals(spark.read.parquet(f"{folder}/{i}"), "sums")
        table = np.array(sums, object).reshape(len(centroids), dim + 1)
        n = int(table[:, -1].sum())
        terms.append(added)
        centroids = moved(centroids, table)
    delete_folder(spark, folder)
    return materialize(rows.mapInArrow(_assigned(centroids, order), schema)), Clusters(centroids, terms, n * len(centroids) * dim)


def with_inertia(assigned: DataFrame, clusters: Clusters) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and the digest of the centroid; one row for each centroid is looked up."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), d) for i, d in enumerate(clusters.digests())]
    told = spark.createDataFrame(rows, "__cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), F.col("cluster") == F.col("__cluster")).drop("__cluster")
