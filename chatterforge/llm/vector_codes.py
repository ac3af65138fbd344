"""Compression of vectors to short codes: a product quantiser whose codebooks are fitted by Elkan's form of Lloyd's rounds.

A vector is cut into equal parts, each part position has a codebook, and a part becomes the number of its nearest entry.
Each row keeps, from round to round, an upper bound of the distance from each part to its entry and one lower
bound for each entry.  A round shifts the bounds by how far the entries moved and prunes by the triangle inequality:

* a part keeps its entry without any distance where its upper bound is below half the distance from that entry to the
  nearest other one;
* an entry is left out where its lower bound, or half its distance from the part's entry, is above the upper bound.

All comparisons are strict, so what is left out is farther away, never equally near.  What remains is
measured in integers, and of equally near entries the one with the lower number wins; the codes are those of
exhaustive search.

Bounds are kept rounded outwards: 32 bits for upper ones, 16 bits for lower ones.  Each round
writes one table of rows with codes and bounds into the shared folder and deletes the one before.  Sums for the new
entries leave each task as one array, so the driver sees as many numbers as the codebooks hold and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.common import sendable
from chatterforge.llm.vectors import BLOCK, finite, integers, matrix, moved, summed, totals
from chatterforge.runtime import delete_folder, materialize, scratch_folder

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: What floating point may add to or take from a bound, as a share of it.
SLACK = 1e-9
_HALF_MOST = float(np.finfo(np.float16).max)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def distances(entries: np.ndarray) -> np.ndarray:
    """Halves of the distances between the entries of each part, never too large; infinite to the entry itself."""
    half = np.sqrt(squared(entries[:, :, None], entries[:, None, :]).astype(np.float64)) * (0.5 - SLACK)
    half[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.inf
    return half


def rounded_up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def rounded_down(x: np.ndarray) -> np.ndarray:
    """16-bit numbers not above x; those beyond the range become its largest, which is a weaker bound and still right."""
    x = np.minimum(x * (1 - SLACK), _HALF_MOST)
    half = x.astype(np.float16)
    return np.where(half.astype(np.float64) > x, np.nextafter(half, np.float16(0)), half)


class Bounds:
    """Codes and bounds of a block of vectors: ``code`` and ``upper`` (n, parts), ``lower`` (n, parts, entries)."""

    def __init__(self, vectors: np.ndarray, entries: np.ndarray):
        """Every part is measured against every entry of its codebook."""
        n, parts = len(vectors), len(entries)
        self.code = np.zeros((n, parts), np.uint8)
        self.upper = np.zeros((n, parts))
        self.lower = np.zeros((n, parts, entries.shape[1]))
        self.measured = self.lower.size
        for p, x in enumerate(np.split(vectors, parts, axis=1)):
            found = squared(x[:, None], entries[p][None])
            self.code[:, p] = found.argmin(axis=1)  # the first of equal ones
            self.lower[:, p] = np.sqrt(found.astype(np.float64))
            self.upper[:, p] = self.lower[np.arange(n), p, self.code[:, p]]

    @classmethod
    def kept(cls, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, shift: np.ndarray) -> Bounds:
        """Bounds of the round before, after the entries moved by ``shift`` (parts, entries)."""
        self = cls.__new__(cls)
        self.code, self.measured = code.copy(), 0
        self.upper = upper.astype(np.float64) + shift[np.arange(len(shift))[None], code] * (1 + SLACK)
        self.lower = np.maximum(lower.astype(np.float64) - shift[None] * (1 + SLACK), 0)
        return self

    def assign(self, vectors: np.ndarray, entries: np.ndarray, half: np.ndarray) -> None:
        """Move each part to its nearest entry; ``half`` is that of :func:`distances`."""
        near = half.min(axis=2)
        for p, x in enumerate(np.split(vectors, len(entries), axis=1)):
            rows = np.flatnonzero(self.upper[:, p] >= near[p, self.code[:, p]])
            if not len(rows):
                continue
            x, at, low = x[rows], self.code[rows, p].astype(np.int64), self.lower[rows, p]
            best = squared(x, entries[p, at])
            up = np.sqrt(best.astype(np.float64))
            low[np.arange(len(rows)), at] = up
            self.measured += len(rows)
            for k in range(entries.shape[1]):
                above = up * (1 + SLACK)
                some = np.flatnonzero((at != k) & (low[:, k] * (1 - SLACK) <= above) & (half[p, at, k] <= above))
                if len(some):
                    d = squared(x[some], entries[p, k])
                    low[some, k] = np.sqrt(d.astype(np.float64))
                    better = (d < best[some]) | ((d == best[some]) & (k < at[some]))
                    rows_better = some[better]
                    best[rows_better], at[rows_better] = d[better], k
                    up[rows_better] = low[rows_better, k]
                    self.measured += len(some)
            self.code[rows, p], self.upper[rows, p], self.lower[rows, p] = at, up, low


def _packed(a: np.ndarray) -> pa.Array:
    """Rows of an array as one binary value each."""
    width = a[:1].nbytes if len(a) else 1
    offsets = np.arange(len(a) + 1, dtype=np.int64) * width
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(a))])
    return found.cast(pa.binary())


def _unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _round(entries: np.ndarray, shift: np.ndarray | None):
    """A round for the rows of a task; the last batch carries the task's sums."""
    parts, k, width = entries.shape
    dim, half = parts * width, distances(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, measured, waiting = np.zeros((parts, k, width + 1), np.int64), 0, None
        for whole in batches:
            for start in range(0, whole.num_rows, max(1, BLOCK // (dim + parts * k))):
                batch = whole.slice(start, max(1, BLOCK // (dim + parts * k)))
                vectors = matrix(batch["vec"], dim)
                if shift is None:
                    b = Bounds(vectors, entries)
                else:
                    held = [_unpacked(batch[c], t, *s) for c, t, s in (("code", np.uint8, (parts,)), ("upper", np.float32, (parts,)), ("lower", np.float16, (parts, k)))]
                    b = Bounds.kept(*held, shift)
                    b.assign(vectors, entries, half)
                for p, x in enumerate(np.split(vectors, parts, axis=1)):
                    total[p] += summed(b.code[:, p], x, k)
                measured += b.measured
                if waiting is not None:
                    yield waiting
                kept = [batch["vec_id"], batch["label"], batch["vec"], _packed(b.code), _packed(rounded_up(b.upper)), _packed(rounded_down(b.lower))]
                waiting = pa.RecordBatch.from_arrays([*kept, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], _NAMES)
        if waiting is not None:
            sums = [None] * (waiting.num_rows - 1) + [[*total.ravel().tolist(), measured]]
            yield pa.RecordBatch.from_arrays([*waiting.columns[:-1], pa.array(sums, pa.list_(pa.int64()))], _NAMES)

    return run


_NAMES = ["vec_id", "label", "vec", "code", "upper", "lower", "sums"]


def _spelled(entries: np.ndarray):
    """Codes as hex digits and the exact squared distance, for the last codebooks."""
    parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, vectors = _unpacked(batch["code"], np.uint8, parts), matrix(batch["vec"], parts * width)
            error = np.zeros(len(code), np.int64)
            for p, x in enumerate(np.split(vectors, parts, axis=1)):
                error += squared(x, entries[p, code[:, p]])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


class Codebooks:
    """Fitted entries (parts, entries, width), the digest of their numbers, and distances measured in each round."""

    def __init__(self, entries: np.ndarray, measured: list[int]):
        self.entries, self.measured = entries, measured

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """``vec_id, label, vec`` (integers) of the rows that can be coded."""
    v = F.col(vec_col)
    found = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("vec"))
    return found.where(finite(F.col("vec")) & (F.size("vec") > 0) & (F.size("vec") % parts == 0)).withColumn("vec", integers(F.col("vec"), scale))


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of every usable vector, and the codebooks.

    Rows whose vector is null, empty, holds a null or a value that is no finite number, or cannot be cut into equal
    parts are left out, as are vectors of another length than that of the first usable one by ``vec_id``.
    The codebooks start as the parts of the first rows by ``vec_id``, then by vector; rows without an id come
    last.  Repeated rows count as often as they stand there and get the same code; with fewer rows than
    entries, the codebooks are as small.  An empty table gives an empty result.  Components that
    are beyond 2^27 after scaling raise an error, as their distances would not fit 64 bits.  Other
    columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, label_col, parts, scale)
    order = [F.col("vec_id").asc_nulls_last(), "vec"]
    first = rows.orderBy(*order).limit(1).collect()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if not first:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), Codebooks(np.zeros((parts, 0, 0), np.int64), [])
    dim = len(first[0]["vec"])
    rows = rows.where(F.size("vec") == dim)
    start = np.array([r["vec"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    book = np.stack(np.split(start, parts, axis=1))
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec array<int>, code binary, upper binary, lower binary, sums array<bigint>"
    folder, shift, measured = scratch_folder(spark, "codes"), None, []
    for n in range(rounds + 1):
        rows.mapInArrow(_round(book, shift), schema).write.parquet(f"{folder}/{n}")
        if n:
            delete_folder(spark, f"{folder}/{n - 1}")
        kept = spark.read.schema(schema).parquet(f"{folder}/{n}")
        *sums, m = totals(kept, "sums")
        measured.append(m)
        rows = kept.drop("sums")
        if n < rounds:
            new = np.stack([moved(e, s) for e, s in zip(book, np.array(sums, object).reshape(parts, len(start), -1))])
            shift, book = np.sqrt(squared(new, book).astype(np.float64)), new
    coded = rows.select("vec_id", "label", "vec", "code").mapInArrow(_spelled(book), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")
    coded = materialize(coded)
    delete_folder(spark, folder)
    return coded, Codebooks(book, measured)


def with_label_error(coded: DataFrame, rows: int = 100_000) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together; summed before it is joined."""
    sums = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")))
    sums = sendable(sums.withColumnRenamed("label", "__label"), rows)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
