"""Quality classifier: regularised quadratic discriminant on document statistics.

Each whole text becomes a short vector of transformed statistics (logarithms of
sizes and of smoothed shares).  For each class the mean and covariance are summed
by Spark over all labelled training rows; covariances are shrunk towards the
pooled one and its mean variance and factored once.  A text's score is the
posterior of class 1 from the difference of the two Mahalanobis log densities,
computed with the cached Cholesky factors.

Labels are learned only from rows whose crc32(id as text) mod ``FOLDS`` is not 0.
Id, labels, language and source never enter a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterforge.llm.common import id_text, materialize, utf8

FOLDS = 5
THRESHOLD = 0.3
#: Weight of the pooled covariance, then of its mean variance on the diagonal.
POOLED, DIAGONAL = 0.5, 0.02
#: Divides the log-density difference: the statistics are correlated and their
#: tails heavier than a Gaussian's, so the raw difference is overconfident.
TEMPERATURE = 8.0

STATISTICS = (
    "bytes", "words", "lines", "word_length", "word_spread", "longest_word", "upper", "digit", "space", "newline",
    "stop", "exclaim", "bar", "symbol", "other_punctuation", "non_ascii", "distinct_words", "top_word", "stutter",
    "short_words", "symbol_words", "repeated_lines", "compression", "entropy",
)
_GROUPS = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "space": b" \t",
    "newline": b"\n\r",
    "stop": b".,",
    "exclaim": b"!?",
    "bar": b"|<>{}[]\\/=_~^`",
    "symbol": b"#$%&*@+",
    "other_punctuation": b"\"'();:-",
}


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one UTF-8 text, in the order of STATISTICS."""
    words, size = data.split(), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    tally = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)

    def share(k: float, of: float) -> float:
        return float(np.log((k + 0.5) / (of + 1.0)))

    grouped = [share(counts[list(_GROUPS[g])].sum(), size) for g in _GROUPS]
    p = counts[counts > 0] / max(size, 1)
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        float(np.log1p(lengths.mean() if n else 0.0)),
        float(np.log1p(lengths.std() if n else 0.0)),
        float(np.log1p(lengths.max() if n else 0.0)),
        *grouped,
        share(counts[128:].sum(), size),
        float(np.log1p(len(tally)) - np.log1p(n)),
        share(max(tally.values(), default=0), n),
        share(sum(map(bytes.__eq__, words, words[1:])), n),
        share((lengths <= 3).sum(), n),
        share(sum(w[-1] in b"!#$%&*|" for w in words), n),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log((len(zlib.compress(data, 1)) + 1.0) / (size + 12.0))),
        float(-(p * np.log(p)).sum()),
    ]


@dataclass(frozen=True)
class Model:
    """Class priors, means, inverse Cholesky factors and log determinants, class 0 first."""

    log_priors: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    log_determinants: np.ndarray
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row of x."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse_factors[k].T
            density.append(self.log_priors[k] - 0.5 * (np.square(z).sum(1) + self.log_determinants[k]))
        return 1.0 / (1.0 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -60, 60)))


def solve(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], temperature: float = TEMPERATURE) -> Model:
    """A model from (rows, sums, sums of products) of each class.

    A class without rows takes the other's moments; without any rows both are
    standard normal, so that every score is 0.5.
    """
    d = len(STATISTICS)
    some = {k: v for k, v in moments.items() if v[0] > 0}
    if not some:
        eye = np.stack([np.eye(d)] * 2)
        return Model(np.log([0.5, 0.5]), np.zeros((2, d)), eye, np.zeros(2), temperature)
    n = np.array([some[k][0] if k in some else 0.0 for k in (0, 1)])
    means = np.stack([(some.get(k) or some[1 - k])[1] / (some.get(k) or some[1 - k])[0] for k in (0, 1)])
    scatter = {k: v[2] - np.outer(v[1], v[1]) / v[0] for k, v in some.items()}
    pooled = sum(scatter.values()) / max(n.sum() - len(some), 1.0)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, determinants = [], []
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1.0) if k in scatter else pooled
        mixed = ((1 - POOLED) * own + POOLED * pooled) / np.outer(scale, scale)
        mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.eye(d)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower) / scale)
        determinants.append(2 * np.log(np.diag(lower)).sum())
    return Model(np.log((n + 1) / (n.sum() + 2)), means, np.stack(factors), np.array(determinants), temperature)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in utf8(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return id_text(docs, id_col, text_col).mapInArrow(_statistics_batches, "doc_id bigint, x array<double>")


def in_fold(doc_id, folds: int = FOLDS):
    """Whether an id is held out; a null id always is, as nothing can be learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def _moment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class, one vector of the upper triangle of (1, x) (1, x)^T, summed over the task."""
    d = len(STATISTICS)
    sums = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        x = np.column_stack([np.ones(batch.num_rows), np.array(batch["x"].flatten()).reshape(batch.num_rows, d)])
        y = np.array(batch["y"])
        for k in (0, 1):
            sums[k] += x[y == k].T @ x[y == k]
    place = np.arange((d + 1) ** 2)
    for k in (0, 1):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(place), k, np.int32)), pa.array(place, pa.int64()), pa.array(sums[k].ravel())], ["y", "i", "v"]
        )


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """The model from every labelled row of the training folds; only summed moments reach the driver."""
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").where(~in_fold(F.col("doc_id")))
    rows = stats.join(known, "doc_id").select("x", "y")
    summed = rows.mapInArrow(_moment_batches, "y int, i bigint, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    d = len(STATISTICS) + 1
    grid = np.zeros((2, d * d))
    for r in summed.collect():
        grid[r["y"], r["i"]] = r["v"]
    grid = grid.reshape(2, d, d)
    return solve({k: (grid[k, 0, 0], grid[k, 0, 1:], grid[k, 1:, 1:]) for k in (0, 1)})


def _score_batches(model, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].flatten()).reshape(batch.num_rows, len(STATISTICS))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts are scored from their (all zero) counts, very long ones from counts of the whole text.  Repeated rows are
    returned as they are; a null id is held out.  Label rows with a null id or a
    label other than 0 and 1 are not used; repeated ones count each time.  Without
    usable labels every score is 0.5.  An empty table gives an empty result.
    """
    stats = materialize(document_statistics(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))
    return stats.withColumn("held_out", in_fold(F.col("doc_id"))).mapInArrow(
        _score_batches(model, threshold), "doc_id bigint, held_out boolean, score double, predicted int"
    )


def _keep_batches(model, text_col: str, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in utf8(batch[text_col])]).reshape(batch.num_rows, len(STATISTICS))
            yield batch.filter(pa.array(model.value.score(x) >= threshold))

    return run


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` does not reject, all columns as they are.

    Only the statistics move for the fit; the verdict on a text is made where the
    text is read, so null, empty, very long and repeated texts and null ids are treated as there.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~in_fold(F.col(id_col).cast("bigint")))
    wanted = known.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    stats = materialize(document_statistics(docs, id_col, text_col).join(wanted, "doc_id", "left_semi"))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, id_col=id_col))
    schema = T.StructType(docs.schema.fields)
    return docs.mapInArrow(_keep_batches(model, text_col, threshold), schema)
