"""Quality by a regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed towards a normal shape. Each class
has a mean and a covariance, shrunk towards the common one and towards its
diagonal, by amounts that cross-validation picks. A score is the difference of
the classes' log-densities, whose Mahalanobis distances come from Cholesky
factors inverted once; a logistic curve maps it to a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import as_bytes, fold, raw, table
from bitsieve.llm.learn import labelled, logistic, sigmoid

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled rows of each label that the classes are estimated from, or so.
SAMPLE = 10_000
#: Shrinkage towards the common covariance, and of either towards its diagonal, that are tried.
TOWARDS_COMMON = (0.0, 0.05, 0.2, 0.5)
TOWARDS_DIAGONAL = (0.01, 0.1, 0.3)
STATISTICS = ("bytes", "words", "word_bytes", "upper", "letters", "digits", "marks", "marks_per_word", "stops", "above_ascii", "lines", "lines_again", "types", "pairs", "stutter", "entropy", "packed")
_OF = {
    "upper": [*range(65, 91)],
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "digit": [*range(48, 58)],
    "mark": [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"],
    "stop": [ord(c) for c in ".,;:?"],
    "high": [*range(128, 256)],
}
_MASKS = np.zeros((256, len(_OF)))
for _k, _codes in enumerate(_OF.values()):
    _MASKS[_codes, _k] = 1


def statistics(text: str | bytes | None) -> list[float]:
    """Transformed statistics of a whole text's bytes, be they UTF-8 or not; null counts as empty."""
    data = as_bytes(text)
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, letter, digit, mark, stop, high = (counts @ _MASKS).tolist()
    words = data.split()
    k = len(words)
    lines = data.split(b"\n")
    p = counts[counts > 0] / n
    log = lambda a, b: float(np.log((a + 0.5) / (b + 1.0)))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        log(n, k),
        log(upper, letter),
        log(letter, n),
        log(digit, n),
        log(mark, n),
        log(mark, k),
        log(stop, k),
        log(high, n),
        log(len(lines), k),
        log(len(lines) - len(set(lines)), len(lines)),
        log(len(set(words)), k),
        log(len(set(zip(words, words[1:], strict=False))), k),
        log(sum(map(bytes.__eq__, words, words[1:])), k),
        float(-(p * np.log(p)).sum()),
        log(len(zlib.compress(data, 1)), n),
    ]


@dataclass
class Discriminant:
    """``means`` and inverted Cholesky factors by class; ``curve``: slope and intercept of the logistic map."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray
    curve: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density under class 1 less that under class 0."""
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - m) @ inv.T) ** 2).sum(1) for m, inv, c in zip(self.means, self.inverses, self.offsets, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.arcsinh(self.difference(x)) * self.curve[0] + self.curve[1])


def _fit(x: np.ndarray, y: np.ndarray, common: float, diagonal: float) -> Discriminant:
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(np.mean(y == c) * own[c] for c in (0, 1))
    inverses, offsets = [], []
    for c in (0, 1):
        s = (1 - common) * own[c] + common * pooled
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        low = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(low))
        offsets.append(-np.log(np.diag(low)).sum())
    d = Discriminant(centre, scale, means, np.stack(inverses), np.array(offsets), np.zeros(2))
    d.curve = logistic(np.arcsinh(d.difference(x))[:, None], y, ridge=1e-3)
    return d


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """The shrinkage with the least log-loss over five folds of the sample."""
    folds = np.arange(len(y)) % 5

    def loss(common: float, diagonal: float) -> float:
        total = 0.0
        for k in range(5):
            p = np.clip(_fit(x[folds != k], y[folds != k], common, diagonal).score(x[folds == k]), 1e-6, 1 - 1e-6)
            t = y[folds == k]
            total -= float((t * np.log(p) + (1 - t) * np.log(1 - p)).sum())
        return total

    usable = min(np.bincount(y, minlength=2)) >= 20
    best = min(((loss(a, b), a, b) for a in TOWARDS_COMMON for b in TOWARDS_DIAGONAL)) if usable else (0, 0.5, 0.3)
    return _fit(x, y, *best[1:])


def features(df: DataFrame, doc_id: str, text: str, keep: list[str] = ()) -> DataFrame:
    """(doc_id, kept columns, x ARRAY<DOUBLE>): the statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in raw(b.column(0))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", *keep, "x"])

    rows = df.select(F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"), *keep)
    extra = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id BIGINT, {extra}x ARRAY<DOUBLE>")


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = SAMPLE) -> Discriminant | float:
    """Learn from labelled rows outside the held-out fold, about ``per_label`` of each label at most.

    Class frequencies are those of all labelled rows. With one class only, its
    share (0 or 1) is returned; without labels, 0.5.
    """
    rows, counts = labelled(df, labels, doc_id, text, label, fold(F.col("k"), FOLDS) != HELD_OUT, per_label)
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    few = sorted(features(rows, "k", "t", ["y"]).collect(), key=lambda r: (r.doc_id, r.y, r.x))
    if not few:
        return counts[1] / (counts[0] + counts[1])
    x, y = np.array([r.x for r in few]), np.array([r.y for r in few], np.int64)
    if min(np.bincount(y, minlength=2)) < 2:
        return counts[1] / (counts[0] + counts[1])
    d = fit(x, y)
    taken = np.bincount(y, minlength=2)
    d.curve[1] += np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0])
    return d


def score(df: DataFrame, model: Discriminant | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, score.

    Null and empty texts have the statistics of an empty text; rows that repeat an
    id are scored each; an empty table gives an empty table. Other columns are
    ignored. The model (a few matrices) goes to the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.array([statistics(t) for t in raw(b.column(1))]).reshape(-1, len(STATISTICS))
            s = np.full(len(x), m) if isinstance(m, float) else m.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id BIGINT, score DOUBLE")


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    out = score(docs, train(docs, table(spark, d, "labels")))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
