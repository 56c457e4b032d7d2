"""Bounded samples of labelled rows, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bitsieve.session import cut

#: Tasks that a sample is worked on in.
PARTS = 24


def stratified(df: DataFrame, label: str, per_label: int, key: Column) -> DataFrame:
    """About ``per_label`` rows of each label.

    A row is taken if the hash of its key is small enough for its label, so the
    same rows come every time and no label is gathered in one task. Null labels
    are left out; each other label has its share, however many there are.
    """
    rows = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    kind = StructType([StructField(label, df.schema[label].dataType), StructField("__share", DoubleType())])
    shares = df.sparkSession.createDataFrame([(value, min(1.0, per_label / n)) for value, n in counts.items()], kind)
    return rows.join(F.broadcast(shares), label).where(draw < F.col("__share")).select(df.columns)


def labelled(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, outside: Column, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(k, y, t): texts of about ``per_label`` rows of labels 0 and 1 each; and the labels' counts.

    The rows are drawn from the narrow table of labels, where ``outside`` (a
    condition on ``k``) holds. Their ids, about ``2 * per_label``, are broadcast, so
    that of the texts only the sample moves; it is written once, for all that reads
    it. An id with both labels teaches nothing and is left out.
    """
    known = labels.select(F.col(doc_id).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & outside)
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("k", "y")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ids = df.sparkSession.createDataFrame([(r.k, r.y) for r in stratified(known, "y", per_label, F.col("k")).collect()], "k BIGINT, y INT")
    texts = df.select(F.col(doc_id).cast("bigint").alias("k"), F.col(text).alias("t"))
    return cut(texts.join(F.broadcast(ids), "k").select("k", "y", "t").repartition(PARTS, "k")), counts


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights and, last, the intercept; Newton steps with an L2 penalty on the weights."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
