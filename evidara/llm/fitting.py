"""Bounded labelled samples on the driver, and held-out folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that a classifier is fitted on at most; scoring takes texts of any length, whole.
FIT_CHARS = 1 << 15


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo folds; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def window(text: Column, doc_id: Column, most: int) -> Column:
    """The text, or of a longer one `most` characters from a place that the doc_id draws."""
    room = F.length(text) - most
    first = F.pmod(F.xxhash64(doc_id, F.lit("window")), F.greatest(room, F.lit(0)) + 1) + 1
    return F.when(room > 0, F.substr(text, first.cast("int"), F.lit(most))).otherwise(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: dict[int, int], chars: int = FIT_CHARS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of up to most[y] labelled documents of each class y, outside the held-out fold.

    The sample is in seeded hash order, so reruns agree. Weights restore the share that each class has among all labelled
    rows. A doc_id labelled twice takes the smaller label, one of several texts the least; null labels and null texts are
    left out. Of a text over `chars` characters a window of so many is taken, drawn by its doc_id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y")).where(F.col("y").isin(*most))
    chosen, total = [], {}
    for y, n in most.items():
        own = known.where(F.col("y") == y)
        total[y] = own.count()
        chosen += own.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(n).collect()
    if not chosen:
        return [], np.zeros(0), np.zeros(0)
    picked = docs.sparkSession.createDataFrame(chosen, known.schema)  # at most the sum of most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    cut = texts.join(F.broadcast(picked), "doc_id").withColumn("text", window(F.col("text"), F.col("doc_id"), chars))
    once = cut.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = once.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").toLocalIterator()
    found = [(r.text.encode(), r.y) for r in rows]
    y = np.array([k for _, k in found], float)
    weight = np.ones(len(y))
    for k in most:
        if (y == k).any():
            weight[y == k] = total[k] / (y == k).sum()
    return [t for t, _ in found], y, weight * len(y) / max(weight.sum(), 1e-9)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton's method; the first belongs to the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pull[0, 0] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weight * (p - y)) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def base_rate(y: np.ndarray, weight: np.ndarray) -> float:
    return float((y * weight).sum() / weight.sum()) if len(y) else 0.5
