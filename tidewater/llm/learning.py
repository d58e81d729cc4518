"""Choice of labelled rows to learn from, and logistic loss minimised on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the document's number as text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most_rows: int) -> DataFrame:
    """doc_id, text, label of up to `most_rows` labelled documents outside the held-out fold, by order of a hash.

    A document with several labels counts once, with the greatest; of repeated rows one is learned from. The chosen
    labels are at most `most_rows` rows, which is why they are broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def minimise(gradient, start: np.ndarray, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam on a function that gives the gradient of a smooth convex loss; deterministic."""
    w, m, v = start.astype(float).copy(), np.zeros_like(start, float), np.zeros_like(start, float)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - 0.9 * (t / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
