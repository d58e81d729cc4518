"""A quality classifier: Bradley-Terry scores learned from preference pairs, cut at a quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.learning import fold, labelled_sample, minimise, sigmoid
from tidewater.llm.vector import SPACES, lean, mix, slices, text_bytes, words

FOLDS, HELD_OUT = 4, 2
CUT = 0.7
FEATURES = (
    "no_words", "few_words", "symbols", "bars", "marks", "upper", "digits", "long_words", "short_words", "repeated_next", "repeated", "repeated_lines", "no_stops",
)
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"#$%&*@^~_=+<>\\{}[]", b"|", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"\n", SPACES.replace(b"\n", b"")), 1):
    _KIND[list(_bytes)] = _kind


def _per_doc(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, minlength=n)[:n].astype(float)


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each document (of 44 bits of them)."""
    keys = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return _per_doc((keys[first] >> np.uint64(44)).astype(np.int64), n)


def features(text: pa.Array) -> np.ndarray:
    """FEATURES of each text: shares between 0 and 1 that saturate where a text is plainly odd."""
    n = len(text)
    data, ends = text_bytes(text)
    found = words(text)
    n_words = _per_doc(found.doc, n)
    least_words, size = np.maximum(n_words, 1), np.maximum(np.diff(ends).astype(float), 1)
    kind = _KIND[data]
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])[ends]).astype(float)
    same = (found.hash[1:] == found.hash[:-1]) & (found.doc[1:] == found.doc[:-1]) if len(found.hash) else np.zeros(0, bool)
    next_same = _per_doc(found.doc[1:][same], n)
    distinct = _distinct(found.doc, found.hash, n)
    # A line is named by the sum of its words' hashes at their places.
    lines = np.concatenate([[0], np.cumsum(kind == 7, dtype=np.int64)])[found.start] if len(found.start) else np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (lines[1:] != lines[:-1]) | (found.doc[1:] != found.doc[:-1])])) if len(lines) else np.zeros(0, np.int64)
    place = np.arange(len(lines)) - np.repeat(begin, np.diff(np.append(begin, len(lines))))
    line = mix(np.add.reduceat(mix(found.hash + place.astype(np.uint64)), begin)) if len(begin) else np.zeros(0, np.uint64)
    n_lines = _per_doc(found.doc[begin], n)
    new_lines = _distinct(found.doc[begin], line, n)
    mean = _per_doc(found.doc, n, found.size.astype(float)) / least_words
    # Longer texts repeat more words; a text of many words keeps about words ** 0.9 / 1.2 of them distinct at least.
    expected = np.minimum(n_words, 0.5 * np.power(least_words, 0.92))
    columns = (
        n_words == 0, np.clip(1 - n_words / 8, 0, 1), np.clip(20 * count(1) / size, 0, 1), np.clip(10 * count(2) / least_words, 0, 1), np.clip(4 * count(3) / least_words, 0, 1),
        np.clip(5 * (count(4) / size - 0.04), 0, 1), np.clip(3 * count(5) / size, 0, 1), np.clip((mean - 7) / 4, 0, 1), np.clip((4 - mean) / 3, 0, 1),
        np.clip(8 * next_same / least_words, 0, 1), np.clip(2 * (1 - distinct / np.maximum(expected, 1)), 0, 1), np.clip(3 * (1 - new_lines / np.maximum(n_lines, 1)), 0, 1),
        np.clip(1 - 30 * count(6) / least_words, 0, 1),
    )
    return np.column_stack([np.asarray(c, float) for c in columns]) if n else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Ranking:
    """Strength of a text: the weighted sum of its features. `cut` is the strength at the chosen quantile, `scale` a unit."""

    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Strengths as numbers between 0 and 1; CUT at the quantile."""
        return sigmoid((x @ self.weights - self.cut) / self.scale + np.log(CUT / (1 - CUT)))


def fit_pairs(x: np.ndarray, y: np.ndarray, most_pairs: int = 60_000, penalty: float = 1e-3, seed: int = 5) -> Ranking:
    """Bradley-Terry: P(i before j) = sigmoid(w (x_i - x_j)), fitted to pairs of a text labelled 1 and one labelled 0.

    The cut is the quantile of strengths of all of `x` at which most labels agree, taken in the middle between the
    texts around it. Without both labels there is no pair: all strengths are 0, and all texts score as the label seen.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1]), -1.0 if not len(bad) else 1.0, 0.25)
    rng = np.random.default_rng(seed)
    each = max(1, min(most_pairs // len(bad), 40))
    worse = np.repeat(bad, each)[:most_pairs]
    better = rng.choice(good, len(worse))
    d = x[better] - x[worse]
    w = minimise(lambda w: -(d * (1 - sigmoid(d @ w))[:, None]).mean(0) + penalty * w, np.zeros(x.shape[1]))
    s = x @ w
    order = np.argsort(s, kind="stable")
    ranked, label = s[order], y[order]
    # Rows below a cut are called 0: agreement is the zeros below and the ones from there on.
    agree = np.concatenate([[0], np.cumsum(label == 0)]) + np.concatenate([np.cumsum((label == 1)[::-1])[::-1], [0]])
    valid = np.concatenate([[True], ranked[1:] > ranked[:-1], [True]])
    at = int(np.flatnonzero(valid)[np.argmax(agree[valid])])
    cut = ranked[0] - 1 if at == 0 else ranked[-1] + 1 if at == len(ranked) else (ranked[at - 1] + ranked[at]) / 2
    return Ranking(w, float(cut), float(max(np.std(s) / 2, 1e-6)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Ranking:
    """Learns from up to `most_rows` labelled rows (doc_id, quality) outside the held-out fold; features are made in tasks."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, most_rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "label").mapInArrow(lean(task), f"doc_id {kind}, label int, x array<double>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    learned = rows.orderBy("doc_id").toPandas()
    x = np.array(learned["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_pairs(x, learned["label"].to_numpy(int))


def classify(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from CUT on) of each row of `docs` (doc_id, text).

    Nulls and empty texts have the features of a text without words. Equal texts score alike; an empty table gives no rows;
    other columns are ignored. No row leaves its partition.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ranking.score(features(part.column(1))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(task), f"doc_id {kind}, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
