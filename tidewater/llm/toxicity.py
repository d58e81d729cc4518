"""A toxicity classifier whose training penalises score changes when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.learning import fold, labelled_sample, minimise, sigmoid
from tidewater.llm.vector import ALNUM, Words, lean, slices, words

FOLDS, HELD_OUT = 3, 1
CUT = 0.7
#: First bytes of longer words that count as features besides the words themselves.
PREFIXES = (4, 5, 6, 7, 8)
#: Groups of terms of which one can stand for another (fixed word lists).
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("immigrants", "natives", "refugees"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def swapped(text: str, groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> str:
    """The text with each identity term replaced by the next one of its group."""
    following = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    return re.sub(r"\w+", lambda m: following.get(m[0].lower(), m[0]), text)


def _features(text: pa.Array) -> tuple[Words, list[np.ndarray]]:
    found = words(pc.utf8_lower(text), ALNUM, prefixes=PREFIXES)
    return found, [found.hash, *found.prefix.values()]


@dataclass(frozen=True)
class Model:
    """Sorted 64-bit feature hashes, their weights, and the constant."""

    keys: np.ndarray
    weights: np.ndarray
    constant: float

    def hits(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature number) of the model's features that each text has, once each."""
        found, hashes = _features(text)
        known = np.zeros(1 << 16, bool)
        known[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h in hashes:
            maybe = np.flatnonzero(known[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(self.keys, h[maybe])
            at[at == len(self.keys)] = 0
            is_hit = self.keys[at] == h[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
            docs.append(found.doc[maybe[is_hit]])
            places.append(at[is_hit])
        both = np.unique(np.concatenate(docs) * max(len(self.keys), 1) + np.concatenate(places))
        return both // max(len(self.keys), 1), both % max(len(self.keys), 1)

    def score(self, text: pa.Array) -> np.ndarray:
        doc, at = self.hits(text)
        return sigmoid(np.bincount(doc, self.weights[at], minlength=len(text))[: len(text)] + self.constant)


@dataclass(frozen=True)
class Rows:
    """Documents by features, 0 or 1: the (row, column) places of the ones."""

    row: np.ndarray
    column: np.ndarray
    n: int

    @staticmethod
    def of(lists: Sequence[np.ndarray]) -> Rows:
        sizes = np.array([len(x) for x in lists], int)
        return Rows(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32), len(sizes))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], minlength=self.n)

    def back(self, e: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, e[self.row], minlength=width)


def fit_logistic(x: Rows, y: np.ndarray, swap: tuple[Rows, Rows], width: int, fairness: float = 5.0, penalty: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and constant by logistic loss + penalty |w|^2 + fairness * mean squared change of the logit under swaps.

    x: features of the documents; swap: those of the documents with identity terms, as they are and swapped.
    """
    share = max(y.mean(), 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6))

    def gradient(w: np.ndarray) -> np.ndarray:
        error = weight * (sigmoid(x.times(w[:-1]) + w[-1]) - y) / len(y)
        g = np.append(x.back(error, width) + penalty * w[:-1], error.sum())
        if swap[0].n:
            change = 2 * fairness * (swap[0].times(w[:-1]) - swap[1].times(w[:-1])) / swap[0].n
            g[:-1] += swap[0].back(change, width) - swap[1].back(change, width)
        return g

    w = minimise(gradient, np.zeros(width + 1), steps=300, rate=0.15)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, most_rows: int = 24_000, most_features: int = 2_048, least_z: float = 5.0, fairness: float = 5.0, groups: Sequence[Sequence[str]] = IDENTITY_TERMS
) -> Model:
    """Learns from up to `most_rows` labelled rows (doc_id, toxic) outside the held-out fold.

    Features are words and beginnings of words, counted by Spark over the sample; those whose share among toxic
    documents differs by `least_z` standard errors are kept, `most_features` of them, besides the identity terms that
    occur. Only those features of the sample come to the driver. Without both labels the model knows only their share.
    """
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, most_rows).dropDuplicates(["doc_id"]).select("doc_id", "text", "label").persist()
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(n for k, n in counts.items() if k == 1), sum(n for k, n in counts.items() if k != 1)
    none = np.zeros(0)
    if not n1 or not n0:
        sample.unpersist()
        return Model(np.zeros(0, np.uint64), none, float(np.log((n1 + 0.5) / (n0 + 1.5))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found, hashes = _features(part.column(0))
                toxic = part.column(1).to_numpy(zero_copy_only=False)
                doc = np.concatenate([found.doc] * len(hashes))
                h = np.concatenate(hashes)
                pair = np.unique(np.stack([h[h != 0], doc[h != 0].astype(np.uint64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                keys, at = np.unique(pair[:, 0], return_inverse=True)
                ones = np.bincount(at, (toxic[pair[:, 1].astype(np.int64)] == 1), minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ones.astype(np.int64)), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))], names=["key", "ones", "n"])

    terms = words(pa.array([" ".join(t for g in groups for t in g)]), ALNUM).hash.view(np.int64).tolist()
    seen = sample.select("text", "label").mapInArrow(lean(gather), "key long, ones long, n long").groupBy("key").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    p, p1, p0 = F.col("n") / (n1 + n0), F.col("ones") / n1, (F.col("n") - F.col("ones")) / n0
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    seen = seen.withColumn("z", F.abs(z)).withColumn("term", F.col("key").isin(terms))
    chosen = seen.filter("term OR (n >= 3 AND z >= %r)" % least_z).orderBy(F.col("term").desc(), F.col("z").desc(), "key").limit(most_features)
    keys = np.sort(np.array([r["key"] for r in chosen.select("key").collect()], np.int64).view(np.uint64))
    blank = Model(keys, np.zeros(len(keys)), 0.0)
    pattern = "|".join(sorted(t for g in groups for t in g))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                text, label = part.column(0), part.column(1)
                doc, at = blank.hits(text)
                lists = [at[a:b].tolist() for a, b in zip(*(np.searchsorted(doc, np.arange(len(text)), side=s) for s in ("left", "right")))]
                plain = text.to_pylist()
                named = [i for i, t in enumerate(plain) if t and re.search(rf"\b(?:{pattern})\b", t, re.IGNORECASE)]
                other = pa.array([swapped(plain[i], groups) for i in named], pa.string())
                doc, at = blank.hits(other)
                change: list[list[int] | None] = [None] * len(text)
                for k, i in enumerate(named):
                    change[i] = at[np.searchsorted(doc, k, side="left") : np.searchsorted(doc, k, side="right")].tolist()
                yield pa.RecordBatch.from_arrays([label, pa.array(lists, pa.list_(pa.int32())), pa.array(change, pa.list_(pa.int32()))], names=["label", "at", "swapped"])

    learned = sample.orderBy("doc_id").select("text", "label").mapInArrow(lean(rows), "label int, at array<int>, swapped array<int>").toPandas()
    sample.unpersist()

    named = learned[learned["swapped"].notna()]
    swap = Rows.of(named["at"].tolist()), Rows.of(named["swapped"].tolist())
    weights, constant = fit_logistic(Rows.of(learned["at"].tolist()), learned["label"].to_numpy(float), swap, len(keys), fairness)
    return Model(keys, weights, constant)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id, text and any others) as doc_id, held_out, score and predicted (1 from CUT on), a row for each row.

    A text counts for the model's features that it has, however often; null and empty texts have none. Equal texts score
    alike; an empty table gives no rows. No row leaves its partition.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(task), f"doc_id {kind}, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` (text and any others) that score under CUT, with all their columns."""
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(model.score(part.column(at)) < CUT))

    return docs.mapInArrow(lean(task), docs.schema)
