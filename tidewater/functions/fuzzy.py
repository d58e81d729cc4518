"""Likeness of short texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams; a text under n characters has none."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """Share of common n-grams; 0 where neither has any."""
    return F.coalesce(_jaccard(ngrams(a, n), ngrams(b, n)), F.lit(0.0))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def token_jaccard(a: Column, b: Column, normalize: bool = False) -> Column:
    """Share of common words between white space, case and marks counting; 0 where neither has any.

    `normalize`: in lower case, hyphens as spaces, other marks and underscores left out.
    """

    def words(c: Column) -> Column:
        if normalize:
            c = F.regexp_replace(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), r"[^A-Za-z0-9\s]", "")
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    return F.coalesce(_jaccard(words(a), words(b)), F.lit(0.0))


def token_similarity(a: Column, b: Column) -> Column:
    """Share of common pieces between white space, an empty piece at an end counting as one; 0 where a text is empty or null."""
    pieces = lambda c: F.split(c, r"\s+")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(a) | empty(b), 0.0).otherwise(_jaccard(pieces(a), pieces(b)))


def levenshtein_likeness(a: Column, b: Column) -> Column:
    """1 - distance / longer length."""
    return 1 - F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; infinity for unequal lengths."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("double"))
    places = F.when(F.length(a) == 0, 0.0).otherwise(F.aggregate(differ, F.lit(0.0), lambda s, x: s + x))
    return F.when(F.length(a) == F.length(b), places).when(F.length(a) != F.length(b), F.lit(float("inf")))


def weighted_similarity(a: Column, b: Column, levenshtein: float = 0.5, jaccard_: float = 0.5) -> Column:
    """Weighted sum of edit and 2-gram likeness; 1 for two empty texts, 0 if one is empty."""
    both = levenshtein * levenshtein_likeness(a, b) + jaccard_ * jaccard(a, b)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(both)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of likenesses."""
    whole = sum(w for _, w in parts)
    out = F.lit(0.0)
    for c, w in parts:
        out = out + c * F.lit(w / whole)
    return out


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a text, and lengths."""
    lengths = np.array([len(t) for t in texts])
    width = max(1, int(lengths.max()))
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width), lengths


def swap_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances with swaps of neighbours, each place edited once: the same row of all pairs' tables in one step."""
    (x, rows), (y, columns) = _points(a), _points(b)
    steps = np.arange(y.shape[1] + 1, dtype=np.int32)
    older = old = np.tile(steps, (len(a), 1))
    out = np.where(rows == 0, columns, 0).astype(np.int32)
    for i in range(1, int(rows.max()) + 1):
        p = x[:, i - 1 : i]
        row = np.empty_like(old)
        row[:, 0] = i
        np.minimum(old[:, 1:] + 1, old[:, :-1] + (y != p), out=row[:, 1:])
        if i > 1:
            swap = (y[:, :-1] == p) & (y[:, 1:] == x[:, i - 2 : i - 1])
            row[:, 2:] = np.where(swap, np.minimum(row[:, 2:], older[:, :-2] + 1), row[:, 2:])
        row = np.minimum.accumulate(row - steps, axis=1) + steps  # insertions
        ended = rows == i
        out[ended] = row[ended, columns[ended]]
        older, old = old, row
    return out


@F.pandas_udf(IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance with swaps of neighbours, each place edited once; null if a text is. Pairs of like lengths go together, some 2^20 cells a step."""
    x, y = a.to_list(), b.to_list()
    order = sorted((i for i in range(len(x)) if x[i] is not None and y[i] is not None), key=lambda i: (len(y[i]), len(x[i])))
    out: list[int | None] = [None] * len(x)
    while order:
        many = max(1, (1 << 20) // (len(y[order[-1]]) + 1))
        part, order = order[-many:], order[:-many]
        for i, d in zip(part, swap_distances([x[i] for i in part], [y[i] for i in part]).tolist()):
            out[i] = d
    return pd.Series(out, dtype="Int32")


def soundex(c: Column) -> Column:
    """First character and the digits of three consonants; equal digits in a row count once, anything without a digit between them parts them.

    An empty or null text gives 0000.
    """
    upper = F.upper(F.coalesce(c, F.lit("")))
    coded = F.translate(F.regexp_replace(upper, "[^BFPVCGJKQSXZDTLMNR]", "0"), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    once = F.regexp_replace(coded, r"([0-9])\1+", "$1")
    return F.when(upper == "", "0000").otherwise(F.rpad(F.concat(F.substring(upper, 1, 1), F.replace(F.substring(once, 2, 1 << 30), F.lit("0"), F.lit(""))), 4, "0"))


def fuzzy_search(queries: DataFrame, query: str, collection: DataFrame, text: str, least: float = 0.7, n: int = 2) -> DataFrame:
    """Pairs of a query and a text of the collection whose n-grams are alike by Jaccard similarity of at least `least`.

    Pairs are found by a common n-gram among the rarest that a pair must share (prefix filter), never by all pairs.
    """
    def grams(df: DataFrame, name: str) -> DataFrame:
        return df.select(name).distinct().withColumn("_g", ngrams(F.lower(name), n)).filter(F.size("_g") > 0)

    a, b = grams(queries.withColumnRenamed(query, "_q"), "_q"), grams(collection.withColumnRenamed(text, "_x"), "_x")
    often = b.select(F.explode("_g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        listed = df.select(name, F.size("_g").alias("_n"), F.explode("_g").alias("g")).join(often, "g", "left").groupBy(name, "_n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g"))).alias("_o"))
        kept = F.slice("_o", F.lit(1), (F.col("_n") - F.ceil(F.col("_n") * least) + 1).cast("int"))
        return listed.select(name, F.explode(kept).alias("o")).select(name, F.col("o.g").alias("g"))

    pairs = prefix(a, "_q").join(prefix(b, "_x"), "g").select("_q", "_x").distinct()
    scored = pairs.select("_q", "_x", jaccard(F.lower("_q"), F.lower("_x"), n).alias("score"))
    return scored.filter(F.col("score") >= least).select(F.col("_q").alias("query"), F.col("_x").alias("text"), "score")
