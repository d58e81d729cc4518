"""Set operations and duplicates; null equals null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of both, by name; columns of one side are null for the other."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.distinct() if distinct else both


def concat(frames: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """Frames of the same columns, in the order of the first."""
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("frames differ in their columns")
    both = reduce(lambda a, b: a.unionByName(b), frames)
    return both.distinct() if distinct else both


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    keys = right.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    return left.join(keys, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]), how)


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows, repeated ones too, whose key the right side does not have."""
    return _matched(left, right, on, "left_anti")


def intersect(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Right rows, repeated ones too, whose key the left side has."""
    return _matched(right, left, on, "left_semi")


def drop_duplicates(df: DataFrame, subset: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each key. By aggregation, so copies are put together before they are shuffled."""
    rest = [c for c in df.columns if c not in subset]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)) if rest else None
    if first is None:
        return df.select(*subset).distinct()
    return df.groupBy(*subset).agg(first.alias("_r")).select(*[F.col("_r")[c].alias(c) if c in rest else F.col(c) for c in df.columns])


def duplicated(df: DataFrame, subset: Sequence[str], order_by: Sequence[str], keep: str | None = "first", out: str = "duplicated") -> DataFrame:
    """Marks rows whose key is repeated: all but the first, all but the last, or all of them (None)."""
    w = Window.partitionBy(*subset)
    marks: Column = F.count(F.lit(1)).over(w) > 1
    if keep:
        marks = F.row_number().over(w.orderBy(*[F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order_by])) > 1
    return df.withColumn(out, marks)


def unique(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Distinct values with the place at which each is first seen."""
    return df.groupBy(column).agg(F.min(order_by).alias("first_seen"))


def surrogate_key(columns: Sequence[str], delimiter: str = "|") -> Column:
    """SHA-256 of the columns joined by the delimiter; null if any is."""
    parts = [x for c in columns for x in (F.lit(delimiter), F.col(c).cast("string"))][1:]
    return F.sha2(F.concat(*parts), 256)
