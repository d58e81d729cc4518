"""Joins of frames: null keys match null keys, names that clash get suffixes, cardinality can be checked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def check_cardinality(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], validate: str) -> None:
    """Raises unless the keys are exactly of the kind named, such as one_to_many."""
    many = [not df.groupBy(*on).count().filter("count > 1").limit(1).isEmpty() for df, on in ((left, left_on), (right, right_on))]
    found = f"{'many' if many[0] else 'one'}_to_{'many' if many[1] else 'one'}"
    if found != validate:
        raise ValueError(f"keys are {found}, not {validate}")


def _keyed(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str) -> tuple[DataFrame, dict[str, str]]:
    """The join, with the right side's columns under unique names."""
    names = {c: f"__right_{c}" for c in right.columns}
    condition = reduce(lambda a, b: a & b, [left[a].eqNullSafe(F.col(names[b])) for a, b in zip(left_on, right_on)])
    return left.join(right.withColumnsRenamed(names), condition, HOW[how]), names


def merge(
    left: DataFrame, right: DataFrame, how: str = "inner", on: Sequence[str] | None = None, left_on: Sequence[str] | None = None,
    right_on: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y"), validate: str | None = None,
) -> DataFrame:
    """Relational merge. Output: keys (left value, else right), left columns, right columns; clashing names get `suffixes`.

    Keys of different names keep the left name, and the right key stays as a column too. `how` may be cross, without keys.
    """
    if how == "cross":
        clash = set(left.columns) & set(right.columns)
        return left.withColumnsRenamed({c: c + suffixes[0] for c in clash}).crossJoin(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}))
    left_on, right_on = list(left_on or on or ()), list(right_on or on or ())
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("a merge needs as many left as right keys")
    if validate:
        check_cardinality(left, right, left_on, right_on, validate)
    both, names = _keyed(left, right, left_on, right_on, how)
    shared = {r for a, r in zip(left_on, right_on) if a == r}
    clash = (set(left.columns) - set(left_on)) & (set(right.columns) - shared)
    out = [F.coalesce(left[a], F.col(names[b])).alias(a) for a, b in zip(left_on, right_on)]
    out += [left[c].alias(c + suffixes[0] if c in clash else c) for c in left.columns if c not in left_on]
    out += [F.col(names[c]).alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in shared]
    result = both.select(*out)
    if len(set(result.columns)) < len(result.columns):
        raise ValueError(f"output names are not unique: {result.columns}")
    return result


def join(
    left: DataFrame, right: DataFrame, how: str = "left", on: Sequence[str] | None = None, left_on: Sequence[str] | None = None,
    right_on: Sequence[str] | None = None, lsuffix: str = "_left", rsuffix: str = "_right", validate: str | None = None,
) -> DataFrame:
    """As `merge`, left by default; keys of different names both stay as they are. Equal suffixes are an error if names clash."""
    left_on, right_on = list(left_on or on or ()), list(right_on or on or ())
    if left_on == right_on:
        if lsuffix == rsuffix and set(left.columns) & set(right.columns) - set(left_on):
            raise ValueError("suffixes must differ where names clash")
        return merge(left, right, how, on=left_on, suffixes=(lsuffix, rsuffix), validate=validate)
    if validate:
        check_cardinality(left, right, left_on, right_on, validate)
    both, names = _keyed(left, right, left_on, right_on, how)
    clash = set(left.columns) & set(right.columns)
    return both.select(
        *[left[c].alias(c + lsuffix if c in clash else c) for c in left.columns], *[F.col(names[c]).alias(c + rsuffix if c in clash else c) for c in right.columns]
    )


def align(left: DataFrame, right: DataFrame, label: str, value: str, order_by: Sequence[str], how: str = "left", fill: Any = None) -> DataFrame:
    """Two labelled series over one list of labels: label, occurrence, left_value, right_value.

    The list is that of the left or right side; inner: left labels that the right side has; outer: the left list and
    the surplus of the right one by occurrence. A repeated label takes a side's rows in turn, round and round.
    """

    def counted(df: DataFrame, out: str) -> DataFrame:
        w = Window.partitionBy(label)
        return df.select(
            F.col(label).alias("label"), F.col(value).alias(out), (F.row_number().over(w.orderBy(*order_by)) - 1).alias("occurrence"), F.count(F.lit(1)).over(w).alias(f"_n_{out}")
        )

    a, b = counted(left, "left_value"), counted(right, "right_value")
    la, lb = a.select("label", "occurrence"), b.select("label", "occurrence")
    if how == "outer":
        labels = la.union(lb).distinct()
    elif how == "inner":
        labels = la.join(lb.select(F.col("label").alias("_l")).distinct(), F.col("label").eqNullSafe(F.col("_l")), "left_semi")
    else:
        labels = la if how == "left" else lb
    for side, out in ((a, "left_value"), (b, "right_value")):
        side = side.withColumnsRenamed({"label": "_l", "occurrence": "_o"})
        turn = F.col("occurrence") % F.col(f"_n_{out}") == F.col("_o")
        sizes = side.groupBy("_l").agg(F.first(f"_n_{out}").alias(f"_n_{out}"))
        labels = labels.join(sizes, F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l")
        labels = labels.join(side.drop(f"_n_{out}"), F.col("label").eqNullSafe(F.col("_l")) & turn, "left").drop("_l", "_o", f"_n_{out}")
        if fill is not None:
            labels = labels.withColumn(out, F.coalesce(out, F.lit(fill)))
    return labels


def map_values(c: Column, mapping: Mapping[Any, Any] | None = None, default: Any = None, keep_missing: bool = False) -> Column:
    """Looks each value up in a small constant mapping."""
    pairs = [F.lit(x) for item in (mapping or {}).items() for x in item]
    found = F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default)) if pairs else F.lit(default)
    return F.when(c.isNull(), c if keep_missing else F.lit(default)).otherwise(found)


def map_table(df: DataFrame, column: str, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Looks values up in another frame, in which each key stands once; null where it has none."""
    looked = table.select(F.col(key).alias("_k"), F.col(value).alias(out))
    return df.join(looked, F.col(column).eqNullSafe(F.col("_k")), "left").drop("_k")


def combine(frames: Sequence[DataFrame], position: str) -> DataFrame:
    """Frames side by side, row by row of a shared position column."""
    return reduce(lambda a, b: a.join(b, position, "full"), frames)
