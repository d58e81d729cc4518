"""Projections, masks and conditions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.missing import is_missing, truth


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in the order asked; unknown names are left out."""
    return df.select(*[n for n in names if n in df.columns])


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def assign(df: DataFrame, **values: Any) -> DataFrame:
    """Adds or replaces columns at once; values are columns, constants, or functions of the frame as it was."""
    made = {n: v(df) if callable(v) and not isinstance(v, Column) else v for n, v in values.items()}
    return df.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in made.items()})


def select_expr(df: DataFrame, outputs: Mapping[str, str | Callable[[DataFrame], Column]], strict: bool = True) -> DataFrame:
    """Named outputs: an existing column, or a function of the frame that builds a column. Unknown names are an error, or null if not strict."""
    made = []
    for name, what in outputs.items():
        if callable(what):
            made.append(what(df).alias(name))
        elif what in df.columns:
            made.append(F.col(what).alias(name))
        elif strict:
            raise ValueError(f"unknown column {what!r}")
        else:
            made.append(F.lit(None).alias(name))
    return df.select(*made)


CASTS = {"integer": "bigint", "float": "double", "number": "double", "boolean": "boolean", "string": "string", "date": "timestamp"}


def as_type(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Casts columns; what cannot be cast is null. Integers cut off decimals; texts are true unless empty or 'false'."""

    def cast(name: str, to: str) -> Column:
        c, known = F.col(name), dict(df.dtypes)[name]
        if to == "integer":
            return c.try_cast("double").try_cast("bigint") if known == "string" else c.try_cast("bigint")
        if to == "boolean" and known == "string":
            return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False).otherwise(c != "")
        if to == "date" and known == "string":
            return F.try_to_timestamp(c)
        return c.try_cast(CASTS.get(to, to))

    return df.withColumns({n: cast(n, t) for n, t in kinds.items()})


def where(df: DataFrame, condition: Column, other: Any = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Keeps cells of rows for which the condition holds, else puts `other`."""
    return df.withColumns({n: F.when(truth(condition), F.col(n)).otherwise(F.lit(other)) for n in columns or df.columns})


def mask(df: DataFrame, condition: Column, other: Any = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Puts `other` into cells of rows for which the condition holds."""
    return where(df, ~truth(condition), other, columns)


def null_mask(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each column as whether it is missing; columns of `keep` as they are."""
    return df.select(*keep, *[is_missing(df, n).alias(n) for n in df.columns if n not in keep])


def compare(a: Column, op: str, b: Column) -> Column:
    """Two-valued comparison: null equals null, and counts as 0 for < <= > >=."""
    if op in ("=", "!="):
        return a.eqNullSafe(b) if op == "=" else ~a.eqNullSafe(b)
    x, y = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def between(c: Column, low: Any, high: Any, inclusive: bool = True) -> Column:
    return truth(c.between(low, high) if inclusive else (c > low) & (c < high))


def is_in(c: Column, values: Sequence[Any]) -> Column:
    """Membership under which null is in a list that holds null."""
    plain = [v for v in values if v is not None]
    found = truth(c.isin(*plain)) if plain else F.lit(False)
    return found | c.isNull() if len(plain) < len(values) else found


def case_when(branches: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """The value of the first condition that holds."""
    out: Any = F
    for condition, value in branches:
        out = out.when(truth(condition), value)
    return out.otherwise(default)


def at(df: DataFrame, positions: Sequence[int], order_by: Sequence[str]) -> DataFrame:
    """Rows at the given places (from 0) in order of `order_by`, repeated ones repeated; `pos` numbers the result.

    Counting places needs a total order, which one task has to number: only for frames that were cut down before.
    """
    numbered = df.withColumn("_at", F.row_number().over(Window.orderBy(*order_by)) - 1)
    asked = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(positions)], "pos long, _at int")
    return numbered.join(F.broadcast(asked), "_at").drop("_at")


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def reindex(
    df: DataFrame, key: str, labels: DataFrame, fill: Any = None, allow_missing: bool = True, order_by: Sequence[str] = (), label_order: Sequence[str] = (), columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row for each row of `labels`, by the column `key`: key and `columns` (all others of `df`, if not given).

    A label that stands several times takes the rows of that key in turn, in order of `order_by` (else of all columns),
    round and round; its own occurrences are ordered by `label_order`, if given. Labels without a row and columns that
    `df` lacks get `fill`, or are an error. Keys are equal if both are null.
    """
    columns = list(columns) if columns is not None else [c for c in df.columns if c != key]
    unknown = [c for c in columns if c not in df.columns]
    if unknown and not allow_missing:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    same = Window.partitionBy(key)
    rows = df.select(F.col(key).alias("_key"), F.struct("*").alias("_row"), (F.row_number().over(same.orderBy(*(order_by or df.columns))) - 1).alias("_i"))
    sizes = df.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    turns = labels.select(F.col(key).alias("_label"), (F.row_number().over(same.orderBy(*(label_order or [key]))) - 1).alias("_turn"))
    turns = turns.join(sizes, F.col("_label").eqNullSafe(F.col("_of")), "left").withColumn("_turn", F.coalesce(F.col("_turn") % F.col("_n"), F.lit(0)))
    both = turns.join(rows, F.col("_label").eqNullSafe(F.col("_key")) & (F.col("_turn") == F.col("_i")), "left")
    lost = F.col("_n").isNull()
    if not allow_missing:
        both = both.withColumn("_label", F.when(lost, F.raise_error(F.lit("label without a row"))).otherwise(F.col("_label")))

    def value(c: str) -> Column:
        if c in unknown:
            return F.lit(fill).alias(c)
        found = F.col("_row").getField(c)
        return (F.when(lost, F.lit(fill)).otherwise(found) if fill is not None else found).alias(c)

    return both.select(F.col("_label").alias(key), *[value(c) for c in columns])
