"""Reshaping: long and wide forms, exploded lists, pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.strings import snake_name
from tidewater.operators.missing import num, present


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long; a row for each row and value column."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def explode(df: DataFrame, column: str, preserve_empty: bool = True, empty_value: Any = None) -> DataFrame:
    """A row for each element of a list; null lists stay as one null; empty ones as `empty_value`, or go."""
    c = F.col(column)
    kind = df.schema[column].dataType
    one = lambda v: F.array(F.lit(v).cast(kind.elementType))
    lists = F.when(c.isNull(), one(None)).otherwise(c)
    if preserve_empty:
        lists = F.when(F.size(c) == 0, one(empty_value)).otherwise(lists)
    return df.withColumn(column, F.explode(lists))


def stack(df: DataFrame, index: Sequence[str], columns: Sequence[str], name: str = "column", value: str = "value", drop_nulls: bool = True) -> DataFrame:
    long = melt(df, index, columns, name, value)
    return long.filter(F.col(value).isNotNull()) if drop_nulls else long


def _values(df: DataFrame, column: str, order_by: Sequence[str] | None, most: int = 10_000) -> list[Any]:
    """Distinct values of a pivot column by first appearance (or in order); they become columns, so there are few."""
    seen = df.groupBy(column).agg((F.min(F.struct(*order_by)) if order_by else F.lit(0)).alias("_first"))
    found = [r[0] for r in seen.orderBy("_first", column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values would become columns")
    return found


def unstack(df: DataFrame, index: Sequence[str], columns: str, value: str, op: str, order_by: Sequence[str], values: Sequence[Any] | None = None, fill: Any = None) -> DataFrame:
    """Long to wide, a column for each value of `columns`; null results become `fill`."""
    values = list(values) if values is not None else _values(df, columns, order_by)
    cells = [_when(columns, v, df, value, op, order_by) for v in values]
    return df.groupBy(*index).agg(*[(F.coalesce(c, F.lit(fill)) if fill is not None else c).alias(str(v)) for c, v in zip(cells, values)])


def _when(pivot: str, v: Any, df: DataFrame, column: str, op: str, order_by: Sequence[str]) -> Column:
    """A reducer over the rows that have one pivot value: partial aggregation in one pass, without a second shuffle."""
    here = F.col(pivot).eqNullSafe(F.lit(v))
    if op in ("first", "last"):
        pick = F.min_by if op == "first" else F.max_by
        return pick(F.when(here, F.struct(column)), F.when(here, F.struct(*order_by)))[column]
    return CELLS[op](F.when(here, num(df, column) if op != "count" else present(df, column)))


CELLS = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def pivot(df: DataFrame, index: str, pivot_column: str, spec: Mapping[str, str], order_by: Sequence[str], values: Sequence[Any] | None = None) -> DataFrame:
    """A column <pivot value>_<column> for each value and column; ops as in unstack, first by default."""
    values = list(values) if values is not None else _values(df, pivot_column, order_by)
    return df.groupBy(index).agg(*[_when(pivot_column, v, df, c, op or "first", order_by).alias(f"{v}_{c}") for v in values for c, op in spec.items()])


PREFIX = {"string": "string", "boolean": "boolean", "timestamp": "date", "date": "date"}


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, values: Sequence[str], op: str, order_by: Sequence[str] = (), fill: Any = None, names: Sequence[Any] | None = None) -> DataFrame:
    """Aggregated cells with columns named <kind>_<value>_<column>; `fill` stands in cells without rows only."""
    if op in ("sum", "mean", "avg") and any(dict(df.dtypes)[v] == "string" for v in values):
        raise TypeError("sums and means need numbers")
    names = list(names) if names is not None else _values(df, columns, order_by or None)
    prefix = PREFIX.get(dict(df.dtypes)[columns], "number")
    out = []
    for n in names:
        there = F.max(F.col(columns).eqNullSafe(F.lit(n)))
        for v in values:
            cell = _when(columns, n, df, v, op, order_by)
            cell = F.when(there, cell).otherwise(F.lit(fill)) if fill is not None else F.when(there, cell)
            out.append(cell.alias(snake_name(f"{prefix}_{n}_{v}")))
    return df.groupBy(*index).agg(*out)


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Rows become columns; for few rows only."""
    return df.transpose(index)
