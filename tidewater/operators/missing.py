"""Missing values, numeric coercion and two-valued logic: the rules that the other operators share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), (T.FloatType, T.DoubleType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), T.NumericType)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(name)
    return (c.isNull() | F.isnan(c)) if is_floating(df, name) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, or null where it is missing."""
    return F.nanvl(F.col(name), F.lit(None)) if is_floating(df, name) else F.col(name)


def num(df: DataFrame, name: str) -> Column:
    """The value as a number: NaN is null, true and false count 1 and 0, texts count if they are wholly numeric, other kinds are null."""
    t, c = kind(df, name), F.col(name)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(t, T.NumericType):
        return c
    if isinstance(t, T.BooleanType):
        return c.cast("int")
    if isinstance(t, T.StringType):
        return F.when(c.rlike(NUMERIC), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def truth(c: Column) -> Column:
    """A condition in two-valued logic: null counts as false."""
    return F.coalesce(c, F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def drop_nulls(df: DataFrame, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with enough values: all of the columns (any), one (all), or `thresh` of them. NaN is missing."""
    names = list(subset or df.columns)
    least = thresh if thresh is not None else len(names) if how == "any" else 1
    return df.filter(sum(((~is_missing(df, n)).cast("int") for n in names), F.lit(0)) >= least)


def drop_null_columns(df: DataFrame, how: str = "any", thresh: int | None = None) -> DataFrame:
    """Columns with enough values, counted over all rows at once; only the counts come to the driver."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~is_missing(df, n)).alias(n) for n in df.columns]).first()
    least = thresh if thresh is not None else row["_n"] if how == "any" else 1
    return df.select(*[n for n in df.columns if row[n] >= least])


def fill_nulls(df: DataFrame, values: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells filled by one value, or by one for each column of a mapping."""
    given = values if isinstance(values, Mapping) else {n: values for n in columns or df.columns}
    return df.withColumns({n: F.when(is_missing(df, n), F.lit(v)).otherwise(F.col(n)) for n, v in given.items()})


def replace(df: DataFrame, mapping: Mapping[Any, Any] | Sequence[Any], value: Any = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells equal to a key of `mapping` (or to one of a list) become its value (or `value`); a key None stands for missing ones."""
    pairs = mapping if isinstance(mapping, Mapping) else {k: value for k in mapping}

    def put(n: str) -> Column:
        out: Any = F
        for old, new in pairs.items():
            out = out.when(is_missing(df, n) if old is None else truth(F.col(n) == F.lit(old)), F.lit(new))
        return out.otherwise(F.col(n))

    return df.withColumns({n: put(n) for n in columns or df.columns})


def clip(df: DataFrame, name: str, low: float, high: float) -> Column:
    """The number within bounds; what is no number becomes the lower one."""
    return F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), num(df, name))), F.lit(low))
