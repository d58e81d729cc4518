"""Nested values: structs, maps and JSON texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_at(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where there is none."""
    return F.get_json_object(json, "$." + path)


def select_keys(m: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def remove_keys(m: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(m, lambda k, _: F.coalesce(F.element_at(known, k), k))


def flatten(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """The leaves of a nested struct as columns named by their paths, beside the other columns."""
    found: list[Column] = []

    def walk(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c.getField(f.name), f.dataType, f"{name}{sep}{f.name}" if name else f.name)
        else:
            found.append(c.alias(name))

    walk(F.col(column), df.schema[column].dataType, "")
    return df.select(*[c for c in df.columns if c != column], *found)


def canonical(m: Column) -> Column:
    """A text that maps of equal entries share, in whatever order they are."""
    return F.to_json(F.array_sort(F.map_entries(m)))
