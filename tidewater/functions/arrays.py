"""Functions of array columns, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _known(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def total(c: Column) -> Column:
    return F.aggregate(_known(c), F.lit(0.0), lambda s, x: s + x)


def product(c: Column) -> Column:
    return F.aggregate(_known(c), F.lit(1.0), lambda s, x: s * x)


def mean(c: Column) -> Column:
    return F.try_divide(total(c), F.size(_known(c)))


def median(c: Column) -> Column:
    s, n = F.sort_array(_known(c)), F.size(_known(c))
    at = lambda i: F.get(s, i.cast("int")).cast("double")
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def variance(c: Column) -> Column:
    """Sample variance; null below two numbers."""
    m = mean(c)
    squares = F.aggregate(F.transform(F.arrays_zip(_known(c).alias("x"), F.array_repeat(m, F.size(_known(c))).alias("m")), lambda z: (z["x"] - z["m"]) * (z["x"] - z["m"])), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(_known(c)) > 1, squares / (F.size(_known(c)) - 1))


def spread(c: Column) -> Column:
    return F.array_max(c) - F.array_min(c)


def cumulative(c: Column) -> Column:
    """Running sums of the numbers, one step an element."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["sum"] + F.coalesce(x.cast("double"), F.lit(0.0))
        return F.struct(now.alias("sum"), F.array_append(acc["out"], now).alias("out"))

    return F.aggregate(c, start, step, lambda acc: acc["out"])


def chunks(c: Column, size: int) -> Column:
    """Consecutive parts of `size` elements; an empty array has none."""
    n = F.ceil(F.size(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(c, i * size + 1, F.lit(size)))).otherwise(F.array())


def common(a: Column, b: Column) -> Column:
    """Elements of b, repeated ones too, that a has."""
    return F.filter(b, lambda x: F.array_contains(a, x))


def missing(a: Column, b: Column) -> Column:
    """Elements of a, repeated ones too, that b lacks."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def clip(c: Column, low: float, high: float) -> Column:
    return F.transform(c, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def value_counts(c: Column) -> Column:
    """map<element, count> of the elements that are not null."""
    distinct = F.array_distinct(_known(c))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda x: F.size(F.filter(c, lambda y: y == x))))


def rank(c: Column) -> Column:
    """Dense rank of each element among the distinct ones."""
    order = F.array_sort(F.array_distinct(_known(c)))
    return F.transform(c, lambda x: F.array_position(order, x).cast("int"))


def rolling(c: Column, size: int) -> Column:
    """Mean of the last `size` elements; null for the first ones."""
    return F.transform(c, lambda x, i: F.when(i + 1 >= size, total(F.slice(c, i - size + 2, F.lit(size))) / size))


def standardize(c: Column, size: Column, fill: Column) -> Column:
    """Exactly `size` elements: cut off, or filled up."""
    return F.slice(F.concat(c, F.array_repeat(fill, size)), F.lit(1), size)
