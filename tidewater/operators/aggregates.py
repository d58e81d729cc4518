"""Reducers, keyed and whole-frame aggregation, counts and quantiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.missing import is_numeric, num, present

Reducer = Callable[[DataFrame, str], Column]


def _range(df: DataFrame, c: str) -> Column:
    return F.max(num(df, c)) - F.min(num(df, c))


#: Reducers of a series: the sum of nothing is 0 and the product 1; count is of all rows; nunique counts null as a value.
REDUCERS: dict[str, Reducer] = {
    "sum": lambda df, c: F.coalesce(F.sum(num(df, c)), F.lit(0)),
    "mean": lambda df, c: F.avg(num(df, c)),
    "median": lambda df, c: F.median(num(df, c)),
    "min": lambda df, c: F.min(num(df, c)),
    "max": lambda df, c: F.max(num(df, c)),
    "range": _range,
    "product": lambda df, c: F.coalesce(F.product(num(df, c)), F.lit(1.0)),
    "var": lambda df, c: F.var_samp(num(df, c)),
    "std": lambda df, c: F.stddev_samp(num(df, c)),
    "count": lambda df, c: F.count(F.lit(1)),
    "nunique": lambda df, c: F.count_distinct(F.struct(present(df, c))),
}
#: Reducers of pivots and resampling: nothing summed is null, and count is of what is there.
CELL_REDUCERS: dict[str, Reducer] = {
    "sum": lambda df, c: F.sum(num(df, c)),
    "mean": lambda df, c: F.avg(num(df, c)),
    "avg": lambda df, c: F.avg(num(df, c)),
    "min": lambda df, c: F.min(num(df, c)),
    "max": lambda df, c: F.max(num(df, c)),
    "count": lambda df, c: F.count(present(df, c)),
}


def _named(df: DataFrame, spec: Mapping[str, str | Sequence[str] | Reducer]) -> list[Column]:
    out, used = [], set(df.columns)
    for column, functions in spec.items():
        for f in [functions] if isinstance(functions, str) or callable(functions) else functions:
            label = f if isinstance(f, str) else getattr(f, "__name__", "agg")
            name, n = f"{column}_{label}", 2
            while name in used:
                name, n = f"{column}_{label}_{n}", n + 1
            used.add(name)
            out.append((REDUCERS[f] if isinstance(f, str) else f)(df, column).alias(name))
    return out


def group_agg(df: DataFrame, keys: Sequence[str], spec: Mapping[str, str | Sequence[str] | Reducer]) -> DataFrame:
    """Keyed aggregation; outputs are named <column>_<function>. A null key is a group. Functions are names or (frame, column) -> Column."""
    return df.groupBy(*keys).agg(*_named(df, spec))


def agg(df: DataFrame, spec: Mapping[str, str | Sequence[str] | Reducer]) -> DataFrame:
    """Whole-frame aggregation in one row."""
    return df.agg(*_named(df, spec))


def agg_labels(df: DataFrame, columns: Sequence[str], functions: Sequence[str]) -> DataFrame:
    """Whole-frame aggregation with a row for each function: label and the columns."""
    row = df.agg(*[F.array(*[REDUCERS[f](df, c).cast("double") for f in functions]).alias(c) for c in columns])
    zipped = F.arrays_zip(F.array(*[F.lit(f) for f in functions]).alias("label"), *columns)
    return row.select(F.explode(zipped).alias("r")).select("r.label", *[F.col("r")[c].alias(c) for c in columns])


def mode(df: DataFrame, keys: Sequence[str], column: str, order_by: Sequence[str]) -> DataFrame:
    """The value whose running count is the first to reach the greatest count, in order of `order_by`; nulls count."""
    turn = F.row_number().over(Window.partitionBy(*keys, column).orderBy(*order_by))
    counted = df.withColumn("_turn", turn)
    first = F.min(F.struct((-F.col("_turn")).alias("t"), *order_by, F.col(column).alias("_value")))
    return counted.groupBy(*keys).agg(first.alias("_first")).select(*keys, F.col("_first._value").alias(f"{column}_mode"))


def quantile(df: DataFrame, keys: Sequence[str], column: str, q: float, interpolation: str = "linear") -> DataFrame:
    """Exact quantile of the numbers: linear, lower, higher, nearest (ties to the lower) or midpoint."""
    name = f"{column}_q"
    if interpolation == "linear":
        return df.groupBy(*keys).agg(F.percentile(num(df, column), q).alias(name))
    # Counted by value first, so that equal values of a group are one row of its window.
    counted = df.withColumn("_v", num(df, column)).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    ranked = counted.withColumn("_end", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", (F.sum("_c").over(w) - 1) * F.lit(q))
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda place: (place < F.col("_end")) & (place >= F.col("_end") - F.col("_c"))
    if interpolation == "midpoint":
        return ranked.groupBy(*keys).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name))
    place = {"lower": low, "higher": high, "nearest": F.when(F.col("_at") - low <= 0.5, low).otherwise(high)}[interpolation]
    return ranked.filter(holds(place)).groupBy(*keys).agg(F.max("_v").alias(name))


def describe(df: DataFrame, columns: Sequence[str] | None = None, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """stat and, for each numeric column, count, mean, std, min, percentiles and max of its numbers."""
    columns = list(columns or [c for c in df.columns if is_numeric(df, c)])
    stats = ["count", "mean", "std", "min", *[f"{p * 100:g}%" for p in percentiles], "max"]

    def of(c: str) -> Column:
        x = num(df, c)
        every = [F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), *[F.percentile(x, p) for p in percentiles], F.max(x)]
        return F.array(*[e.cast("double") for e in every]).alias(c)

    zipped = F.arrays_zip(F.array(*[F.lit(s) for s in stats]).alias("stat"), *columns)
    return df.agg(*[of(c) for c in columns]).select(F.explode(zipped).alias("r")).select("r.stat", *[F.col("r")[c].alias(c) for c in columns])


def nunique(df: DataFrame, columns: Sequence[str], dropna: bool = True) -> DataFrame:
    """Number of distinct values of each column."""
    return df.agg(*[(F.count_distinct(present(df, c)) if dropna else F.count_distinct(F.struct(present(df, c)))).alias(c) for c in columns])


def nunique_rows(df: DataFrame, columns: Sequence[str], dropna: bool = True, out: str = "nunique") -> DataFrame:
    """Number of distinct values along each row, compared as text."""
    values = F.array(*[present(df, c).cast("string") for c in columns])
    return df.withColumn(out, F.size(F.array_distinct(F.array_compact(values) if dropna else values)))


def value_counts(df: DataFrame, columns: Sequence[str], normalize: bool = False, dropna: bool = True) -> DataFrame:
    """count of each combination of values; a share of all if `normalize`."""
    if dropna:
        df = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counted
    whole = df.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return counted.crossJoin(F.broadcast(whole)).withColumn("count", F.col("count") / F.col("_all")).drop("_all")


def extreme_label(df: DataFrame, keys: Sequence[str], label: str, column: str, order_by: Sequence[str], largest: bool = True) -> DataFrame:
    """The label of the first greatest (or least) number of each group."""
    x = num(df, column)
    best = F.min_by(F.col(label), F.struct((-x if largest else x).alias("x"), *order_by))
    return df.filter(x.isNotNull()).groupBy(*keys).agg(best.alias(f"{column}_{'idxmax' if largest else 'idxmin'}"))


def group_apply(df: DataFrame, keys: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """Each group as a pandas frame through a function; the groups must fit into a task."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def group_records(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Each group's rows as an array of structs, in order. Only for groups of bounded size."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    rows = F.sort_array(F.collect_list(F.struct(*order_by, *rest)))
    return df.groupBy(*keys).agg(rows.alias("records"))
