"""Sorting, ends of frames, top rows and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.draws import sample_draws
from tidewater.operators.missing import num


def sort_keys(by: Sequence[str | Column], ascending: bool | Sequence[bool] = True) -> list[Column]:
    """Ascending keys have nulls last, descending ones first."""
    flags = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    return [(c := F.col(k) if isinstance(k, str) else k, c.asc_nulls_last() if up else c.desc_nulls_first())[1] for k, up in zip(by, flags)]


def sort(df: DataFrame, by: Sequence[str | Column], ascending: bool | Sequence[bool] = True, then: Sequence[str] = ()) -> DataFrame:
    """Rows in order; ties by `then`, which stands for the place of a row."""
    return df.orderBy(*sort_keys(by, ascending), *then)


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The last rows, in order."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order_by]).limit(n).orderBy(*order_by)


def nlargest(df: DataFrame, n: int, columns: Sequence[str], then: Sequence[str]) -> DataFrame:
    """Rows with the greatest numbers; rows without a number in a key are left out; ties by `then`."""
    return _extreme(df, n, columns, then, False)


def nsmallest(df: DataFrame, n: int, columns: Sequence[str], then: Sequence[str]) -> DataFrame:
    return _extreme(df, n, columns, then, True)


def _extreme(df: DataFrame, n: int, columns: Sequence[str], then: Sequence[str], up: bool) -> DataFrame:
    keys = {f"_k{i}": num(df, c) for i, c in enumerate(columns)}
    kept = df.withColumns(keys).filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return kept.orderBy(*[F.col(k).asc() if up else F.col(k).desc() for k in keys], *then).limit(n).drop(*keys)


def sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 0, weight: str | None = None) -> DataFrame:
    """Exactly `n` rows (or all) without replacement, by a seeded hash of the row's key; by weight w in order of -ln(u) / w."""
    chance = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    order = chance if weight is None else -F.ln(chance) / F.col(weight)
    kept = df if weight is None else df.filter(F.col(weight) > 0)
    return kept.withColumn("_order", order).orderBy("_order", *key).limit(n).drop("_order")


def page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int) -> tuple[DataFrame, int]:
    """A slice in order, and how many rows there are."""
    return df.orderBy(*order_by).offset(offset).limit(limit), df.count()


def sample_share(df: DataFrame, share: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """About that share of the rows, by a seeded hash of the row's key; a share above 1 repeats rows."""
    chance = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    times = F.floor(F.lit(float(share))) + (chance < share % 1).cast("int")
    return df.withColumn("_times", times).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_times", "_copy")


def sample_with_replacement(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """`n` draws with replacement from the rows in order of their hashes; `draws.sample_draws` takes another order, and weights."""
    return sample_draws(df, n, [], seed, number="_draw").drop("_draw")
