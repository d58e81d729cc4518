"""Window and sequential functions. All take an explicit order; nulls sort last in either direction unless asked."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.operators import scans
from tidewater.operators.missing import num

Order = Sequence[str | tuple[str, bool] | tuple[str, bool, str]]


def ordering(order_by: Order) -> list[Column]:
    """Sort keys of names, (name, ascending) or (name, ascending, "first" or "last")."""
    out = []
    for key in order_by:
        name, ascending, nulls = (*((key,) if isinstance(key, str) else key), True, "last")[:3] if isinstance(key, str) or len(key) == 1 else (*key, "last")[:3]
        c = F.col(name)
        out.append((c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last()) if ascending else (c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()))
    return out


def window(partition_by: Sequence[str], order_by: Order) -> WindowSpec:
    """A window by partition and order. Without a partition one task orders all rows: only for small frames."""
    if not order_by:
        raise ValueError("a window needs an order")
    return Window.partitionBy(*(partition_by or [F.lit(0)])).orderBy(*ordering(order_by))


def shift(c: Column, w: WindowSpec, periods: int = 1, fill: Any = None) -> Column:
    """The value `periods` rows before (after, if negative); `fill` beyond the ends."""
    return F.lag(c, periods, fill).over(w) if periods >= 0 else F.lead(c, -periods, fill).over(w)


def diff(c: Column, w: WindowSpec, periods: int = 1) -> Column:
    return c - shift(c, w, periods)


def pct_change(c: Column, w: WindowSpec, periods: int = 1, zero: str = "null") -> Column:
    """Relative change; over zero it is null, an infinity by sign ("inf"), or an error ("error")."""
    before = shift(c, w, periods)
    change = c - before
    if zero == "error":
        return change / before
    ratio = F.try_divide(change, before)
    return F.when((before == 0) & (change != 0), F.signum(change) * F.lit(float("inf"))).otherwise(ratio) if zero == "inf" else ratio


RUNNING = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def running(c: Column, w: WindowSpec, op: str) -> Column:
    """Cumulative value without nulls; null until the first value (count: 0)."""
    return RUNNING[op](c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def rolling(c: Column, w: WindowSpec, size: int, op: str = "mean") -> Column:
    """Value of the last `size` rows; null for the first ones. The sum of no numbers is 0."""
    value = RUNNING[op](c).over(w.rowsBetween(1 - size, Window.currentRow))
    return F.when(F.row_number().over(w) >= size, F.coalesce(value, F.lit(0)) if op == "sum" else value)


def expanding(c: Column, w: WindowSpec, op: str = "mean", min_periods: int = 1) -> Column:
    """Cumulative value from `min_periods` values on."""
    return F.when(running(c, w, "count") >= min_periods, running(c, w, op))


def rank(w_ties: WindowSpec, w_value: WindowSpec | None = None, method: str = "dense") -> Column:
    """Dense rank, or the average rank of ties ("standard"); for the latter `w_value` is partitioned by the value as well."""
    if method == "dense":
        return F.dense_rank().over(w_ties)
    return F.rank().over(w_ties) + (F.count(F.lit(1)).over(w_value) - 1) / 2


def cumulative(df: DataFrame, column: str, partition_by: Sequence[str], order_by: Order, op: str, out: str, drop_invalid: bool = False) -> DataFrame:
    """sum, min, max or product of the numbers so far, carried over rows without a number (or those dropped).

    The product multiplies the numbers of the rows before in their order, exactly as a loop would.
    """
    w, x = window(partition_by, order_by), num(df, column)
    if drop_invalid:
        df = df.filter(x.isNotNull())
    if op != "product":
        return df.withColumn(out, running(x, w, op))
    return df.withColumn(out, F.product(x.cast("double")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def interpolate(df: DataFrame, column: str, partition_by: Sequence[str], order_by: Order, method: str = "linear", limit: int | None = None, out: str | None = None) -> DataFrame:
    """Fills gaps by place: ffill (pad), bfill, linear or nearest between known values; `limit` counts from the gap's start (bfill: its end)."""
    w = window(partition_by, order_by)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = F.col("_x")
    at = F.when(x.isNotNull(), F.col("_i"))
    df = df.withColumn("_x", num(df, column)).withColumn("_i", F.row_number().over(w))
    df = df.withColumns({
        "_p": F.last("_x", ignorenulls=True).over(back), "_n": F.first("_x", ignorenulls=True).over(ahead),
        "_pi": F.max(at).over(back), "_ni": F.min(at).over(ahead),
    })
    after, until = F.col("_i") - F.col("_pi"), F.col("_ni") - F.col("_i")
    if method in ("ffill", "pad"):
        filled, steps = F.col("_p"), after
    elif method == "bfill":
        filled, steps = F.col("_n"), until
    elif method == "linear":
        filled, steps = F.col("_p") + (F.col("_n") - F.col("_p")) * after / (F.col("_ni") - F.col("_pi")), after
    else:
        filled, steps = F.when(until.isNull() | (after <= until), F.col("_p")).otherwise(F.col("_n")), after
        filled = F.when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), filled)
    if limit is not None:
        filled = F.when(steps <= limit, filled)
    return df.withColumn(out or column, F.coalesce(x, filled)).drop("_x", "_i", "_p", "_n", "_pi", "_ni")


def ewm(
    df: DataFrame, column: str, partition_by: Sequence[str], order_by: Sequence[str], alpha: float | None = None, span: float | None = None, com: float | None = None,
    halflife: float | None = None, adjust: bool = True, ignore_nulls: bool = False, min_periods: int = 1, out: str = "ewm", ranges: int = 0,
) -> DataFrame:
    """Exponentially weighted mean of each partition, adjusted or recursive.

    Rows are sorted by Spark and pass through Python in Arrow batches, each batch one scan in numpy, the state going
    from one batch to the next, so a partition need not fit into memory. With `ranges` a partition may lie in several
    tasks (see `scans.ewm_of`): for keys that hold a large part of all rows. Columns other than the value pass as they
    are; null keys are one partition.
    """
    if alpha is None:
        alpha = 2 / (span + 1) if span is not None else 1 / (1 + com) if com is not None else 1 - 0.5 ** (1 / float(halflife or 1))
    rule = scans.Ewm(alpha, adjust, ignore_nulls, min_periods)
    return scans.ewm_of(df, num(df, column), partition_by, [F.col(c) for c in order_by], rule, out, ranges)
