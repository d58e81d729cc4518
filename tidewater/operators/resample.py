"""Resampling of time series into regular buckets, empty ones included."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.aggregates import CELL_REDUCERS

UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day"}


def bucket(ts: Column, rule: str) -> tuple[Column, str]:
    """The start of a time's bucket and the step between buckets. Rules: s, m, h, d from the epoch, w from Monday, M by month."""
    n, unit = re.fullmatch(r"(\d*)([smhdwM])", rule).groups()
    n = int(n or 1)
    if unit == "M":
        months = F.year(ts) * 12 + F.month(ts) - 1
        first = months - F.pmod(months - 1970 * 12, F.lit(n))
        return F.make_timestamp(F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), f"{n} month"
    if unit == "w":
        return F.window(ts, f"{7 * n} days", startTime="4 days")["start"], f"{7 * n} day"
    return F.window(ts, f"{n} {UNITS[unit]}s")["start"], f"{n} {UNITS[unit]}"


def resample(df: DataFrame, on: str, rule: str, spec: Mapping[str, str], order_by: Sequence[str] = (), fill: Any = None, label: str | None = None) -> DataFrame:
    """Values of each bucket between the first and the last: sum, mean, min, max, count, first or last of a column.

    Counts are of what is there; the sum of nothing is null; first and last keep nulls, in order of time and `order_by`;
    a null result becomes `fill`. Buckets without rows are there with nulls (count 0). Null times are left out.
    """
    start, step = bucket(F.col(on), rule)
    name = label or on

    def reduced(column: str, op: str) -> Column:
        if op in ("first", "last"):
            pick = F.min_by if op == "first" else F.max_by
            return pick(F.struct(column), F.struct(on, *order_by))[column]
        return CELL_REDUCERS[op](df, column)

    made = df.filter(F.col(on).isNotNull()).groupBy(start.alias(name)).agg(*[reduced(c, op).alias(c) for c, op in spec.items()])
    ends = made.agg(F.min(name).alias("a"), F.max(name).alias("b")).filter("a IS NOT NULL")
    grid = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(name))
    out = grid.join(made, name, "left")
    values = {c: F.coalesce(F.col(c), F.lit(0)) if op == "count" else F.col(c) for c, op in spec.items()}
    return out.select(name, *[(F.coalesce(v, F.lit(fill)) if fill is not None else v).alias(c) for c, v in values.items()])
