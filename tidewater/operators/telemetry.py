"""Aggregates and alert rules over event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(events: DataFrame, by: Sequence[str], value: str, is_error: Column) -> DataFrame:
    """count, errors, error_rate, mean, p50 and p95 of each group."""
    n = F.count(F.lit(1))
    return events.groupBy(*by).agg(
        n.alias("count"), F.count_if(is_error).alias("errors"), (F.count_if(is_error) / n).alias("error_rate"),
        F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"),
    )


def alerts(events: DataFrame, ts: str, every: str, by: Sequence[str], measure: Column, threshold: float) -> DataFrame:
    """Windows and groups in which the measure is at least the threshold. For streams add a watermark before."""
    found = events.groupBy(F.window(ts, every), *by).agg(measure.alias("measure"))
    return found.filter(F.col("measure") >= threshold).select(F.col("window.start").alias("window_start"), *by, "measure")


def query(events: DataFrame, equal: Mapping[str, Sequence[str]], ts: str, since: str | None = None, until: str | None = None, text: tuple[str, str] | None = None) -> DataFrame:
    """Events with one of the wanted values in each column of `equal`, within a time range (both ends count) and with a text in a column."""
    for column, values in equal.items():
        events = events.filter(F.col(column).isin(*values))
    if since is not None:
        events = events.filter(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        events = events.filter(F.col(ts) <= F.lit(until).cast("timestamp"))
    return events.filter(F.lower(text[0]).contains(text[1].lower())) if text else events
