"""Windowed aggregates that run on batches and on streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, size: str, measures: Sequence[Column], by: Sequence[str] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows; on a stream `late` is the watermark after which late rows are dropped."""
    df = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(w, *by).agg(*measures).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *[c for c in _names(measures)])


def sessions(events: DataFrame, ts: str, gap: str, measures: Sequence[Column], by: Sequence[str], late: str | None = None) -> DataFrame:
    """Sessions of each key that end after `gap` without rows."""
    df = events.withWatermark(ts, late) if late else events
    out = df.groupBy(F.session_window(ts, gap), *by).agg(*measures)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, *_names(measures))


def _names(measures: Sequence[Column]) -> list[str]:
    return [m._jc.toString().rpartition(" AS ")[2].strip("`") for m in measures]


def merge_batches(path: str, keys: Sequence[str]):
    """A function for foreachBatch: each batch replaces rows of the same keys; batches write versions beside one another,
    so a batch that is run again gives the same version."""

    def sink(batch: DataFrame, number: int) -> None:
        from tidewater.sources.files import upsert

        batch.persist()
        old = batch.sparkSession.read.parquet(f"{path}/v{number - 1}") if number else batch.limit(0)
        upsert(old, batch.dropDuplicates(list(keys)), keys).write.mode("overwrite").parquet(f"{path}/v{number}")
        batch.unpersist()

    return sink
