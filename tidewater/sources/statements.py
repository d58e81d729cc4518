"""Prepared SQL statements over Spark's own parameter markers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Statement:
    """SQL text with :name markers; parameters without a default must be given."""

    text: str
    required: tuple[str, ...] = ()
    defaults: dict[str, Any] = field(default_factory=dict)

    def run(self, spark: SparkSession, **values: Any) -> DataFrame:
        given = {**self.defaults, **values}
        lacking = [p for p in self.required if p not in given]
        if lacking:
            raise ValueError(f"parameters are missing: {lacking}")
        return spark.sql(self.text, args=given)
