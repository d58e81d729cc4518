"""File sources and sinks, and upserts into tables of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """parquet, orc, json, csv or text; for csv and json give a schema, else Spark reads the files twice."""
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:
    writer = df.write.mode(mode).options(**({"header": True} if kind == "csv" else {}), **options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows, and target rows whose key the source lacks. Write the result to another path than the target's."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def to_markdown(df: DataFrame, n: int = 20) -> str:
    """The first `n` rows as a table for people to read."""
    rows = df.limit(n).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
