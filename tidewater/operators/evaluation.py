"""Evaluation of retrieval and answers against what was expected: sources, facts and abstentions, and runs compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("hit", "precision", "recall", "fact_recall", "abstention_correct")


def _trimmed(c: str) -> Column:
    return F.btrim(F.col(c).cast("string"), F.lit(" \t\n\r\x0b\x0c"))


def _listed(df: DataFrame, key: str, value: str, any_case: bool = True) -> DataFrame:
    """Each value of a key once, without the space around it, then in lower case; values that differ in case alone are one, if asked for."""
    rows = df.select(F.col(key).alias("_key"), (F.lower(_trimmed(value)) if any_case else _trimmed(value)).alias("_value")).filter("_value != ''").distinct()
    return rows.withColumn("_value", F.lower("_value"))


def source_metrics(expected: DataFrame, observed: DataFrame, key: str, source: str) -> DataFrame:
    """key, hit (0 or 1), precision, recall of the keys that expect a source; sources in any case, each once, empty ones left out.

    Where nothing was observed, all are 0. A null key is a key of its own on either side.
    """
    e = _listed(expected, key, source).withColumn("_e", F.lit(1))
    o = _listed(observed, key, source).select(F.col("_key").alias("_okey"), F.col("_value").alias("_ovalue"), F.lit(1).alias("_o"))
    both = e.join(o, F.col("_key").eqNullSafe(F.col("_okey")) & (F.col("_value") == F.col("_ovalue")), "full")
    of = both.select(F.when(F.col("_e").isNull(), F.col("_okey")).otherwise(F.col("_key")).alias("_key"), "_e", "_o")
    matched = F.count_if(F.col("_e").isNotNull() & F.col("_o").isNotNull())
    sums = of.groupBy("_key").agg(F.count("_e").alias("e"), F.count("_o").alias("o"), matched.alias("m")).filter("e > 0")
    precision = F.when(F.col("o") > 0, F.col("m") / F.col("o")).otherwise(0.0)
    return sums.select(F.col("_key").alias(key), (F.col("m") > 0).cast("double").alias("hit"), precision.alias("precision"), (F.col("m") / F.col("e")).alias("recall"))


def fact_recall(facts: DataFrame, answers: DataFrame, key: str, fact: str, answer: str) -> DataFrame:
    """key, matched, expected, fact_recall: how many of a key's facts stand in its answer, in any case; repeated facts count once, in another case again.

    `answers` has one row a key; none, or a null one, has no fact in it. Empty facts are left out.
    """
    given = answers.select(F.col(key).alias("_akey"), F.lower(F.col(answer).cast("string")).alias("_answer"))
    held = _listed(facts, key, fact, any_case=False).join(given, F.col("_key").eqNullSafe(F.col("_akey")), "left")
    found = F.count_if(F.coalesce(F.contains("_answer", "_value"), F.lit(False)))
    sums = held.groupBy("_key").agg(found.alias("matched"), F.count(F.lit(1)).alias("expected"))
    return sums.select(F.col("_key").alias(key), "matched", "expected", (F.col("matched") / F.col("expected")).alias("fact_recall"))


def abstentions(answers: DataFrame, key: str, should: str, did: str) -> DataFrame:
    """key, abstention_correct (0 or 1); null where either is not known."""
    return answers.select(key, (F.col(should) == F.col(did)).cast("double").alias("abstention_correct"))


def items(samples: DataFrame, key: str, parts: Sequence[DataFrame]) -> DataFrame:
    """`key` of each sample with its metrics of `parts` (each a frame of `key` and metrics); null where a part has none."""
    out = samples.select(key).distinct()
    for part in parts:
        renamed = part.withColumnRenamed(key, "_other")
        out = out.join(renamed, F.col(key).eqNullSafe(F.col("_other")), "left").drop("_other")
    return out


def _rounded(c: Column) -> Column:
    """To six places, half up."""
    return F.floor(c * 1_000_000 + 0.5) / 1_000_000


def totals(item: DataFrame) -> DataFrame:
    """One row: evaluated, and the mean of each metric over the items that have it, null if none does."""
    return item.agg(F.count(F.lit(1)).alias("evaluated"), *[_rounded(F.avg(m)).alias(m) for m in METRICS if m in item.columns])


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """metric, baseline, candidate, delta of the totals of two runs; a delta is null where one has no such number."""
    sides = [totals(x) for x in (baseline, candidate)]
    rows = []
    for side, name in zip(sides, ("baseline", "candidate")):
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in side.columns])
        rows.append(side.select(F.explode(cells).alias("c")).select("c.metric", F.col("c.value").alias(name)))
    return rows[0].join(rows[1], "metric", "full").withColumn("delta", _rounded(F.col("candidate") - F.col("baseline")))
