"""Seeded draws with replacement, by weight if asked for: the same rows however the frame is partitioned."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.graphs import _cut

#: The step of the generator's counter, and what is set in the factor of its second product.
STEP = 0x6D2B79F5
SECOND = 61

WORD = (1 << 32) - 1


def _product(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two numbers of 32 bits, in halves that a long can hold."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))


def numbers(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """draw (from 0) and random, `n` numbers of 32 bits: each a function of the seed and its own draw alone.

    The generator counts in 32 bits, so draws 2^32 apart are the same.
    """
    start = (seed & WORD) or STEP
    df = spark.range(n).select(F.col("id").alias("draw"), (F.pmod(F.col("id") + 1, F.lit(1 << 32)) * STEP + start).bitwiseAND(F.lit(WORD)).alias("s"))
    s, t = F.col("s"), F.col("t")
    df = df.withColumn("t", _product(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1))))
    df = df.withColumn("u", _product(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(SECOND))))
    df = df.withColumn("t", t.bitwiseXOR((t + F.col("u")).bitwiseAND(F.lit(WORD))))
    return df.select("draw", t.bitwiseXOR(F.shiftrightunsigned(t, 14)).alias("random"))


def _units(df: DataFrame, weight: str | None) -> tuple[Column, bool]:
    """Weights as whole multiples of a power of two, whose sum fits a long; whether there are rows."""
    if weight is None:
        return F.lit(1).cast("long"), not df.isEmpty()
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    n, most, bad = df.agg(F.count(F.lit(1)), F.max(w), F.count_if(F.isnan(w) | (w < 0) | (w == float("inf")))).first()
    if bad:
        raise ValueError("weights must be finite numbers of 0 or more")
    if n and not most:
        raise ValueError("weights need one above 0")
    bits = min(40, 61 - math.ceil(math.log2(n + 1)))
    unit = 2.0 ** (math.frexp(most or 1.0)[1] - bits)
    return F.ceil(w / unit).cast("long"), n > 0


def sample_draws(df: DataFrame, n: int, order_by: Sequence[str], seed: int = 0, weight: str | None = None, number: str = "draw") -> DataFrame:
    """`n` draws of rows with replacement, as the columns of `df` and `number`, which counts the draws from 0.

    Rows stand one after the other in order of `order_by` (nulls first; ties by a hash of the row), each as long as its
    weight or 1; draw i takes the row at its random share of the whole length. Weights are rounded up to multiples of
    2^-40 of the greatest (2^-21 for 10^12 rows), so that sums are whole numbers and do not hang on how rows are
    dealt. A null weight is 0; a negative or non-finite one, or none above 0, is an error. An empty frame gives no rows.

    Rows and draws are put on one line by ranges of place, and each draw takes the last row before it: a row that takes
    a third of the draws, or of the weight, is met in many ranges. The driver sees one row a range at most.
    """
    spark = df.sparkSession
    units, any_rows = _units(df, weight)
    ties = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    keys = [f"_k{i}" for i in range(len(order_by))] + ["_tie"]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(order_by, keys)], ties.alias("_tie"), units.alias("_size"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    ranged = _cut(rows.filter("_size > 0").repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.sum("_size").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_part"))  # one row a range
    sums = sizes.select("_part", (upto - F.col("_n")).alias("_base"), upto.alias("_upto"))
    total = (sums.agg(F.max("_upto")).first()[0] or 0) if any_rows else 0
    within = F.sum("_size").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("_end", within).join(F.broadcast(sums), "_part").select((F.col("_base") + F.col("_end") - F.col("_size")).alias("_at"), F.lit(-1).cast("long").alias("_draw"), "_row")

    high, low = total >> 31, total & ((1 << 31) - 1)
    place = F.shiftright(F.col("random") * F.lit(high).cast("long") + F.shiftrightunsigned(F.col("random") * F.lit(low).cast("long"), 31), 1)
    kind = placed.schema["_row"].dataType
    draws = numbers(spark, n if total else 0, seed).select(place.alias("_at"), F.col("draw").alias("_draw"), F.lit(None).cast(kind).alias("_row"))
    line = _cut(placed.unionByName(draws).repartitionByRange("_at", "_draw").withColumn("_part", F.spark_partition_id()))
    ends = line.filter("_draw < 0").groupBy("_part").agg(F.max_by("_row", "_at").alias("_last"))
    parts = line.select("_part").distinct().join(ends, "_part", "left")
    before = parts.select("_part", F.last("_last", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # one row a range
    last = F.last("_row", True).over(Window.partitionBy("_part").orderBy("_at", "_draw").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = line.withColumn("_row", last).filter("_draw >= 0").join(before, "_part").select(F.coalesce("_row", "_before").alias("_row"), F.col("_draw").alias("_draw"))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], F.col("_draw").alias(number))
