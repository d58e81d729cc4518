"""Connected components of an edge table by alternating stars, with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, tidy


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties each greater neighbour of u to the least of u and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties u and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of each node of the undirected `edges` (u, v) of whole numbers.

    Rounds of large and small stars (Kiveris et al. 2014) until nothing changes: each keeps at most as many edges, and
    about log^2 of the longest path are needed. All work is on aggregates and joins; no component is gathered.
    Null ends and loops are ignored; a node without other edges is not returned.
    """
    now = cut(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct())
    seen = None
    for i in range(most_rounds):
        if i % 3 == 2:
            tidy(now.sparkSession)
        now = cut(_small_star(_large_star(now)))
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = sign
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
