"""Registered queries of pivots, stacks, pages and aligned series, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import joins, reshape, sorting
from tidewater.plans.catalog import GAPS, _gaps, _t, query


@query("""SELECT c_nationkey, round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 0), 2) AS "BUILDING_c_acctbal", arg_min(c_name, c_custkey) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING_c_name", count(*) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING_c_custkey",
round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 0), 2) AS "MACHINERY_c_acctbal", arg_min(c_name, c_custkey) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY_c_name", count(*) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY_c_custkey" FROM customer GROUP BY 1""")
def pivot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.pivot(_t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", {"c_acctbal": "sum", "c_name": "first", "c_custkey": "count"}, ["c_custkey"], values=["BUILDING", "MACHINERY"])
    return out.withColumns({f"{s}_c_acctbal": F.round(F.coalesce(f"{s}_c_acctbal", F.lit(0.0)), 2) for s in ("BUILDING", "MACHINERY")})


@query(f"WITH {GAPS} SELECT event_id, 'value' AS field, value::VARCHAR AS content FROM gaps WHERE value IS NOT NULL UNION ALL SELECT event_id, 'kind', kind FROM gaps WHERE kind IS NOT NULL")
def stack_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gaps(spark, sf_dir).withColumn("value", F.col("value").cast("string"))
    return reshape.stack(g, ["event_id"], ["value", "kind"], "field", "content")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 75)")
def page_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = sorting.page(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 75, 25)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query("""WITH a AS (SELECT c_nationkey AS label, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
b AS (SELECT s_nationkey AS label, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
l AS (SELECT label, i FROM a UNION SELECT label, i FROM b)
SELECT l.label, l.i::INT AS occurrence, coalesce(a.v, -1.0) AS left_value, coalesce(b.v, -1.0) AS right_value FROM l LEFT JOIN a ON a.label = l.label AND a.i = l.i % a.n LEFT JOIN b ON b.label = l.label AND b.i = l.i % b.n""")
def align_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return joins.align(c, s, "nation", "balance", ["id"], how="outer", fill=-1.0)
