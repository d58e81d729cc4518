"""Registered queries of the library and their DuckDB equivalents, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import arrays, dates, fuzzy, strings
from tidewater.operators import aggregates, graphs, joins, missing, projection, resample, reshape, retrieval, schema, sets, sorting, telemetry, windows
from tidewater.sources import files, statements
from tidewater.streaming import windows as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read(spark, f"{sf_dir}/{name}.parquet")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing values, as the tables have none: no value in every seventh row, no type for errors."""
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.expr("nullif(event_type, 'error')").alias("kind"))


GAPS = "gaps AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, nullif(event_type, 'error') AS kind FROM events)"


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS o_totalprice_sum, count(*) AS o_totalprice_count, round(median(o_totalprice), 4) AS o_totalprice_median
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def merge_groupby_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    both = joins.merge(joins.merge(o, c, left_on=["o_custkey"], right_on=["c_custkey"]), n, left_on=["c_nationkey"], right_on=["n_nationkey"])
    out = aggregates.group_agg(both, ["n_name"], {"o_totalprice": ["sum", "count", "median"]})
    return out.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_median": F.round("o_totalprice_median", 4)})


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def filter_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.lit(1)).alias("n")
    )


@query(f"""WITH {GAPS} SELECT kind, round(coalesce(sum(value), 0), 4) AS value_sum, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, min(value) AS value_min, max(value) AS value_max,
round(max(value) - min(value), 4) AS value_range, round(var_samp(value), 4) AS value_var, round(stddev_samp(value), 6) AS value_std, count(*) AS value_count, count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS value_nunique FROM gaps GROUP BY kind""")
def groupby_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ["sum", "mean", "median", "min", "max", "range", "var", "std", "count", "nunique"]
    out = aggregates.group_agg(_gaps(spark, sf_dir), ["kind"], {"value": ops})
    digits = {"sum": 4, "mean": 6, "median": 6, "range": 4, "var": 4, "std": 6}
    return out.withColumns({f"value_{op}": F.round(f"value_{op}", d) for op, d in digits.items()})


@query("""SELECT s.label, round(s.v, 4) AS p_size, round(s.w, 4) AS p_retailprice FROM (SELECT unnest(['sum', 'mean', 'min', 'max', 'median']) AS label,
unnest([sum(p_size)::DOUBLE, avg(p_size), min(p_size)::DOUBLE, max(p_size)::DOUBLE, median(p_size)]) AS v, unnest([sum(p_retailprice), avg(p_retailprice), min(p_retailprice), max(p_retailprice), median(p_retailprice)]) AS w FROM part) s""")
def agg_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.agg_labels(_t(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["sum", "mean", "min", "max", "median"])
    return out.select("label", F.round("p_size", 4).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS turn FROM events)
SELECT user_id, arg_min(event_type, turn * -1000000000000 + event_id) AS event_type_mode FROM r GROUP BY user_id""")
def groupby_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mode(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["event_id"])


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.9), 4) AS c_acctbal_q FROM customer GROUP BY 1")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quantile(_t(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 0.9).withColumn("c_acctbal_q", F.round("c_acctbal_q", 4))


@query("""WITH r AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS i, (count(*) OVER (PARTITION BY c_mktsegment) - 1) * 0.25::DOUBLE AS pos FROM customer)
SELECT c_mktsegment, c_acctbal AS c_acctbal_q FROM r WHERE i = floor(pos)""")
def quantile_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quantile(_t(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 0.25, "lower")


@query("""SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS stat, round(unnest([count(s_acctbal)::DOUBLE, avg(s_acctbal), stddev_samp(s_acctbal), min(s_acctbal), quantile_cont(s_acctbal, 0.25), quantile_cont(s_acctbal, 0.5), quantile_cont(s_acctbal, 0.75), max(s_acctbal)]), 4) AS s_acctbal FROM supplier""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.describe(_t(spark, sf_dir, "supplier"), ["s_acctbal"]).withColumn("s_acctbal", F.round("s_acctbal", 4))


@query(f"WITH {GAPS} SELECT count(DISTINCT kind) AS kind, count(DISTINCT value) AS value FROM gaps")
def nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.nunique(_gaps(spark, sf_dir), ["kind", "value"])


@query("SELECT event_type, round(count(*) / sum(count(*)) OVER (), 8) AS count FROM events GROUP BY 1")
def value_counts_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.value_counts(_t(spark, sf_dir, "events"), ["event_type"], normalize=True).withColumn("count", F.round("count", 8))


@query("SELECT user_id, arg_min(event_id, (-value, event_id)) AS value_idxmax FROM events GROUP BY 1")
def idxmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.extreme_label(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "value", ["event_id"])


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers by nation, with null keys on both sides."""
    hide = lambda c: F.when(F.col(c) % 5 != 0, F.col(c))
    a = _t(spark, sf_dir, "customer").groupBy(hide("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))
    b = _t(spark, sf_dir, "supplier").filter("s_nationkey > 3").groupBy(hide("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return a, b


SIDES = """a AS (SELECT CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS key, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1),
b AS (SELECT CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS key, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1)"""


def _merges() -> None:
    for how, sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():
        def run(spark: SparkSession, sf_dir: str, how: str = how) -> DataFrame:
            return joins.merge(*_sides(spark, sf_dir), how=how, on=["key"])

        run.__name__ = f"merge_{how}_null_keys"
        query(f"WITH {SIDES} SELECT coalesce(a.key, b.key) AS key, a.n AS n_x, last, b.n AS n_y FROM a {sql} b ON a.key IS NOT DISTINCT FROM b.key")(run)


_merges()


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def merge_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merge(_t(spark, sf_dir, "region").select("r_name"), _t(spark, sf_dir, "nation").select("n_name"), "cross")


@query(f"WITH {SIDES} SELECT a.key AS key, a.n AS n_left, last, b.n AS n_right FROM a LEFT JOIN b ON a.key IS NOT DISTINCT FROM b.key")
def join_left_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(*_sides(spark, sf_dir), on=["key"])


@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.map_table(_t(spark, sf_dir, "supplier"), "s_nationkey", _t(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query(f"""WITH {GAPS} SELECT event_id, row_number() OVER w AS rn, lag(value, 1) OVER w AS before, lead(value, 2, 0) OVER w AS after, round(sum(value) OVER r, 4) AS run_sum, count(value) OVER r AS run_count, max(value) OVER r AS run_max
FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id), r AS (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id ROWS UNBOUNDED PRECEDING)""")
def window_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = windows.window(["user_id"], [("value", False), "event_id"]), F.col("value")
    return _gaps(spark, sf_dir).select(
        "event_id", F.row_number().over(w).alias("rn"), windows.shift(v, w).alias("before"), windows.shift(v, w, -2, 0.0).alias("after"),
        F.round(windows.running(v, w, "sum"), 4).alias("run_sum"), windows.running(v, w, "count").alias("run_count"), windows.running(v, w, "max").alias("run_max"),
    )


@query("""SELECT event_id, CASE WHEN row_number() OVER w >= 5 THEN round(avg(value) OVER (w ROWS 4 PRECEDING), 6) END AS roll, CASE WHEN count(value) OVER (w ROWS UNBOUNDED PRECEDING) >= 3 THEN round(avg(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) END AS expand
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def rolling_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = windows.window(["user_id"], ["event_id"]), F.col("value")
    return _t(spark, sf_dir, "events").select("event_id", F.round(windows.rolling(v, w, 5), 6).alias("roll"), F.round(windows.expanding(v, w, "mean", 3), 6).alias("expand"))


@query("""SELECT event_id, round(value - lag(value) OVER w, 4) AS diff, CASE WHEN lag(value) OVER w = 0 THEN NULL ELSE round((value - lag(value) OVER w) / lag(value) OVER w, 6) END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def diff_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = windows.window(["user_id"], ["event_id"]), F.col("value")
    return _t(spark, sf_dir, "events").select("event_id", F.round(windows.diff(v, w), 4).alias("diff"), F.round(windows.pct_change(v, w), 6).alias("change"))


@query("""SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dense, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS standard FROM part""")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", windows.rank(w).alias("dense"), windows.rank(w, Window.partitionBy("p_brand", "p_size"), "standard").alias("standard"))


@query(f"WITH {GAPS} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM gaps WHERE value IS NOT NULL")
def cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.cumulative(_gaps(spark, sf_dir), "value", ["user_id"], ["event_id"], "sum", "total", drop_invalid=True)
    return out.select("event_id", F.round("total", 4).alias("total"))


@query(f"""WITH {GAPS}, r AS (SELECT *, row_number() OVER w AS i, last_value(value IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS p, first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY event_id) AS pi, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM r)
SELECT event_id, round(coalesce(value, p + (n - p) * (i - pi) / (ni - pi)), 5) AS value FROM s""")
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.interpolate(_gaps(spark, sf_dir), "value", ["user_id"], ["event_id"]).select("event_id", F.round("value", 5).alias("value"))


@query("""WITH i AS (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT a.event_id, a.user_id, round(sum(b.value * pow(2 / 3, a.i - b.i)) / sum(CASE WHEN b.value IS NOT NULL THEN pow(2 / 3, a.i - b.i) END), 6) AS ewm FROM i a JOIN i b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.i <= a.i GROUP BY ALL""")
def ewm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.ewm(_gaps(spark, sf_dir).select("event_id", "user_id", "value"), "value", ["user_id"], ["event_id"], span=5)
    return out.select("event_id", "user_id", F.round("ewm", 6).alias("ewm"))


@query("""WITH b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, sum(value) AS value, count(user_id) AS user_id FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 6 HOUR)) AS ts FROM b) SELECT g.ts, round(value, 4) AS value, coalesce(user_id, 0) AS user_id FROM g LEFT JOIN b USING (ts)""")
def resample_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(_t(spark, sf_dir, "events"), "ts", "6h", {"value": "sum", "user_id": "count"})
    return out.withColumn("value", F.round("value", 4))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def resample_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_t(spark, sf_dir, "orders"), "o_orderdate", "1M", {"o_totalprice": "mean"}).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def nlargest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.nlargest(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 25, ["c_acctbal"], ["c_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 40")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.tail(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 40, ["o_orderkey"])


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.drop_duplicates(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) > 1 AS duplicated FROM events")
def duplicated_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.duplicated(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], "last").select("event_id", "duplicated")


@query("SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")), True)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS id FROM customer")
def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", sets.surrogate_key(["c_custkey", "c_name", "c_mktsegment"]).alias("id"))


@query("SELECT s_suppkey, 's_nationkey' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(_t(spark, sf_dir, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("double")), ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query("""SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS string_click_value, round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 4) AS string_error_value FROM events GROUP BY user_id""")
def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.pivot_table(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["value"], "sum", fill=0.0, names=["click", "error"])
    return out.select("user_id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def unstack_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unstack(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "count", [], values=["O", "F"])


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.explode(_t(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("word")), "word")


@query(f"WITH {GAPS} SELECT event_id, coalesce(value, -1) AS value, kind FROM gaps WHERE kind IS NOT NULL")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _gaps(spark, sf_dir).na.drop(subset=["kind"]).select("event_id", "value", "kind")
    return df.withColumn("value", F.when(missing.is_missing(df, "value"), -1.0).otherwise(F.col("value")))


@query(f"""WITH {GAPS} SELECT event_id, coalesce(value < 10, true) AS low, kind IS NOT DISTINCT FROM NULL AS none, coalesce(value BETWEEN 5 AND 20, false) AS mid, (kind IN ('click', 'view')) IS TRUE OR kind IS NULL AS listed,
CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'middle' ELSE 'low' END AS band FROM gaps""")
def two_valued_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.col("value"), F.col("kind")
    return _gaps(spark, sf_dir).select(
        "event_id", projection.compare(v, "<", F.lit(10)).alias("low"), projection.compare(k, "=", F.lit(None)).alias("none"), projection.between(v, 5, 20).alias("mid"),
        projection.is_in(k, ["click", "view", None]).alias("listed"), projection.case_when([(v > 50, "high"), (v > 10, "middle")], "low").alias("band"),
    )


@query("SELECT c_custkey, try_cast(try_cast(substr(c_name, -3) AS DOUBLE) AS BIGINT) AS number, c_acctbal > 0 AS credit FROM customer")
def as_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", -3, 3).alias("number"), (F.col("c_acctbal") > 0).alias("credit"))
    return projection.as_type(df, {"number": "integer"})


@query("""SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS capital, regexp_replace(regexp_replace(lower(p_brand), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake,
lpad(p_size::VARCHAR, 5, '0') AS filled, length(p_name) AS len, substr(p_name, 3, 4) AS part, starts_with(p_type, 'S') AS s, sha256(p_name) AS digest FROM part""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _t(spark, sf_dir, "part").select(
        "p_partkey", strings.capitalize(c("p_name")).alias("capital"), strings.snake(F.lower("p_brand")).alias("snake"), strings.zfill(c("p_size").cast("string"), 5).alias("filled"),
        F.length("p_name").alias("len"), strings.cut_out(c("p_name"), 2, 6).alias("part"), c("p_type").startswith("S").alias("s"), F.sha2("p_name", 256).alias("digest"),
    )


@query("""SELECT event_id, year(ts) AS year, month(ts) AS month, dayofweek(ts) AS weekday, hour(ts) AS hour, strftime(ts, '%Y-%m-%d') AS day, (epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-01')) // 3600000 AS hours,
strftime(ts + INTERVAL 1 MONTH, '%Y-%m-%d') AS later FROM events""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    p = dates.parts(ts)
    start = F.lit("2024-01-01").cast("timestamp")
    return _t(spark, sf_dir, "events").select(
        "event_id", p["year"].alias("year"), p["month"].alias("month"), p["day_of_week"].alias("weekday"), p["hour"].alias("hour"), dates.day(ts).alias("day"),
        dates.whole(ts, start, "hours").alias("hours"), dates.day(dates.add(ts, 1, "months")).alias("later"),
    )


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mean, round(list_median(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS median, round(list_var_samp(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS var FROM embeddings""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    c = F.col("e")
    return e.select("vec_id", *[F.round(f(c), 6).alias(n) for n, f in {"total": arrays.total, "mean": arrays.mean, "median": arrays.median, "var": arrays.variance}.items()])


@query("SELECT a.n_name AS left_name, b.n_name AS right_name, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(f"{s}_key"), F.col("n_name").alias(f"{s}_name")) for s in ("left", "right"))
    return a.join(b, "n_regionkey").filter("left_key < right_key").select("left_name", "right_name", F.levenshtein("left_name", "right_name").cast("long").alias("distance"))


@query("""WITH k AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS t FROM conversations)
SELECT a.conv_id, a.turn, round(coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0), 6) AS likeness FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(fuzzy.token_jaccard(F.col("text"), F.col("next")), 6).alias("likeness"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, text, unnest(range(0, n, 1000)) AS p FROM d),
c AS (SELECT doc_id, p // 1000 AS chunk_no, trim(substr(text, p + 1, 1200), ' ') AS chunk FROM s) SELECT doc_id, chunk_no, sha256(chunk) AS digest FROM c WHERE chunk_no = 0 OR length(chunk) >= 200""")
def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.char_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.sha2("chunk", 256).alias("digest"))


BM25 = r"""d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM documents), s AS (SELECT doc_id, t, len(t) AS n FROM d), w AS (SELECT count(*) AS docs, avg(n) AS mean FROM s),
q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT item_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM p JOIN q USING (term) JOIN f USING (term), w GROUP BY ALL)"""


@query(f"WITH {BM25} SELECT item_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 4) DESC, doc_id) AS r FROM b) WHERE r <= 8")
def bm25_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_top(_t(spark, sf_dir, "documents"), "doc_id", "text", _t(spark, sf_dir, "benchmark"), "item_id", "text", k=8, digits=4).drop("rank")


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, c.label AS nearest, round(s, 5) AS score FROM (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], centroid), 5) DESC, c.label) AS r FROM embeddings, c) c WHERE r = 1""")
def shard_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard whose centroid is nearest; there is a centroid for each of the few labels."""
    e = _t(spark, sf_dir, "embeddings")
    shards = retrieval.centroids(e, "label", "embedding").withColumnRenamed("label", "nearest")
    scored = e.select("vec_id", "embedding").crossJoin(F.broadcast(shards)).select("vec_id", "nearest", F.round(retrieval.cosine(F.col("embedding"), F.col("centroid")), 5).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "nearest"))
    return scored.groupBy("vec_id").agg(best.alias("b")).select("vec_id", F.col("b.nearest").alias("nearest"), (-F.col("b.s")).alias("score"))


@query("SELECT event_type, count(*) AS count, count(*) FILTER (value > 50) AS errors, round(count(*) FILTER (value > 50) / count(*), 6) AS error_rate, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def telemetry_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.aggregate(_t(spark, sf_dir, "events"), ["event_type"], "value", F.col("value") > 50)
    return out.withColumns({c: F.round(c, 6) for c in ("error_rate", "mean", "p50", "p95")})


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS measure FROM events GROUP BY ALL HAVING count(*) >= 60")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.alerts(_t(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], F.count(F.lit(1)), 60)


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, no""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(_t(spark, sf_dir, "events"), "ts", "6 hours", [F.count(F.lit(1)).alias("n")], ["user_id"])


EDGES = "edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).union(li.select(name("o", "l_orderkey"), name("p", "l_partkey"))).distinct()


@query(f"WITH {EDGES}, one AS (SELECT dst FROM edges WHERE src = 'c1'), two AS (SELECT DISTINCT e.dst FROM edges e JOIN one ON e.src = one.dst) SELECT 'c1' AS node, 0 AS depth UNION ALL SELECT dst, 1 FROM one UNION ALL SELECT dst, 2 FROM two")
def lineage_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.reach(_edges(spark, sf_dir), spark.range(1).select(F.lit("c1").alias("node")), 2)


@query("""WITH g AS (SELECT c_nationkey, min(c_custkey) AS least FROM customer GROUP BY 1) SELECT c_custkey AS node, least AS label FROM customer JOIN g USING (c_nationkey) UNION ALL SELECT c_nationkey + 10000000, least FROM g""")
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.groups(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 10_000_000).cast("long").alias("dst")))


@query("SELECT c_custkey::VARCHAR AS c_custkey, try_cast(c_name AS DOUBLE) AS c_name, c_acctbal::BIGINT * 0 + trunc(c_acctbal)::BIGINT AS c_acctbal, NULL::VARCHAR AS note FROM customer")
def schema_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.enforce(_t(spark, sf_dir, "customer"), {"c_custkey": "string", "c_name": "float", "c_acctbal": "integer", "note": "string"})


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' GROUP BY 1")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "orders").createOrReplaceTempView("tidewater_orders")
    text = "SELECT o_orderpriority, count(*) AS n FROM tidewater_orders WHERE o_totalprice > :least AND o_orderstatus = :status GROUP BY 1"
    return statements.Statement(text, ("least",), {"status": "O"}).run(spark, least=100_000)


@query("SELECT c_custkey, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <> 3")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return files.upsert(c.select("c_custkey", "c_acctbal"), c.filter("c_nationkey = 3").select("c_custkey", F.lit(0.0).alias("c_acctbal")), ["c_custkey"])
