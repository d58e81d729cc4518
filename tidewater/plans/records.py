"""More registered queries: rules of expressions, missing values, arrays and nested values, retrieval, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import arrays, expressions, fuzzy, objects, strings
from tidewater.operators import aggregates, joins, manifest, missing, projection, reshape, retrieval, sets, sorting, telemetry, windows
from tidewater.plans.catalog import GAPS, _gaps, _t, query


@query("""SELECT c_custkey, c_name || '/' || c_nationkey AS label, c_acctbal - c_custkey AS less, round(c_acctbal * 2, 4) AS double_, CASE WHEN c_nationkey <> 0 THEN round(c_acctbal / c_nationkey, 6) END AS ratio,
CASE WHEN c_nationkey <> 0 THEN c_custkey % c_nationkey END AS rest, c_name LIKE '%7_' AS is_like, NOT coalesce(nullif(c_mktsegment, 'BUILDING') LIKE 'A%', false) AS unlike, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS known,
lower(c_name) AS low, upper(c_name) AS high, c_name AS trimmed, substr(c_name, 1, 4) AS head, substr(c_name, 10) AS tail, c_name || ':' || c_custkey AS joined, abs(c_acctbal) AS size, floor(c_acctbal)::BIGINT AS below, ceil(c_acctbal)::BIGINT AS above,
floor(c_acctbal * 10 + 0.5) / 10 AS rounded, CASE WHEN nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' THEN 'm' ELSE 'o' END AS kind FROM customer""")
def expression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = expressions, F.col
    segment = F.nullif(c("c_mktsegment"), F.lit("BUILDING"))
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", e.plus(e.plus(c("c_name"), F.lit("/"), text=True), c("c_nationkey").cast("double"), text=True).alias("label"), e.minus(c("c_acctbal"), c("c_custkey")).alias("less"),
        F.round(e.times(c("c_acctbal"), F.lit(2)), 4).alias("double_"), F.round(e.over(c("c_acctbal"), c("c_nationkey"), null_on_error=True), 6).alias("ratio"), e.modulo(c("c_custkey"), c("c_nationkey"), null_on_error=True).alias("rest"),
        e.like(c("c_name"), "%7_").alias("is_like"), e.negated(e.like(segment, "A%")).alias("unlike"), e.first_known(segment, c("c_name")).alias("known"), e.lower(c("c_name")).alias("low"), e.upper(c("c_name")).alias("high"),
        e.trim(F.concat(F.lit(" \t"), "c_name", F.lit("\n "))).alias("trimmed"), e.substring(c("c_name"), F.lit(-3), F.lit(4)).alias("head"), e.substring(c("c_name"), F.lit(10)).alias("tail"),
        e.concat(c("c_name"), F.lit(":"), c("c_custkey")).alias("joined"), e.absolute(c("c_acctbal")).alias("size"), e.floor(c("c_acctbal")).alias("below"), e.ceil(c("c_acctbal")).alias("above"),
        e.round_half_up(c("c_acctbal"), 1).alias("rounded"), e.iff(segment == "MACHINERY", F.lit("m"), F.lit("o")).alias("kind"),
    )


@query(f"""WITH {GAPS} SELECT event_id, coalesce(value > 50, false) AND coalesce(kind = 'click', false) AS both_, coalesce(value > 50, false) OR coalesce(kind = 'click', false) AS either_, NOT coalesce(value > 50, false) AS not_, value IS NULL AS gone,
kind IS NULL OR kind = 'click' AS listed, date_trunc('hour', ts)::TIMESTAMP AS hour_, epoch_us(ts) // 1000 AS unix_, CASE WHEN user_id = 0 THEN 'inf' WHEN value IS NULL THEN 'true' ELSE 'false' END AS shown, user_id * 60000 AS ms, user_id / 3600000 AS hours FROM gaps""")
def condition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, g, c = expressions, _gaps(spark, sf_dir), F.col
    quotient = e.divide(c("value"), c("user_id"))
    shown = F.when(c("user_id") == 0, F.lit("inf")).otherwise(F.when(quotient.isNull(), "true").otherwise("false"))
    return g.select(
        "event_id", e.both(c("value") > 50, c("kind") == "click").alias("both_"), e.either(c("value") > 50, c("kind") == "click").alias("either_"), e.negated(c("value") > 50).alias("not_"), missing.is_missing(g, "value").alias("gone"),
        projection.is_in(c("kind"), ["click", None]).alias("listed"), e.date_trunc("hour", c("ts")).alias("hour_"), e.unix_time(c("ts")).alias("unix_"), shown.alias("shown"),
        e.to_milliseconds(c("user_id"), "minutes").alias("ms"), e.from_milliseconds(c("user_id"), "hours").alias("hours"),
    )


@query(f"WITH {GAPS} SELECT event_id, coalesce(value, -1.0) AS value, coalesce(kind, 'none') AS kind FROM gaps WHERE value IS NOT NULL OR kind IS NOT NULL")
def fill_and_drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = missing.drop_nulls(_gaps(spark, sf_dir), how="all", subset=["value", "kind"])
    return missing.fill_nulls(g, {"value": -1.0, "kind": "none"}).select("event_id", "value", "kind")


@query(f"WITH {GAPS} SELECT event_id, ts, user_id FROM gaps")
def drop_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.drop_null_columns(_gaps(spark, sf_dir))


@query(f"WITH {GAPS} SELECT event_id, CASE WHEN kind = 'click' THEN 'C' WHEN kind IS NULL THEN 'E' ELSE kind END AS kind, coalesce(greatest(10, least(60, value)), 10) AS value FROM gaps")
def replace_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gaps(spark, sf_dir)
    return missing.replace(g, {"click": "C", None: "E"}, columns=["kind"]).select("event_id", "kind", missing.clip(g, "value", 10.0, 60.0).alias("value"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), o AS (SELECT o_orderkey, o_custkey % 27 AS k, row_number() OVER (PARTITION BY o_custkey % 27 ORDER BY o_orderkey) - 1 AS turn FROM orders)
SELECT k::INT AS c_nationkey, coalesce(c_name, 'none') AS c_name, 'none' AS extra, count(*) AS n FROM o LEFT JOIN c ON c_nationkey = k AND i = turn % c.n GROUP BY ALL""")
def reindex_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 27).cast("int").alias("c_nationkey"))
    rows = _t(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey")
    found = projection.reindex(rows, "c_nationkey", labels, fill="none", order_by=["c_custkey"], columns=["c_name", "extra"])
    return found.groupBy("c_nationkey", "c_name", "extra").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT p_name AS a, p_brand || ' ' || lower(p_type) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' ' || split_part(p_name, ' ', 2) END AS b FROM part), x AS (SELECT *, translate(regexp_replace(upper(a), '[^BFPVCGJKQSXZDTLMNR]', '0', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556') AS s,
list_distinct(string_split(a, ' ')) AS t, list_distinct(string_split(b, ' ')) AS u FROM p), y AS (SELECT *, array_to_string(list_filter(list_transform(range(2, len(s) + 1), lambda i: CASE WHEN s[i] <> s[i - 1] THEN s[i] ELSE '0' END), lambda d: d <> '0'), '') AS d FROM x)
SELECT a, b, left(upper(a[1]) || d || '000', 4) AS code, round(len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))), 6) AS words, CASE WHEN length(a) = length(b) THEN hamming(a, b)::DOUBLE ELSE 'inf'::DOUBLE END AS places FROM y""")
def name_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _t(spark, sf_dir, "part"), F.col
    b = F.concat(c("p_brand"), F.lit(" "), F.lower("p_type"), F.when(c("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.split("p_name", " ")[1])))
    p = p.select(c("p_name").alias("a"), b.alias("b")).distinct()
    return p.select("a", "b", fuzzy.soundex(c("a")).alias("code"), F.round(fuzzy.token_jaccard(c("a"), c("b")), 6).alias("words"), fuzzy.hamming(c("a"), c("b")).alias("places"))


@query("SELECT n.k::BIGINT AS c_custkey, coalesce(c_name, 'none') AS c_name FROM (SELECT unnest(range(0, 3000, 7)) AS k UNION ALL SELECT 14) n LEFT JOIN customer c ON c.c_custkey = n.k")
def reindex_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.range(0, 3000, 7).union(spark.range(14, 15)).toDF("c_custkey")
    return projection.reindex(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", labels, fill="none")


@query("""WITH a AS (SELECT user_id, list(value::DOUBLE ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_sum(v), 4) AS total, len(list_distinct(v)) AS n_distinct, round(v[1] + v[2], 4) AS second,
round((v[1] + v[2] + v[3]) / 3, 4) AS third, v[1:2] || list_resize([0.0::DOUBLE], greatest(0, 2 - len(v))) AS two FROM a WHERE len(v) > 2""")
def array_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    a = _t(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("v")).filter(F.size("v") > 2)
    v = F.col("v")
    return a.select(
        "user_id", F.round(F.element_at(arrays.cumulative(v), -1), 4).alias("total"), F.array_max(arrays.rank(v)).cast("long").alias("n_distinct"), F.round(arrays.cumulative(v)[1], 4).alias("second"),
        F.round(arrays.rolling(v, 3)[2], 4).alias("third"), arrays.standardize(v, F.lit(2), F.lit(0.0)).alias("two"),
    )


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def array_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("v"))
    return a.select("user_id", F.explode(arrays.value_counts(F.col("v"))).alias("event_type", "n")).withColumn("n", F.col("n").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS \"who.type\", user_id AS \"who.id\" FROM events")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", objects.value_at(F.col("props"), "k").alias("k"), F.struct(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("id")).alias("who")).alias("nested"))
    return objects.flatten(e, "nested")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of equal entries in either order are one key; selected, removed and renamed keys give the same."""
    pair = [F.lit("type"), F.col("event_type"), F.lit("note"), F.lit("x")]
    e = _t(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 2 == 0, F.create_map(*pair)).otherwise(F.create_map(*pair[2:], *pair[:2])).alias("m"))
    m = objects.remove_keys(objects.rename_keys(objects.select_keys(F.col("m"), ["type", "note"]), {"type": "kind"}), ["note"])
    grouped = e.select(objects.canonical(F.col("m")).alias("key"), m["kind"].alias("kind")).groupBy("key").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    return grouped.select("kind", "n")


@query("""WITH g AS (SELECT p_name, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2))) AS g FROM (SELECT DISTINCT p_name FROM part)),
p AS (SELECT a.p_name AS query, b.p_name AS text, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS score FROM g a, g b) SELECT query, text, round(score, 6) AS score FROM p WHERE score >= 0.5""")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_name")
    return fuzzy.fuzzy_search(p, "p_name", p, "p_name", 0.5).withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey, regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$') AS is_word, replace(o_orderpriority, '-', '/') AS slashed, o_orderstatus || ' ' || o_orderpriority AS both_ FROM orders")
def text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", strings.matches(F.col("o_orderpriority"), "^[0-9]-[A-Z]+$").alias("is_word"), strings.replace(F.col("o_orderpriority"), "-", "/").alias("slashed"), strings.join(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("both_"))


@query("SELECT c_custkey, c_nationkey, product(2.0::DOUBLE ** (c_custkey % 5 - 2)) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS running FROM customer")
def cumulative_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.pow(F.lit(2.0), F.col("c_custkey") % 5 - 2).alias("x"))
    return windows.cumulative(c, "x", ["c_nationkey"], ["c_custkey"], "product", "running").select("c_custkey", "c_nationkey", "running")


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-05' AND contains(lower(props), '7')")
def telemetry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.query(_t(spark, sf_dir, "events"), {"event_type": ["click", "view"]}, "ts", "2024-01-02", "2024-01-05", ("props", "7")).select("event_id", "user_id", "value")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND doc_id % 3 <> 1 AND doc_id % 5 <> 0")
def access_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").withColumn("principals", F.array(F.concat(F.lit("g"), F.col("doc_id") % 3), F.when(F.col("doc_id") % 5 == 0, "secret").otherwise("open")))
    return retrieval.accessible(d, {"lang": ["en", "de"]}, allow=["g0", "g2"], deny=["secret"]).select("doc_id", "lang")


@query("SELECT conv_id % 50 AS talk, turn, max(length(text)) AS score, list_sort(list(DISTINCT role)) AS matched FROM conversations GROUP BY ALL")
def merged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("talk"), "turn", "role", F.length("text").cast("long").alias("score"))
    return retrieval.merged_queries(c, "talk", "role", "turn").select("talk", "turn", "score", "matched")


MANIFEST = """e AS (SELECT 'model.' || p_partkey AS unique_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'source' ELSE 'model' END AS resource_type, CASE WHEN p_partkey % 4 <> 0 THEN p_type || ' of ' || p_name END AS description,
[p_brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END] AS tags, p_brand AS owner, p_size, p_partkey FROM part)"""


def _entities(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """A manifest made of parts: each depends on the part of half its number."""
    p, c = _t(spark, sf_dir, "part"), F.col
    if changed:
        p = p.filter("p_partkey % 10 <> 1").withColumn("p_name", F.when(c("p_partkey") % 10 == 2, "new name").otherwise(c("p_name")))
    column = lambda name, kind, text: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), text.alias("description"))
    name = lambda k: F.concat(F.lit("model."), k.cast("string"))
    third = F.when(c("p_partkey") % 10 == 3, F.lit("extra" if changed else "size")).otherwise(F.lit("Size"))
    return p.select(
        name(c("p_partkey")).alias("unique_id"), c("p_name").alias("name"), F.when(c("p_partkey") % 3 == 0, "source").otherwise("model").alias("resource_type"), F.lit("parts/all.sql").alias("path"),
        F.when(c("p_partkey") % 4 != 0, F.concat("p_type", F.lit(" of "), "p_name")).alias("description"), F.array("p_brand", F.when(c("p_size") > 25, "large").otherwise("small")).alias("tags"),
        F.to_json(F.struct(F.col("p_brand").alias("owner"), "p_size")).alias("meta"),
        F.array(column("id", "bigint", F.lit("key")), column("name", "string", F.lit(None).cast("string")), F.struct(third.alias("name"), F.lit("int").alias("type"), F.lit("size").alias("description"))).alias("columns"),
        F.when(c("p_partkey") > 1, F.array(name(F.floor(c("p_partkey") / 2)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )


@query(f"""WITH {MANIFEST}, w AS (SELECT list_distinct(list_filter(string_split_regex(lower(x), '[^a-z0-9]+'), lambda t: t <> '')) AS t, unique_id, pts FROM (
SELECT unique_id, unique_id AS x, 40 AS pts FROM e UNION ALL SELECT unique_id, name, 30 FROM e UNION ALL SELECT unique_id, 'parts/all.sql', 20 FROM e UNION ALL SELECT unique_id, resource_type, 15 FROM e UNION ALL SELECT unique_id, description, 10 FROM e WHERE description IS NOT NULL
UNION ALL SELECT unique_id, array_to_string(tags, ' '), 15 FROM e)), p AS (SELECT unique_id, unnest(t) AS token, pts FROM w), q AS (SELECT 1 AS query_id, unnest(['large', 'ring']) AS token UNION ALL SELECT 2, unnest(['model', '17']))
SELECT query_id, unique_id, sum(score)::BIGINT AS score FROM (SELECT query_id, unique_id, pts AS score FROM q JOIN p USING (token) UNION ALL SELECT 2, 'model.17', 100) GROUP BY ALL""")
def manifest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "large ring"), (2, "Model.17")], "query_id int, text string")
    return manifest.search(_entities(spark, sf_dir), asked)


@query(f"WITH {MANIFEST} SELECT unique_id, resource_type FROM e WHERE owner = 'Brand#2' AND list_contains(tags, 'large') AND p_size IN (30, 40, 41)")
def manifest_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.tagged(_entities(spark, sf_dir), ["large", "Brand#2"], every=True)
    found = manifest.meta_where(manifest.meta_where(found, "owner", "eq", "Brand#2"), "p_size", "in", ["30", "40", "41"])
    return found.select("unique_id", "resource_type")


@query("""SELECT 'model.' || p_partkey AS unique_id, CASE WHEN p_partkey % 10 = 1 THEN 'removed' WHEN p_partkey % 10 IN (2, 3) THEN 'modified' ELSE 'unchanged' END AS state,
CASE WHEN p_partkey % 10 = 3 THEN ['extra'] ELSE [] END AS columns_added, CASE WHEN p_partkey % 10 = 3 THEN ['size'] WHEN p_partkey % 10 = 1 THEN ['Size', 'id', 'name'] ELSE [] END AS columns_removed FROM part""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.diff(_entities(spark, sf_dir), _entities(spark, sf_dir, changed=True))


@query("""SELECT round(100.0 * count(*) FILTER (p_partkey % 4 <> 0) / count(*), 2) AS described, 66.67::DOUBLE AS columns_described, round(100.0 * count(*) FILTER (p_partkey % 2 = 0) / count(*), 2) AS tested,
round(0.4 * round(100.0 * count(*) FILTER (p_partkey % 4 <> 0) / count(*), 2) + 0.3 * 66.67 + 0.3 * round(100.0 * count(*) FILTER (p_partkey % 2 = 0) / count(*), 2), 2) AS readiness FROM part""")
def manifest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _t(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("model."), F.col("p_partkey").cast("string")).alias("unique_id"))
    return manifest.coverage(_entities(spark, sf_dir), tests)


@query(f"WITH {MANIFEST} SELECT owner, count(*) AS n FROM e GROUP BY 1")
def manifest_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.owners(_entities(spark, sf_dir))


@query("""WITH RECURSIVE d AS (SELECT 3 AS k, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM d JOIN part ON p_partkey > 1 AND p_partkey // 2 = k WHERE depth < 4)
SELECT 'model.' || k AS node, depth, CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'none' END AS status FROM d""")
def manifest_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _t(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("model."), F.col("p_partkey").cast("string")).alias("unique_id"), F.lit("pass").alias("status"))
    return manifest.impact(_entities(spark, sf_dir), spark.range(1).select(F.lit("model.3").alias("node")), 4, results)


@query("""WITH c AS (SELECT p_partkey AS k, unnest(['id', 'name', CASE WHEN p_partkey % 10 = 3 THEN 'size' ELSE 'Size' END]) AS name FROM part)
SELECT 'model.' || a.k AS src, a.name AS src_column, 'model.' || b.k AS dst, b.name AS dst_column, CASE WHEN a.name = b.name THEN 1.0 ELSE 0.94 END::DOUBLE AS score FROM c b JOIN c a ON b.k > 1 AND b.k // 2 = a.k AND lower(a.name) = lower(b.name)""")
def column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.column_lineage(_entities(spark, sf_dir))


@query("SELECT resource_type, n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'source' ELSE 'model' END AS resource_type, count(*) AS n FROM part GROUP BY 1)")
def manifest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.listing(_entities(spark, sf_dir))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS preview FROM documents WHERE length(text) BETWEEN 1 AND 90")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").filter("length(text) BETWEEN 1 AND 90").select("doc_id", retrieval.preview(F.col("text")).alias("preview"))


@query("SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, product(1 + (c_custkey % 3) / 2.0) > 1 AS more FROM customer GROUP BY 1")
def group_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").withColumn("x", 1 + (F.col("c_custkey") % 3) / 2.0)
    out = aggregates.group_agg(c, ["c_nationkey"], {"c_acctbal": ["min", "max"], "x": ["product"]})
    return out.select("c_nationkey", F.col("c_acctbal_min").alias("low"), F.col("c_acctbal_max").alias("high"), (F.col("x_product") > 1).alias("more"))


@query("SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def stack_of_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pivot stacked again."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = _t(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", names).agg(F.round(F.sum("c_acctbal"), 2))
    return reshape.melt(wide, ["c_nationkey"], names, "c_mktsegment", "total").filter("total IS NOT NULL")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sorting.sort(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [False, True])
    return o.offset(50).limit(25)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive, CASE WHEN NOT c_acctbal > 0 THEN c_acctbal END AS rest FROM customer")
def where_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("positive"), F.col("c_acctbal").alias("rest"))
    return projection.mask(projection.where(c, F.col("positive") > 0, columns=["positive"]), F.col("rest") > 0, columns=["rest"])


@query("SELECT s_nationkey AS nation FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)")
def intersect_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = (_t(spark, sf_dir, t).select(F.col(k).alias("nation")) for t, k in (("supplier", "s_nationkey"), ("customer", "c_nationkey")))
    return sets.intersect(c, s, ["nation"])


@query("SELECT c_custkey AS key, c_acctbal AS a, s_acctbal AS b FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE coalesce(c_custkey, s_suppkey) < 400")
def align_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").filter("c_custkey < 400").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("a"))
    s = _t(spark, sf_dir, "supplier").filter("s_suppkey < 400").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("b"))
    return joins.merge(c, s, how="outer", on=["key"])
