"""Registered queries of draws, likeness of texts, artifacts and records, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import artifacts, draws, evaluation, fuzzy_join, schema
from tidewater.plans.catalog import _t, query


@query("""WITH s AS (SELECT i AS draw, ((i + 1) * 1831565813 + 7) % 4294967296 AS s FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i)),
a AS (SELECT draw, (xor(s, s >> 15)::HUGEINT * (s | 1) % 4294967296)::BIGINT AS t FROM s),
b AS (SELECT draw, t, (xor(t, t >> 7)::HUGEINT * (t | 61) % 4294967296)::BIGINT AS u FROM a),
c AS (SELECT draw, xor(t, (t + u) % 4294967296) AS t FROM b),
r AS (SELECT draw, ((xor(t, t >> 14)::HUGEINT * (SELECT sum(l_quantity)::BIGINT FROM lineitem)) // 4294967296)::BIGINT AS place FROM c),
w AS (SELECT l_orderkey, l_partkey, l_quantity, (sum(l_quantity) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - l_quantity)::BIGINT AS lo FROM lineitem WHERE l_quantity > 0)
SELECT r.draw, w.l_orderkey, w.l_partkey, w.l_quantity FROM r ASOF JOIN w ON r.place >= w.lo""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws of order lines as there are orders, each by its quantity."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = _t(spark, sf_dir, "lineitem").select(*order, "l_quantity")
    return draws.sample_draws(lines, _t(spark, sf_dir, "orders").count(), order, 7, "l_quantity").select("draw", "l_orderkey", "l_partkey", "l_quantity")


PARTS = "p AS (SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS t FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t"))


@query(f"WITH {PARTS}, s AS (SELECT a.t AS query, b.t AS text, floor((1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t))) * 1000 + 0.5) / 1000 AS score FROM p a, p b) SELECT * FROM s WHERE score >= 0.85")
def fuzzy_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return fuzzy_join.search(p, "t", p, "t", "levenshtein", 0.85)


@query(f"""WITH {PARTS}, w AS (SELECT t, list_distinct(string_split(t, ' ')) AS w FROM p), s AS (SELECT a.t AS query, b.t AS text, floor(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 1000 + 0.5) / 1000 AS score FROM w a, w b)
SELECT * FROM s WHERE score >= 0.6""")
def fuzzy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return fuzzy_join.search(p, "t", p, "t", "jaccard", 0.6)


# Names have 18 characters, so that a score of 0.9 is one edit at most; there the two definitions of swaps agree.
@query("""WITH s AS (SELECT a.c_name AS query, b.c_name AS text, floor((1 - damerau_levenshtein(a.c_name, b.c_name)::DOUBLE / least(length(a.c_name), length(b.c_name))) * 1000 + 0.5) / 1000 AS score
FROM (SELECT DISTINCT c_name FROM customer) a, (SELECT DISTINCT c_name FROM customer) b) SELECT * FROM s WHERE score >= 0.9""")
def fuzzy_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return fuzzy_join.search(c, "c_name", c, "c_name", "damerau", 0.9)


@query("""WITH v AS (SELECT event_id // 100 AS run, event_id AS id, 'model.' || event_id AS u, coalesce(value, 0) AS x FROM events),
l AS (SELECT run, u, 'ok' AS status, x, 'ran' AS message FROM v WHERE id % 13 <> 0), r AS (SELECT run, u, CASE WHEN id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN id % 5 = 0 THEN x + 1 ELSE x END AS x, CASE WHEN id % 17 = 0 THEN '' ELSE 'ran' END AS message FROM v WHERE id % 11 <> 0),
j AS (SELECT coalesce(l.run, r.run) AS run, coalesce(l.u, r.u) AS unique_id, CASE WHEN l.u IS NULL THEN 'added' WHEN r.u IS NULL THEN 'removed' ELSE 'changed' END AS change_type, CASE WHEN l.u IS NULL OR r.u IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.x <> r.x THEN 'executionTime' END, CASE WHEN l.message <> r.message THEN 'message' END, CASE WHEN l.status <> r.status THEN 'status' END) END AS fields
FROM l FULL JOIN r ON l.run = r.run AND l.u = r.u) SELECT * FROM j WHERE change_type <> 'changed' OR fields <> ''""")
def artifact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the results of runs of 100 events each, as JSON, compared by run."""
    e = _t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("run"), F.col("event_id").alias("id"), "value")
    every = lambda n: F.col("id") % n == 0

    def version(rows: DataFrame, status, value, message) -> DataFrame:
        entry = F.struct(F.concat(F.lit("model."), "id").alias("unique_id"), status.alias("status"), value.alias("execution_time"), message.alias("message"))
        bodies = rows.groupBy("run").agg(F.to_json(F.struct(F.collect_list(entry).alias("results"))).alias("body"))
        return artifacts.entries(bodies, "body", "run_results", ["run"])

    left = version(e.filter(~every(13)), F.lit("OK"), F.col("value"), F.lit("ran"))
    right = version(e.filter(~every(11)), F.when(every(7), "error").otherwise(" ok "), F.when(every(5), F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")), F.when(~every(17), "ran"))
    return artifacts.compare(left, right, ["run"]).select("run", "unique_id", "change_type", F.array_join("fields_changed", ",").alias("fields"))


EVALUATION = """f AS (SELECT d.doc_id, x.w FROM documents d, (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark) x WHERE x.item_id = d.doc_id % 40 AND x.w <> ''),
i AS (SELECT f.doc_id, count(*) FILTER (contains(lower(coalesce(d.text, '')), w)) AS matched, count(*) AS expected FROM f JOIN documents d USING (doc_id) GROUP BY 1),
e AS (SELECT doc_id, lang AS s FROM documents UNION SELECT doc_id - 1, lang FROM documents WHERE doc_id > 0), o AS (SELECT doc_id, source AS s FROM documents UNION SELECT doc_id - 1, lang FROM documents WHERE doc_id > 0 UNION SELECT doc_id - 2, lang FROM documents WHERE doc_id > 1),
n AS (SELECT doc_id, count(e.s) AS e, count(o.s) AS o, count(*) FILTER (e.s IS NOT NULL AND o.s IS NOT NULL) AS m FROM (SELECT doc_id, lower(s) AS s FROM e) e FULL JOIN (SELECT doc_id, lower(s) AS s FROM o) o USING (doc_id, s) GROUP BY 1),
a AS (SELECT d.doc_id, i.matched, i.expected, i.matched / i.expected AS fact_recall, (n.m > 0)::INT::DOUBLE AS hit, CASE WHEN n.o > 0 THEN n.m / n.o ELSE 0 END AS precision, n.m / n.e AS recall FROM documents d LEFT JOIN i USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id AND n.e > 0)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers to 40 benchmark items in turn, with the words of an item as facts, and languages as sources."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    words = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("fact"))
    facts = d.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(words, "item_id")
    of = lambda back, column: d.filter(F.col("doc_id") >= back).select((F.col("doc_id") - back).alias("doc_id"), F.col(column).alias("s"))
    sources = evaluation.source_metrics(of(0, "lang").union(of(1, "lang")), of(0, "source").union(of(1, "lang")).union(of(2, "lang")), "doc_id", "s")
    return evaluation.items(d, "doc_id", [evaluation.fact_recall(facts, d, "doc_id", "fact", "text"), sources])


@query(f"WITH {EVALUATION} SELECT doc_id, matched, expected, round(fact_recall, 6) AS fact_recall, hit, round(precision, 6) AS precision, round(recall, 6) AS recall FROM a")
def evaluation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("fact_recall", "precision", "recall")})


@query("""WITH e AS (SELECT event_id AS id FROM events) SELECT id, CASE WHEN id % 11 = 5 THEN 'not_object' WHEN id % 7 = 3 THEN 'key_count' WHEN id % 5 = 2 THEN 'missing_key' ELSE 'type' END AS problem,
CASE WHEN id % 11 = 5 OR id % 7 = 3 THEN NULL WHEN id % 5 = 2 THEN 'kind' ELSE 'value' END AS key FROM e WHERE id % 11 = 5 OR id % 7 = 3 OR id % 5 = 2 OR id % 3 = 1""")
def unlike_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON of which some lack a key, have one too many, hold another kind of value or are lists."""
    when = lambda n, rest: F.col("id") % n == rest
    value = F.when(when(3, 1), '"1"').otherwise("1.5")
    usual = F.concat(F.lit('{"value": '), value, F.when(when(5, 2), ', "sort": "').otherwise(', "kind": "'), "event_type", F.lit('"'), F.when(when(7, 3), ', "more": null}').otherwise("}"))
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type").select("id", F.when(when(11, 5), "[]").otherwise(usual).alias("record"))
    return schema.inconsistencies(e, "record", ["id"]).select("id", "problem", "key")
