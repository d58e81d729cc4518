"""Registered queries of column lineage, alerts and incremental work, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import alerts, column_lineage, windows
from tidewater.plans.catalog import GAPS, _gaps, _t, query


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities out of `part`: each depends on the one of half its number; names of columns share words, types and tags with others."""
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.lower("p_type")
    text = k.cast("string")

    def column(of, type_, words, tags, size):
        return F.struct(of.alias("name"), type_.alias("type"), words.alias("description"), tags.alias("tags"), F.create_map(F.lit("size"), size.cast("string")).alias("meta"))

    number = F.when(k % 3 == 0, "Part_ID").when(k % 3 == 1, "part  id").otherwise("part_key")
    columns = F.array(
        column(F.replace(name, F.lit(" "), F.lit("_")), F.when(k % 2 == 0, "varchar(20)").otherwise("VARCHAR"), F.concat(name, F.lit(" of "), kind), F.array(kind, F.col("p_brand")), F.col("p_size") % 5),
        column(F.concat(F.split(name, " ")[0], F.lit("."), kind), F.lit("string"), F.concat(F.lit("kind of "), name), F.array(kind), F.col("p_size") % 3),
        column(number, F.when(k % 4 == 0, "int").otherwise("bigint"), F.lit("number of the part"), F.array(F.lit("key"), F.col("p_brand")), F.col("p_size")),
    )
    above = F.when(k > 1, F.array(F.concat(F.lit("model."), F.floor(k / 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("model."), text).alias("unique_id"), columns.alias("columns"), above.alias("depends_on"))


COLUMN_PATHS = r"""WITH m AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS a, split_part(p_name, ' ', 1) || '.' || lower(p_type) AS b, CASE p_partkey % 3 WHEN 0 THEN 'Part_ID' WHEN 1 THEN 'part  id' ELSE 'part_key' END AS c, * FROM part),
f AS (SELECT k, a AS name, CASE WHEN k % 2 = 0 THEN 'varchar(20)' ELSE 'varchar' END AS typ, p_name || ' of ' || lower(p_type) AS words, [lower(p_type), lower(p_brand)] AS tags, p_size % 5 AS size FROM m
 UNION ALL SELECT k, b, 'string', 'kind of ' || p_name, [lower(p_type)], p_size % 3 FROM m
 UNION ALL SELECT k, c, CASE WHEN k % 4 = 0 THEN 'int' ELSE 'bigint' END, 'number of the part', ['key', lower(p_brand)], p_size FROM m),
g AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS key_, list_distinct(string_split_regex(lower(words), '[^a-z0-9_]+')) AS w FROM f),
h AS (SELECT *, list_distinct(string_split(key_, '_')) AS tok FROM g),
pairs AS (SELECT x.k AS from_k, x.name AS from_c, y.k AS to_k, y.name AS to_c, lower(x.name) = lower(y.name) AS exact,
 CASE WHEN x.key_ = y.key_ THEN 0.94::DOUBLE WHEN len(list_intersect(x.tok, y.tok)) > 0 THEN len(list_intersect(x.tok, y.tok))::DOUBLE / (len(x.tok) + len(y.tok) - len(list_intersect(x.tok, y.tok))) * 0.4::DOUBLE
  + len(list_intersect(x.tok, y.tok))::DOUBLE / least(len(x.tok), len(y.tok)) * 0.38::DOUBLE + CASE WHEN starts_with(x.key_, y.key_) OR starts_with(y.key_, x.key_) OR ends_with(x.key_, y.key_) OR ends_with(y.key_, x.key_) THEN 0.12::DOUBLE ELSE 0 END ELSE 0 END
 + CASE WHEN x.typ = y.typ THEN 0.08::DOUBLE WHEN contains(x.typ, y.typ) OR contains(y.typ, x.typ) THEN 0.03::DOUBLE ELSE 0 END
 + least(0.06::DOUBLE, len(list_intersect(x.tags, y.tags))::DOUBLE / greatest(len(x.tags), len(y.tags)) * 0.06::DOUBLE) + CASE WHEN x.size = y.size THEN 0.02::DOUBLE ELSE 0 END + least(0.04::DOUBLE, len(list_intersect(x.w, y.w)) * 0.01::DOUBLE) AS s
 FROM h x JOIN h y ON y.k > 1 AND y.k // 2 = x.k),
scored AS (SELECT from_k, from_c, to_k, to_c, CASE WHEN exact THEN 1 ELSE least(1, s) END AS conf FROM pairs),
kept AS (SELECT * FROM scored WHERE conf >= 0.55 QUALIFY row_number() OVER (PARTITION BY from_k, lower(from_c), to_k ORDER BY conf DESC, to_c) <= 3),
one AS (SELECT from_k AS o, from_c AS oc, to_k AS k, to_c AS c, 1 AS depth, conf FROM kept),
two AS (SELECT o, oc, to_k AS k, to_c AS c, 2 AS depth, max(least(one.conf, kept.conf)) AS conf FROM one JOIN kept ON one.k = kept.from_k AND one.c = kept.from_c GROUP BY ALL),
three AS (SELECT o, oc, kept.to_k, kept.to_c, 3, max(least(two.conf, kept.conf)) FROM two JOIN kept ON two.k = kept.from_k AND two.c = kept.from_c GROUP BY ALL)
SELECT 'model.' || o AS origin_id, oc AS origin_column, 'model.' || k AS unique_id, c AS "column", depth, round(conf, 6) AS confidence, CASE WHEN round(conf, 6) >= 0.85 THEN 'high' WHEN round(conf, 6) >= 0.65 THEN 'medium' ELSE 'low' END AS confidence_label
FROM (SELECT k AS o, name AS oc, k, name AS c, 0 AS depth, 1::DOUBLE AS conf FROM h UNION ALL FROM one UNION ALL FROM two UNION ALL FROM three)"""


@query(COLUMN_PATHS)
def column_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _models(spark, sf_dir)
    start = models.select("unique_id", F.explode("columns.name").alias("column"))
    nodes, _ = column_lineage.paths(models, start, depth=3)
    sure = F.round("confidence", 6)
    return nodes.withColumns({"confidence": sure, "confidence_label": column_lineage.label(sure)})


RULES = (
    alerts.Rule("errors", "error_rate", "gt", 25, window=21600, suppression=43200, min_samples=8),
    alerts.Rule("busy", "count", "gte", 4, window=86400, suppression=172800, dimensions=("event_type", "user_id"), min_samples=2),
    alerts.Rule("slow", "avg_duration_ms", "gt", 50, window=43200, suppression=0, dimensions=("event_type",)),
    alerts.Rule("tail", "p95_duration_ms", "lt", 120, window=43200, suppression=21600, min_samples=3, dimensions=("event_type",), where="value > 20"),
    alerts.Rule("none", "error_count", "eq", 0, window=3600, suppression=18000, min_samples=0),
    alerts.Rule("off", enabled=False),
)

ALERT_STATES = """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS at_ FROM events), r AS (SELECT * FROM (VALUES ('errors', 21600, 43200, 8), ('busy', 86400, 172800, 2), ('slow', 43200, 0, 1), ('tail', 43200, 21600, 3), ('none', 3600, 18000, 0)) v(rule_id, win, pause, least)),
grid AS (SELECT unnest(range((SELECT min((at_ + 10799999999) // 10800000000) FROM e)::BIGINT, (SELECT max((at_ + 10799999999) // 10800000000) FROM e)::BIGINT + 1)) AS n),
s AS (SELECT rule_id, n, CASE rule_id WHEN 'busy' THEN 'event_type=' || event_type || '|user_id=' || user_id WHEN 'slow' THEN 'event_type=' || event_type WHEN 'tail' THEN 'event_type=' || event_type ELSE '__all__' END AS group_key, event_type = 'error' AS bad, value
 FROM e, r, LATERAL (SELECT unnest(range(((at_ + 10799999999) // 10800000000)::BIGINT, least((at_ + win::BIGINT * 1000000) // 10800000000, (SELECT max(n) FROM grid))::BIGINT + 1)) AS n) w WHERE rule_id <> 'tail' OR value > 20),
m AS (SELECT rule_id, group_key, n, count(*) AS k, count(*) FILTER (bad) AS errs, avg(value) AS mean, quantile_cont(value, 0.95) AS tail FROM s GROUP BY ALL),
a AS (SELECT * FROM m UNION ALL SELECT rule_id, '__all__', n, 0, 0, NULL, NULL FROM grid, r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rule_id = r.rule_id AND m.n = grid.n)),
v AS (SELECT rule_id, group_key, n, k, pause, k < least AS few, CASE rule_id WHEN 'errors' THEN errs / k * 100 WHEN 'busy' THEN k WHEN 'slow' THEN mean WHEN 'tail' THEN tail ELSE errs END::DOUBLE AS x FROM a JOIN r USING (rule_id)),
j AS (SELECT *, NOT few AND coalesce(CASE rule_id WHEN 'errors' THEN x > 25 WHEN 'busy' THEN x >= 4 WHEN 'slow' THEN x > 50 WHEN 'tail' THEN x < 120 ELSE x = 0 END, false) AS hit FROM v),
h AS (SELECT rule_id, group_key, n, pause FROM j WHERE hit),
fired AS (SELECT rule_id, group_key, min(n) AS n FROM h GROUP BY ALL UNION ALL SELECT f.rule_id, f.group_key, (SELECT min(h.n) FROM h WHERE h.rule_id = f.rule_id AND h.group_key = f.group_key AND h.n > f.n AND (h.n - f.n)::BIGINT * 10800 >= h.pause) AS n FROM fired f WHERE f.n IS NOT NULL)
SELECT j.rule_id, j.group_key, make_timestamp(j.n * 10800000000) AS evaluated_at, CASE WHEN few THEN 'insufficient_samples' WHEN NOT hit THEN 'ok' WHEN f.n IS NOT NULL THEN 'triggered' ELSE 'suppressed' END AS status, CASE WHEN NOT few THEN round(x, 10) END AS value, k AS sample_size,
CASE WHEN hit AND f.n IS NULL THEN make_timestamp(((SELECT max(g.n) FROM fired g WHERE g.rule_id = j.rule_id AND g.group_key = j.group_key AND g.n < j.n) * 10800::BIGINT + pause) * 1000000) END AS suppressed_until
FROM j LEFT JOIN fired f ON f.rule_id = j.rule_id AND f.group_key = j.group_key AND f.n = j.n"""


@query(ALERT_STATES)
def alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.evaluate(_t(spark, sf_dir, "events"), RULES, "ts", "value", F.col("event_type") == "error", every=10800)
    return found.withColumns({"value": F.round("value", 10), **{c: F.col(c).cast("timestamp_ntz") for c in ("evaluated_at", "suppressed_until")}})


@query(f"""WITH {GAPS}, i AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM gaps)
SELECT a.event_id, round(sum(b.value * pow(0.75::DOUBLE, a.i - b.i)) / sum(CASE WHEN b.value IS NOT NULL THEN pow(0.75::DOUBLE, a.i - b.i) END), 6) AS ewm FROM i a JOIN i b ON b.i BETWEEN a.i - 150 AND a.i GROUP BY a.event_id""")
def ewm_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, in ranges: what is over 150 rows away weighs under 1e-18."""
    found = windows.ewm(_gaps(spark, sf_dir).select("event_id", "value"), "value", [], ["event_id"], alpha=0.25, ranges=8)
    return found.select("event_id", F.round("ewm", 6).alias("ewm"))
