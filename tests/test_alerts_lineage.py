"""Alert rules in batches and streams; lineage of columns."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tidewater.operators import alerts, column_lineage

RULES = [
    alerts.Rule("rate", "error_rate", "gte", 50, window=60, suppression=40, min_samples=2, dimensions=("module",)),
    alerts.Rule("all", "count", "gt", 1, window=20, suppression=0),
    alerts.Rule("mean", "avg_duration_ms", "lte", 5, window=20, suppression=100, where="module != 'b'"),
]
EVENTS = [(100, "a", "error", 4.0), (103, "a", "ok", 6.0), (110, "b", "error", None), (111, None, "error", float("nan")), (120, "a", "error", 1.0), (120, "a", "error", 1.0), (147, "b", "error", 9.0), (158, "b", "error", 2.0), (195, "a", "ok", 3.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "at long, module string, status string, took double").withColumn("ts", F.timestamp_seconds("at"))


def rows_of(df):
    return sorted((r.rule_id, r.group_key, int(r.at), r.status, r.value, r.sample_size, r.until) for r in df.select("*", F.unix_seconds("evaluated_at").alias("at"), F.unix_seconds("suppressed_until").alias("until")).collect())


def expected():
    out = []
    for rule in RULES:
        last = {}
        for now in range(100, 201, 10):
            groups = {}
            for at, module, status, took in EVENTS:
                if now - rule.window <= at <= now and (rule.id != "mean" or module not in ("b", None)):
                    groups.setdefault(f"module={module or ''}" if rule.dimensions else "__all__", []).append((status, took))
            for key, found in (groups or {"__all__": []}).items():
                value, status, until = None, "insufficient_samples", None
                if len(found) >= rule.min_samples:
                    errors, known = sum(s == "error" for s, _ in found), [t for _, t in found if t is not None and t == t]
                    value = {"rate": 100 * errors / max(1, len(found)), "all": float(len(found)), "mean": sum(known) / len(known) if known else None}[rule.id]
                    status = "ok"
                    if value is not None and {"rate": value >= 50, "all": value > 1, "mean": value <= 5}[rule.id]:
                        status = "triggered"
                        if key in last and now - last[key] < rule.suppression:
                            status, until = "suppressed", last[key] + rule.suppression
                        else:
                            last[key] = now
                out.append((rule.id, key, now, status, value, len(found), until))
    return sorted(out, key=str)


def test_alerts_by_hand(spark):
    got = rows_of(alerts.evaluate(frame(spark, EVENTS), RULES, "ts", "took", F.col("status") == "error", every=10))
    assert sorted(got, key=str) == expected()
    assert {r[3] for r in got} == {"insufficient_samples", "ok", "triggered", "suppressed"}
    assert alerts.evaluate(frame(spark, []), RULES, "ts", "took", F.col("status") == "error", every=10).count() == 0
    with pytest.raises(ValueError):
        alerts.Rule("x", metric="sum")


def test_alert_stream_gives_the_rows_of_the_batch(spark):
    source, sink, state = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    events = EVENTS + [(1000, "z", "ok", 1.0), (2000, "z", "ok", 1.0)]
    batch = [r for r in rows_of(alerts.evaluate(frame(spark, events), RULES, "ts", "took", F.col("status") == "error", every=10)) if r[5] > 0]
    for n, part in enumerate((events[:3], events[3:6], events[6:9], events[9:10], events[10:])):
        frame(spark, part).coalesce(1).write.parquet(f"{source}/in", mode="append")
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(f"{source}/in")
        done = alerts.evaluate_stream(stream, RULES, "ts", "took", F.col("status") == "error", every=10)
        query = done.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()  # each round is a restart: state comes back from the checkpoint
    got = rows_of(spark.read.parquet(sink))
    closed = 1000
    assert [r for r in got if r[2] < closed] == [r for r in batch if r[2] < closed]


def entity(spark, rows):
    column = "struct<name:string,type:string,description:string,tags:array<string>,meta:map<string,string>>"
    return spark.createDataFrame(rows, f"unique_id string, columns array<{column}>, depends_on array<string>")


def test_column_matches_by_hand(spark):
    a = [("Order_ID", "INT", "the id", ["k", "K"], {"x": "1", "y": "2"}), ("total  amount", "decimal (10,2)", None, None, None), ("%%", None, None, None, None)]
    b = [("order_id", "text", None, None, None), ("order-id", "int", "an id", ["k"], {"x": "1", "y": "3"}), ("order_id_raw", "bigint", None, [None], {}), ("amount", "decimal(10,2)", "id", None, None), ("other", "INT", None, None, None)]
    df = entity(spark, [("a", a, None), ("b", b, ["a", "a", "gone"]), ("c", None, ["b"])])
    got = {(r.from_column, r.to_column): (round(r.confidence, 6), r.reasons) for r in column_lineage.matches(df).collect()}
    assert got == {
        ("Order_ID", "order_id"): (1.0, ["exact_name"]),
        ("Order_ID", "order-id"): (round(min(1, 0.94 + 0.08 + 0.06 + 0.02 + 0.01), 6), ["normalized_name", "data_type_match", "tag_overlap", "meta_overlap", "description_overlap"]),
        ("Order_ID", "order_id_raw"): (round(2 / 3 * 0.4 + 0.38 + 0.12 + 0.03, 6), ["token_overlap", "prefix_suffix_overlap", "data_type_partial_match"]),
        ("total  amount", "amount"): (round(0.2 + 0.38 + 0.12 + 0.08, 6), ["token_overlap", "prefix_suffix_overlap", "data_type_match"]),
    }
    assert len(column_lineage.matches(df, most=1).collect()) == 2
    every = column_lineage.matches(df, least=0.0, most=10).collect()
    assert len(every) == 15 and {r.from_column for r in column_lineage.matches(df, upstream=True).collect()} == {"order_id", "order-id", "order_id_raw", "amount"}


def test_paths_keep_the_surest_way(spark):
    """x_y reaches z directly (less sure) and over m (surer, a level later)."""
    c = lambda name: [(name, None, None, None, None)]
    df = entity(spark, [("s", c("x_y"), []), ("m", c("X_Y"), ["s"]), ("z", c("x_y"), ["m", "n"]), ("n", c("x_y_w"), ["s"]), ("t", c("x_y_w"), ["z"])])
    start = spark.createDataFrame([("s", "X_Y")], "unique_id string, column string")
    nodes, edges = column_lineage.paths(df, start, depth=3)
    part = round(2 / 3 * 0.4 + 0.38 + 0.12, 6)
    assert {(r.unique_id, r.depth, round(r.confidence, 6), r.confidence_label) for r in nodes.collect()} == {("s", 0, 1.0, "high"), ("m", 1, 1.0, "high"), ("n", 1, part, "medium"), ("z", 2, 1.0, "high"), ("t", 3, part, "medium")}
    assert {(r.from_id, r.to_id, r.depth, round(r.path_confidence, 6), r.matched_by) for r in edges.collect()} == {
        ("s", "m", 1, 1.0, "exact_name"), ("s", "n", 1, part, "token_overlap"), ("m", "z", 2, 1.0, "exact_name"), ("n", "z", 2, part, "token_overlap"), ("z", "t", 3, part, "token_overlap"),
    }
    up, _ = column_lineage.paths(df, spark.createDataFrame([("t", "x_y_w"), ("gone", "a")], "unique_id string, column string"), depth=1, upstream=True)
    assert {(r.unique_id, r.depth) for r in up.collect()} == {("t", 0), ("z", 1)}


def test_paths_send_no_table_to_the_driver(spark, monkeypatch):
    plans, cut = [], column_lineage._cut
    monkeypatch.setattr(column_lineage, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    models = spark.range(1, 200).selectExpr("concat('m.', id) AS unique_id", "array(named_struct('name', 'part_id')) AS columns", "array(concat('m.', id div 2)) AS depends_on")
    nodes, _ = column_lineage.paths(models, models.select("unique_id", F.lit("part_id").alias("column")), depth=2)
    assert nodes.count() == 199 + 198 + 196
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
