"""Entries and changes of artifacts; records that are unlike the first."""

import json

import pytest

from tidewater.operators import artifacts, schema


def rows(spark, kind, *bodies):
    texts = [(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return artifacts.entries(spark.createDataFrame(texts, "run int, body string"), "body", kind, ["run"])


def test_entries_of_results(spark):
    good = {"unique_id": " a ", "status": "PASS", "execution_time": "2.5", "timing": [{"z": 1, "a": [2]}], "failures": None, "message": 5}
    found = rows(spark, "run_results", {"results": [good, {"unique_id": "A", "status": ""}, {"status": "x"}, 7, None, {"unique_id": "b"}]}, {"results": {}}, "not json", None, [], {"results": [good]}).collect()
    got = {(r.run, r.unique_id): r.fields for r in found}
    none = {"status": "unknown", "executionTime": "0.0", "threadId": "", "message": "", "failures": "0.0", "timing": "[]"}
    assert got == {(0, "A"): none, (0, "b"): none, (5, "a"): none | {"status": "pass", "executionTime": "2.5", "timing": '[{"a":[2],"z":1}]'}}
    counts = artifacts.status_counts(rows(spark, "run_results", {"results": [good, {"unique_id": "b", "status": "Pass "}]})).collect()
    assert [tuple(r) for r in counts] == [("pass", 2)]


def test_entries_of_catalogs_and_sources(spark):
    node = {"unique_id": "n", "resource_type": "Model", "alias": "al", "path": "p", "columns": {"B": {"name": "b", "data_type": "int"}, "a": {"type": "text", "data_type": "no"}, "c": 3}}
    body = {"nodes": {"n": node, "odd": 3}, "sources": {"s": {"unique_id": "s", "identifier": "i", "original_file_path": "f", "path": "p"}}}
    got = {r.unique_id: r.fields for r in rows(spark, "catalog", body).collect()}
    assert set(got) == {"n", "s"} and got["n"]["resourceType"] == "model" and got["s"]["resourceType"] == "source"
    assert [got["n"][k] for k in ("section", "identifier", "columnCount", "path")] == ["nodes", "al", "3", "p"] and [got["s"][k] for k in ("section", "identifier", "columnCount", "path")] == ["sources", "i", "0", "f"]
    assert json.loads(got["n"]["columns"]) == [{"key": "a", "name": "a", "dataType": "text"}, {"key": "b", "name": "b", "dataType": "int"}]
    found = rows(spark, "sources", {"results": [{"unique_id": "s", "status": "warn", "max_loaded_at": "t"}]}).first()
    assert found.fields["maxLoadedAt"] == "t" and found.fields["snapshottedAt"] == ""
    with pytest.raises(ValueError):
        rows(spark, "manifest", {})


def test_changes(spark):
    entry = lambda i, **more: {"unique_id": i, "status": "ok", **more}
    left = rows(spark, "run_results", {"results": [entry("a"), entry("b"), entry("c", timing=[{"x": 1, "y": 2}])]}, {"results": [entry("a")]})
    right = rows(spark, "run_results", {"results": [entry("b", status="error", failures=2), entry("c", timing=[{"y": 2, "x": 1}]), entry("d")]})
    every = artifacts.compare(left, right, ["run"], artifacts.CHANGES)
    got = {(r.run, r.unique_id): (r.change_type, r.fields_changed) for r in every.collect()}
    assert got == {(0, "a"): ("removed", []), (0, "b"): ("changed", ["failures", "status"]), (0, "c"): ("unchanged", []), (0, "d"): ("added", []), (1, "a"): ("removed", [])}
    sums = {r.run: tuple(r)[1:] for r in artifacts.summary(every, ["run"]).collect()}
    assert sums == {0: (3, 3, 1, 1, 1, 1), 1: (1, 0, 0, 1, 0, 0)}
    assert artifacts.compare(left, right, ["run"]).count() == 4 and artifacts.compare(left.limit(0), right.limit(0), ["run"]).count() == 0
    assert {r.change_type for r in artifacts.compare(left, right, ["run"], ["added"]).collect()} == {"added"}
    with pytest.raises(ValueError):
        artifacts.compare(left, right, ["run"], ["moved"])


def test_unlike_records(spark):
    first = {"id": 1, "name": "x", "tags": [1], "more": {}, "on": True, "gone": None}
    others = [first | {"id": 2.5}, {k: v for k, v in first.items() if k != "on"}, {**{k: v for k, v in first.items() if k != "on"}, "off": True}, first | {"gone": 0}, first | {"tags": {}, "name": None}, [first]]
    texts = [json.dumps(x) for x in [first, *others]] + ["{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "at int, r string")
    got = {r["at"]: tuple(r)[1:] for r in schema.inconsistencies(df, "r", ["at"]).collect()}
    assert got == {
        2: ("key_count", None, "6", "5"), 3: ("missing_key", "on", "boolean", None), 4: ("type", "gone", "null", "number"), 5: ("type", "name", "string", "null"),
        6: ("not_object", None, "object", "array"), 7: ("not_object", None, "object", "invalid"), 8: ("not_object", None, "object", "invalid"),
    }
    assert schema.inconsistencies(df.limit(0), "r", ["at"]).count() == 0
