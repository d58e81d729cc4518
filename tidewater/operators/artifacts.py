"""Artifacts of runs as JSON: their entries as rows, and what changed between two versions, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("catalog", "run_results", "sources")
CHANGES = ("added", "removed", "changed", "unchanged")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    """A string at a path without space around it; "" for anything else."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(_kind(at) == "STRING", F.trim(F.try_variant_get(v, path, "string"))).otherwise("")


def _first_text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(_text(v, p), F.lit("")) for p in paths], F.lit(""))


def _number(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "double"), F.lit(0.0)).cast("string")


def _json(v: Column, path: str, absent: str) -> Column:
    """JSON with keys in order."""
    return F.coalesce(F.to_json(F.try_variant_get(v, path, "array<variant>")), F.lit(absent))


def _status(v: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(_text(v, "$.status")), F.lit("")), F.lit("unknown"))


def _columns(v: Column) -> Column:
    """Columns of a catalog entry as JSON: lower-case names in order, each with its name and type."""
    given = F.map_entries(F.coalesce(F.try_variant_get(v, "$.columns", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    objects = F.filter(given, lambda e: _kind(e["value"]).startswith("OBJECT"))
    named = F.transform(objects, lambda e: F.struct(F.coalesce(F.nullif(_text(e["value"], "$.name"), F.lit("")), e["key"]).alias("name"), _first_text(e["value"], "$.type", "$.data_type").alias("dataType")))
    return F.to_json(F.array_sort(F.transform(named, lambda c: F.struct(F.lower(c["name"]).alias("key"), c["name"].alias("name"), c["dataType"].alias("dataType")))))


def _fields(kind: str, v: Column, section: Column) -> dict[str, Column]:
    """What of an entry is compared, as text."""
    if kind == "catalog":
        size = F.size(F.coalesce(F.try_variant_get(v, "$.columns", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
        texts = {"packageName": ["package_name"], "name": ["name"], "path": ["original_file_path", "path"], "database": ["database"], "schema": ["schema"], "alias": ["alias"], "identifier": ["identifier", "alias"], "relationName": ["relation_name"]}
        fields = {name: _first_text(v, *[f"$.{p}" for p in paths]) for name, paths in texts.items()}
        resource = F.lower(F.coalesce(F.nullif(_text(v, "$.resource_type"), F.lit("")), F.when(section == "sources", "source").otherwise("")))
        return {"section": section, "resourceType": resource, "columnCount": size.cast("string"), "columns": _columns(v), **fields}
    shared = {"status": _status(v), "executionTime": _number(v, "$.execution_time"), "threadId": _text(v, "$.thread_id"), "message": _text(v, "$.message")}
    if kind == "run_results":
        return shared | {"failures": _number(v, "$.failures"), "timing": _json(v, "$.timing", "[]")}
    return shared | {"maxLoadedAt": _text(v, "$.max_loaded_at"), "snapshottedAt": _text(v, "$.snapshotted_at")}


def entries(artifacts: DataFrame, body: str, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """`by`, unique_id, fields (map of names to text): the entries of artifacts, JSON text in the column `body`.

    `by` tells artifacts apart. Of entries of one artifact whose ids are equal but for case the last stays (catalogs
    have sources after nodes). Entries that are no objects or have no id, and text that is no JSON, give no rows; absent
    fields are "", numbers 0, lists [] and a status "unknown".
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of artifact: {kind}")
    keys = [f"_by{i}" for i in range(len(by))]
    parsed = artifacts.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.try_parse_json(F.col(body)).alias("v"))

    def section(name: str, values: Column) -> Column:
        of_section = F.transform(values, lambda e: F.struct(F.lit(name).alias("section"), e.alias("v")))
        return F.coalesce(of_section, F.array().cast("array<struct<section:string,v:variant>>"))

    if kind == "catalog":
        listed = F.concat(*[section(s, F.map_values(F.try_variant_get("v", f"$.{s}", "map<string,variant>"))) for s in ("nodes", "sources")])
    else:
        listed = section("results", F.try_variant_get("v", "$.results", "array<variant>"))
    rows = parsed.select(*keys, F.posexplode(listed).alias("place", "e")).select(*keys, "place", "e.section", "e.v")
    v = F.col("v")
    fields = _fields(kind, v, F.col("section"))
    named = F.create_map(*[x for name, c in sorted(fields.items()) for x in (F.lit(name), c)])
    found = rows.filter(_kind(v).startswith("OBJECT")).select(*keys, "place", _text(v, "$.unique_id").alias("unique_id"), named.alias("fields")).filter("unique_id != ''")
    last = found.groupBy(*keys, F.lower("unique_id").alias("_key")).agg(F.max_by(F.struct("unique_id", "fields"), "place").alias("e"))
    return last.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "e.unique_id", "e.fields")


def status_counts(entry: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`by`, status, n of entries of results or sources."""
    return entry.groupBy(*by, F.col("fields")["status"].alias("status")).agg(F.count(F.lit(1)).alias("n"))


def compare(left: DataFrame, right: DataFrame, by: Sequence[str] = (), changes: Sequence[str] = CHANGES[:3]) -> DataFrame:
    """`by`, unique_id, change_type, fields_changed (sorted), left, right: entries of two versions, joined in full.

    Only rows whose change is one of `changes`; fields_changed is empty but for changed entries. `by` may be null.
    """
    wrong = set(changes) - set(CHANGES)
    if wrong:
        raise ValueError(f"unknown changes: {sorted(wrong)}")
    keys = [*by, "unique_id"]
    a, b = [side.select(*[F.col(k).alias(f"_{n}{i}") for i, k in enumerate(keys)], F.col("fields").alias(n)) for side, n in ((left, "left"), (right, "right"))]
    same = [F.col(f"_left{i}").eqNullSafe(F.col(f"_right{i}")) for i in range(len(keys))]
    both = a.join(b, same, "full")
    names = F.array_sort(F.array_union(F.map_keys("left"), F.map_keys("right")))
    differ = F.filter(names, lambda k: ~F.col("left")[k].eqNullSafe(F.col("right")[k]))
    differ = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), differ).otherwise(F.array().cast("array<string>"))
    change = F.when(F.col("left").isNull(), "added").when(F.col("right").isNull(), "removed").when(F.size("fields_changed") > 0, "changed").otherwise("unchanged")
    rows = both.withColumn("fields_changed", differ).withColumn("change_type", change).filter(F.col("change_type").isin(*changes))
    key = [F.when(F.col("left").isNull(), F.col(f"_right{i}")).otherwise(F.col(f"_left{i}")).alias(k) for i, k in enumerate(keys)]
    return rows.select(*key, "change_type", "fields_changed", "left", "right")


def summary(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`by`, left_count, right_count and numbers of each change; give it the comparison with all of `CHANGES`."""
    counts = [F.count_if(F.col("change_type") == c).alias(c) for c in CHANGES]
    return compared.groupBy(*by).agg(F.count("left").alias("left_count"), F.count("right").alias("right_count"), *counts)
