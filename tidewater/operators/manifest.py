"""Catalogues of data entities: search, filters, lineage of columns, differences, impact and coverage.

Entities are rows of unique_id, name, resource_type, path, description, tags (array), meta (JSON text), columns
(array of name, type, description), depends_on (array of unique_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.fuzzy import tokens
from tidewater.operators.graphs import reach
from tidewater.operators.missing import truth

#: Points for a token found in a part of an entity, and for the whole id (fixed values).
POINTS = {"id": 40, "name": 30, "path": 20, "type": 15, "tag": 15, "description": 10}
WHOLE_ID = 100


def entities(manifests: DataFrame, section: str = "nodes") -> DataFrame:
    """Rows of a section of manifests: a map of unique_id to the entity."""
    return manifests.select(F.explode(section).alias("unique_id", "_e")).select("unique_id", "_e.*")


def columns_of(entity: DataFrame) -> DataFrame:
    """unique_id, name, type, description of each column."""
    return entity.select("unique_id", F.explode("columns").alias("c")).select("unique_id", "c.name", "c.type", "c.description")


def edges_of(entity: DataFrame) -> DataFrame:
    """src (depended on) and dst (depends), once each."""
    return entity.select(F.explode("depends_on").alias("src"), F.col("unique_id").alias("dst")).distinct()


def postings(entity: DataFrame) -> DataFrame:
    """unique_id, token, points: the index that search uses, each token of each part once."""
    parts = {"id": "unique_id", "name": "name", "path": "path", "type": "resource_type", "description": "description"}

    def worth(found: Column, part: str) -> Column:
        return F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("token"), F.lit(POINTS[part]).alias("points")))

    of = [worth(tokens(F.coalesce(F.col(c), F.lit(""))), k) for k, c in parts.items()]
    tags = worth(F.flatten(F.transform(F.coalesce("tags", F.array().cast("array<string>")), tokens)), "tag")
    return entity.select("unique_id", F.explode(F.concat(*of, tags)).alias("p")).groupBy("unique_id", "p.token").agg(F.sum("p.points").alias("points"))


def search(entity: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, unique_id, score for `queries` (query_id, text): points of the tokens found, and those of a whole id."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    hits = asked.join(postings(entity), "token").groupBy("query_id", "unique_id").agg(F.sum("points").alias("score"))
    whole = queries.select("query_id", F.lower(F.trim("text")).alias("_id")).join(entity.select("unique_id", F.lower("unique_id").alias("_id")), "_id").select("query_id", "unique_id", F.lit(WHOLE_ID).cast("long").alias("score"))
    return hits.unionByName(whole).groupBy("query_id", "unique_id").agg(F.sum("score").alias("score"))


def tagged(entity: DataFrame, tags: Sequence[str], every: bool = False) -> DataFrame:
    """Entities with any, or with every one, of the tags."""
    wanted = F.array(*[F.lit(t) for t in tags])
    return entity.filter(F.size(F.array_except(wanted, "tags")) == 0 if every else F.arrays_overlap("tags", wanted))


def meta_where(entity: DataFrame, path: str, op: str, value: str | Sequence[str] | None = None) -> DataFrame:
    """Entities whose meta value at a dotted path exists, is eq, neq, contains or is in `value`."""
    at = F.get_json_object("meta", "$." + path)
    tests = {"exists": lambda: at.isNotNull(), "eq": lambda: at == value, "neq": lambda: ~truth(at == value), "contains": lambda: at.contains(value), "in": lambda: at.isin(*value)}
    return entity.filter(truth(tests[op]()))


def get(entity: DataFrame, unique_id: str) -> DataFrame:
    """One entity by its id, in any case."""
    return entity.filter(F.lower("unique_id") == unique_id.lower())


def get_column(entity: DataFrame, unique_id: str, column: str) -> DataFrame:
    return columns_of(get(entity, unique_id)).filter(F.lower("name") == column.lower())


def listing(entity: DataFrame) -> DataFrame:
    """Number of entities of each type."""
    return entity.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


def violations(entity: DataFrame) -> DataFrame:
    """unique_id and problem: no name, an id more than once, a dependence on what is not there."""
    known = entity.select("unique_id")
    nameless = entity.filter(F.coalesce("name", F.lit("")) == "").select("unique_id", F.lit("no name").alias("problem"))
    twice = known.groupBy("unique_id").count().filter("count > 1").select("unique_id", F.lit("repeated").alias("problem"))
    lost = edges_of(entity).join(known.withColumnRenamed("unique_id", "src"), "src", "left_anti").select(F.col("dst").alias("unique_id"), F.lit("unknown dependence").alias("problem"))
    return nameless.unionByName(twice).unionByName(lost.distinct())


def _digest(entity: DataFrame) -> Column:
    fields = [c for c in entity.columns if c != "unique_id"]
    return F.sha2(F.to_json(F.struct(*[F.array_sort(c) if c in ("tags", "depends_on") else F.col(c) for c in fields])), 256)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """unique_id, state (added, removed, modified, unchanged) and the names of columns that came and went."""
    names = F.transform("columns", lambda c: c["name"])
    a = old.select("unique_id", _digest(old).alias("_a"), names.alias("_ca"))
    b = new.select("unique_id", _digest(new).alias("_b"), names.alias("_cb"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    none = F.array().cast("array<string>")
    gone, come = F.array_except(F.coalesce("_ca", none), F.coalesce("_cb", none)), F.array_except(F.coalesce("_cb", none), F.coalesce("_ca", none))
    return a.join(b, "unique_id", "full").select("unique_id", state.alias("state"), F.array_sort(come).alias("columns_added"), F.array_sort(gone).alias("columns_removed"))


def changed_share(differences: DataFrame) -> DataFrame:
    """Share of entities that are not unchanged: beyond a limit an index is better rebuilt than mended."""
    return differences.agg((F.count_if(F.col("state") != "unchanged") / F.count(F.lit(1))).alias("share"))


def status_counts(results: DataFrame) -> DataFrame:
    """Number of results (unique_id, status) of each status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def impact(entity: DataFrame, start: DataFrame, depth: int, results: DataFrame) -> DataFrame:
    """What depends on `start` (node) within `depth` steps, with its status from `results` (unique_id, status)."""
    found = reach(edges_of(entity), start, depth)
    return found.join(results.withColumnRenamed("unique_id", "node"), "node", "left").select("node", "depth", F.coalesce("status", F.lit("none")).alias("status"))


def coverage(entity: DataFrame, tests: DataFrame) -> DataFrame:
    """Shares in percent of entities described, of columns described and of entities tested (`tests`: unique_id), and readiness."""
    described = lambda c: F.coalesce(c, F.lit("")) != ""
    tested = entity.join(tests.select("unique_id").distinct().withColumn("_t", F.lit(True)), "unique_id", "left")
    n_columns, n_described = F.sum(F.size("columns")), F.sum(F.size(F.filter("columns", lambda c: described(c["description"]))))
    share = lambda part, whole: F.when(whole > 0, F.round(100 * part / whole, 2)).otherwise(100.0)
    n = F.count(F.lit(1))
    row = tested.agg(share(F.count_if(described(F.col("description"))), n).alias("described"), share(n_described, n_columns).alias("columns_described"), share(F.count_if(truth(F.col("_t"))), n).alias("tested"))
    return row.withColumn("readiness", F.round(0.4 * F.col("described") + 0.3 * F.col("columns_described") + 0.3 * F.col("tested"), 2))


def owner(paths: Sequence[str] = ("owner", "team.owner")) -> Column:
    """The first owner in meta that is not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object("meta", "$." + p), F.lit("")) for p in paths])


def owners(entity: DataFrame, paths: Sequence[str] = ("owner", "team.owner")) -> DataFrame:
    """Number of entities of each owner; null for those without."""
    return entity.groupBy(owner(paths).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


def column_lineage(entity: DataFrame, least: float = 0.9) -> DataFrame:
    """Columns of an entity and of what it depends on that seem to be the same: 1 for equal names, 0.94 for equal ones but for case and marks."""
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "")
    has = columns_of(entity).select("unique_id", "name", plain.alias("_plain"))
    up = has.select(F.col("unique_id").alias("src"), F.col("name").alias("src_column"), "_plain")
    down = edges_of(entity).join(has.select(F.col("unique_id").alias("dst"), F.col("name").alias("dst_column"), "_plain"), "dst")
    score = F.when(F.col("src_column") == F.col("dst_column"), 1.0).otherwise(0.94)
    return down.join(up, ["src", "_plain"]).select("src", "src_column", "dst", "dst_column", score.alias("score")).filter(F.col("score") >= least)
