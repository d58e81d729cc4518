"""Lineage of columns: likely counterparts along the edges of entities, and the best paths over them.

Entities are those of `tidewater.operators.manifest`. The structs of `columns` have a name and may have type,
description, tags (array of strings) and meta (map of a dotted path to its JSON value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.graphs import _cut
from tidewater.operators.manifest import edges_of

#: Fixed values of the score: names equal but for marks; shares of token likeness; what else adds to a name.
SAME_NAME, JACCARD, CONTAINMENT, AFFIX = 0.94, 0.4, 0.38, 0.12
SAME_TYPE, PART_OF_TYPE = 0.08, 0.03
TAGS, META, META_EACH, WORDS, WORDS_EACH = 0.06, 0.05, 0.02, 0.04, 0.01
HIGH, MEDIUM = 0.85, 0.65
NO_TEXTS = "array<string>"
#: Joins are sort-merge joins: columns are many times larger than Spark takes them to be by the size of the files, and would be sent whole to the driver for a broadcast.
MERGE = "merge"


def name_key(name: Column) -> Column:
    """A name in lower case with anything but letters, digits and underscores as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def label(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def _features(entity: DataFrame) -> DataFrame:
    """unique_id and `f`, for each column what the score looks at."""
    has = set(entity.schema["columns"].dataType.elementType.names)

    def of(c: Column) -> Column:
        text = lambda k: F.coalesce(c[k], F.lit("")) if k in has else F.lit("")
        filled = lambda found: F.array_distinct(F.filter(found, lambda t: t != ""))
        tags = F.transform(F.coalesce(c["tags"], F.array().cast(NO_TEXTS)), lambda t: F.lower(F.trim(t))) if "tags" in has else F.array().cast(NO_TEXTS)
        meta = F.map_entries(c["meta"]) if "meta" in has else F.array().cast("array<struct<key:string,value:string>>")
        return F.struct(
            text("name").alias("name"), F.lower(text("name")).alias("lower"), name_key(text("name")).alias("key"), filled(F.split(name_key(text("name")), "_")).alias("tokens"),
            F.regexp_replace(F.lower(text("type")), r"\s+", "").alias("type"), filled(F.filter(tags, lambda t: t.isNotNull())).alias("tags"),
            F.coalesce(meta, F.array().cast("array<struct<key:string,value:string>>")).alias("meta"), filled(F.split(F.lower(text("description")), "[^a-z0-9_]+")).alias("words"),
        )

    return entity.select("unique_id", F.transform(F.coalesce("columns", F.array().cast(entity.schema["columns"].dataType)), of).alias("f"))


def _score(a: Column, b: Column) -> tuple[Column, Column]:
    """(confidence, reasons) that two columns are the same."""
    n = lambda x: F.size(x).cast("double")
    common = lambda k: n(F.array_intersect(a[k], b[k]))
    zero = F.lit(0.0)
    shared, least = common("tokens"), F.greatest(F.lit(1.0), F.least(n(a["tokens"]), n(b["tokens"])))
    affix = F.startswith(a["key"], b["key"]) | F.startswith(b["key"], a["key"]) | F.endswith(a["key"], b["key"]) | F.endswith(b["key"], a["key"])
    alike = shared / (n(a["tokens"]) + n(b["tokens"]) - shared) * JACCARD + shared / least * CONTAINMENT + F.when(affix, AFFIX).otherwise(zero)
    same = (a["key"] != "") & (a["key"] == b["key"])
    name = F.when(same, SAME_NAME).when(shared > 0, alike).otherwise(zero)
    typed = (a["type"] != "") & (b["type"] != "")
    part = F.contains(a["type"], b["type"]) | F.contains(b["type"], a["type"])
    kind = F.when(typed & (a["type"] == b["type"]), SAME_TYPE).when(typed & part, PART_OF_TYPE).otherwise(zero)
    tags = F.when(common("tags") > 0, F.least(F.lit(TAGS), common("tags") / F.greatest(n(a["tags"]), n(b["tags"])) * TAGS)).otherwise(zero)
    meta, words = F.least(F.lit(META), common("meta") * META_EACH), F.least(F.lit(WORDS), common("words") * WORDS_EACH)
    exact = a["lower"] == b["lower"]
    confidence = F.when(exact, 1.0).otherwise(F.least(F.lit(1.0), name + kind + tags + meta + words))
    said = {
        "normalized_name": same, "token_overlap": ~same & (shared > 0), "prefix_suffix_overlap": ~same & (shared > 0) & affix, "data_type_match": kind == SAME_TYPE,
        "data_type_partial_match": kind == PART_OF_TYPE, "tag_overlap": tags > 0, "meta_overlap": meta > 0, "description_overlap": words > 0,
    }
    reasons = F.array_compact(F.array(*[F.when(when, F.lit(k)) for k, when in said.items()]))
    return confidence, F.when(exact, F.array(F.lit("exact_name"))).otherwise(reasons)


def matches(entity: DataFrame, least: float = 0.55, most: int = 3, upstream: bool = False) -> DataFrame:
    """from_id, from_column, to_id, to_column, confidence, reasons: of each column and each neighbour of its entity the likeliest `most` columns.

    Neighbours are what depends on an entity, or what it depends on with `upstream`. Only pairs of `least` confidence or
    more are kept; ties go to the smaller name. Columns meet within an edge of two entities, so work follows the columns
    of neighbours, not those of all entities. Columns without a name match nothing; names differ without regard to case.
    """
    edges = edges_of(entity).select(F.col("dst" if upstream else "src").alias("from_id"), F.col("src" if upstream else "dst").alias("to_id"))
    features = _features(entity)
    both = edges.join(features.toDF("from_id", "_a").hint(MERGE), "from_id").join(features.toDF("to_id", "_b").hint(MERGE), "to_id")
    able = lambda a, b: (a["name"] != "") & (b["name"] != "") & ((a["lower"] == b["lower"]) | F.arrays_overlap(a["tokens"], b["tokens"]) | F.lit(least <= SAME_TYPE + TAGS + META + WORDS))
    pairs = F.flatten(F.transform("_a", lambda a: F.transform(F.filter("_b", lambda b: able(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = both.select("from_id", "to_id", F.explode(pairs).alias("p")).select("from_id", "to_id", "p.a", "p.b")
    confidence, reasons = _score(F.col("a"), F.col("b"))
    scored = rows.select("from_id", F.col("a.name").alias("from_column"), "to_id", F.col("b.name").alias("to_column"), confidence.alias("confidence"), reasons.alias("reasons"))
    order = Window.partitionBy("from_id", F.lower("from_column"), "to_id").orderBy(F.desc("confidence"), "to_column")
    return scored.filter(F.col("confidence") >= least).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def paths(entity: DataFrame, start: DataFrame, depth: int = 2, least: float = 0.55, most: int = 3, upstream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within `depth` steps of each column of `start` (unique_id, column): the lineage of each one by itself.

    A path is as sure as its least sure match. Columns are visited level by level: a column goes on from its least
    depth, with the best confidence that it has there, and all columns of a level take one join. Nodes are origin_id,
    origin_column, unique_id, column, depth, confidence and confidence_label: the best confidence at which a column was
    reached, even at a later level, and the least depth that has it. Edges are origin_id, origin_column, depth, from_id,
    from_column, to_id, to_column, confidence, path_confidence, confidence_label, matched_by and reasons.
    """
    origin = ["origin_id", "origin_column"]
    steps = _cut(matches(entity, least, most, upstream).withColumn("_from", F.lower("from_column")))
    known = entity.select("unique_id", F.explode("columns.name").alias("column"))
    begun = start.select("unique_id", F.lower("column").alias("_c")).distinct().join(known.withColumn("_c", F.lower("column")).hint(MERGE), ["unique_id", "_c"])
    front = begun.select(F.col("unique_id").alias("origin_id"), F.col("column").alias("origin_column"), "unique_id", "column", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    front = seen = nodes = _cut(front)
    edges = None
    for d in range(1, depth + 1):
        at = front.select(*origin, F.col("unique_id").alias("from_id"), F.lower("column").alias("_from"), F.col("confidence").alias("_sure"))
        step = at.join(steps.hint(MERGE), ["from_id", "_from"])
        step = step.select(*origin, F.lit(d).alias("depth"), "from_id", "from_column", "to_id", "to_column", "confidence", F.least("_sure", "confidence").alias("path_confidence"), "reasons")
        step = _cut(step)
        edges = step if edges is None else edges.unionByName(step)
        reached = step.groupBy(*origin, F.col("to_id").alias("unique_id"), F.col("to_column").alias("column")).agg(F.lit(d).alias("depth"), F.max("path_confidence").alias("confidence"))
        nodes = nodes.unionByName(reached.select(nodes.columns))
        front = _cut(reached.join(seen.select(*origin, "unique_id", "column").hint(MERGE), [*origin, "unique_id", "column"], "left_anti").select(nodes.columns))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    best = nodes.groupBy(*origin, "unique_id", "column").agg(F.max(F.struct("confidence", (-F.col("depth")).alias("d"))).alias("b"))
    nodes = best.select(*origin, "unique_id", "column", (-F.col("b.d")).alias("depth"), F.col("b.confidence").alias("confidence"), label(F.col("b.confidence")).alias("confidence_label"))
    edges = edges if edges is not None else steps.limit(0)
    return nodes, edges.withColumns({"confidence_label": label(F.col("confidence")), "matched_by": F.element_at("reasons", 1)})
