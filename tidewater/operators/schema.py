"""Schema contracts: columns with kinds, checked or enforced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.projection import CASTS, as_type


def enforce(df: DataFrame, contract: Mapping[str, str], keep_extra: bool = False) -> DataFrame:
    """Columns of the contract in its order, cast (what cannot be is null); missing ones are null, others go unless kept."""
    present = {n: t for n, t in contract.items() if n in df.columns and t != "mixed"}
    out = as_type(df, present).withColumns({n: F.lit(None).cast(CASTS.get(t, "string")) for n, t in contract.items() if n not in df.columns})
    return out.select(*contract, *[c for c in df.columns if keep_extra and c not in contract])


def _json_kind(v: Column) -> Column:
    """null, array, object, string, boolean or number."""
    name = F.schema_of_variant(v)
    named = F.when(name == "VOID", "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
    return named.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise("number")


def inconsistencies(df: DataFrame, record: str, order_by: Sequence[str]) -> DataFrame:
    """`order_by`, problem, key, expected, found: records (JSON text) that are unlike the first one in order.

    The first problem of a record: no object (`not_object`, found its kind or "invalid"), another number of keys
    (`key_count`), a key that is not there (`missing_key`), a value of another kind (`type`); keys in code-point order.
    No rows means that all agree. If the first record is no object, so is each one's problem: `not_object` for it alone,
    and the others are held against no keys. An empty table gives no rows.
    """
    v = F.try_parse_json(F.col(record))
    kinds = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: _json_kind(x))
    kind = F.when(v.isNull(), "invalid").otherwise(_json_kind(v))
    own = df.select(F.struct(*order_by).alias("_order"), kind.alias("_kind"), F.when(kind == "object", kinds).alias("_has"))
    first = own.agg(F.min_by("_has", "_order").alias("_first"))  # one row
    has, given = F.col("_has"), F.coalesce("_first", F.create_map().cast("map<string,string>"))
    keys = F.array_sort(F.map_keys(given))
    lost = F.get(F.filter(keys, lambda k: ~F.map_contains_key(has, k)), F.lit(0))
    other = F.get(F.filter(keys, lambda k: given[k] != has[k]), F.lit(0))

    def fault(problem: str, key: Column, expected: Column, found: Column) -> Column:
        return F.struct(F.lit(problem).alias("problem"), key.cast("string").alias("key"), expected.cast("string").alias("expected"), found.cast("string").alias("found"))

    none = F.lit(None)
    problem = F.when(F.col("_kind") != "object", fault("not_object", none, F.lit("object"), F.col("_kind")))
    problem = problem.when(F.size(given) != F.size(has), fault("key_count", none, F.size(given), F.size(has)))
    problem = problem.when(lost.isNotNull(), fault("missing_key", lost, given[lost], none)).when(other.isNotNull(), fault("type", other, given[other], has[other]))
    return own.crossJoin(F.broadcast(first)).withColumn("_p", problem).filter("_p IS NOT NULL").select("_order.*", "_p.*")


def violations(df: DataFrame, contract: Mapping[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """column, problem, rows: missing columns, values that cannot be cast, and nulls in required columns; one pass over the rows."""
    absent = [c for c in contract if c not in df.columns]
    checked = [c for c in contract if c in df.columns]
    cast = as_type(df.select(*[F.col(c) for c in checked], *[F.col(c).alias(f"_raw_{c}") for c in checked]), {c: contract[c] for c in checked if contract[c] != "mixed"})
    bad = [F.struct(F.lit(c).alias("column"), F.lit("cast").alias("problem"), F.count_if(F.col(c).isNull() & F.col(f"_raw_{c}").isNotNull()).alias("rows")) for c in checked]
    bad += [F.struct(F.lit(c).alias("column"), F.lit("null").alias("problem"), F.count_if(F.col(f"_raw_{c}").isNull()).alias("rows")) for c in checked if c in required]
    bad += [F.struct(F.lit(c).alias("column"), F.lit("missing").alias("problem"), F.count(F.lit(1)).alias("rows")) for c in absent]
    return cast.agg(F.array(*bad).alias("all")).select(F.explode("all").alias("v")).select("v.*").filter("rows > 0 OR problem = 'missing'")
