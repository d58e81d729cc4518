"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, cut, join_small, n_words

WEIGHTS = (3, 1, 2)


def sainte_lague(parties: DataFrame, weight: str, seats: str, group: Sequence[str], name: Sequence[str]) -> DataFrame:
    """Adds `quota`: the integer seats of each party by highest quotients weight / (2 s - 1).

    `seats` holds the seats of the party's whole group. A divisor that gives all N seats to k parties lies between
    W / (N + k/2) and W / (N - k/2), so only the seats between the two roundings are in question: about three
    quotients a party are ranked, never one per seat. Ties go to the first party by `name`. Parties without weight
    get none.
    """
    of = Window.partitionBy(*group)
    total, k, n = F.sum(weight).over(of), F.count(F.lit(1)).over(of), F.col(seats)
    share = F.when(total > 0, F.col(weight) / total).otherwise(0.0)
    sure = F.greatest(F.floor(share * (n - k / 2) - 0.5), F.lit(0)).cast("long")
    most = F.ceil(share * (n + k / 2) + 0.5).cast("long")
    open_ = (
        parties.withColumn("_sure", F.when(F.col(weight) > 0, sure).otherwise(0))
        .withColumn("_most", F.when(F.col(weight) > 0, most).otherwise(0))
        .withColumn("_left", n - F.sum("_sure").over(of))
        .withColumn("_seat", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))))
        .withColumn("_quotient", F.col(weight) / (2 * F.col("_seat") - 1))
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), *[F.col(c) for c in name], "_seat"))
    won = open_.withColumn("_won", (F.col("_seat").isNotNull() & (rank <= F.col("_left"))).cast("long"))
    return won.groupBy(*parties.columns).agg((F.first("_sure") + F.sum("_won")).alias("quota"))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of `sources` (source, source_size): `weights` repeat along the sources by code point, null last.

    All targets together are `share` times all sizes; no target is above `most` times its source's size, and what is
    cut off there is shared again by weight. With cap c and weight w the result is min(c, l w) for one level l; along
    the sources by rising c / w, l is the first (rest of the total) / (rest of the weights) that is no more than c / w.
    The windows here run over one row a source.
    """
    by_name, by_ratio = Window.partitionBy("_all").orderBy(F.col("source").asc_nulls_last()), Window.partitionBy("_all").orderBy("_ratio", "_rank")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy("_all")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    return (
        sources.withColumn("_all", F.lit(0))
        .withColumn("_rank", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"])
        .withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("weight")), F.col("_cap")))
        .select("source", "source_size", "weight", "target", F.col("_rank").alias("source_no"))
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 32, shard_docs: int = 5_000, seed: int = 17
) -> DataFrame:
    """How many words of each document of `docs` (doc_id, text, source) a mix of the sources takes.

    Words of a source lie in shards (by a seeded hash of doc_id, about `shard_docs` documents each), each of them one
    stream of its documents in seeded order, cut into blocks of `block` words. Sainte-Laguë gives whole blocks to the
    sources by their targets, then those of a source to its shards by size: integer quotas, and what a shard takes is
    its quota times `block` words. It takes the stream as often as it fits in, then blocks in seeded order, the last one
    in part. So a source takes its target to within about a block, and no document more than `most` times.

    Returns doc_id, size, source, source_size, target, taken and shard, a row for each row of `docs`. Other columns are
    ignored. A null text has size 0 and nothing taken; a null source is a source; repeated rows follow one another in
    the stream and count separately; an empty table gives no rows. The same rows give the same counts, however they are
    partitioned.
    """
    return _mixed(docs, weights, share, most, block, shard_docs, seed)[0].drop("_row", "_hash")


def _mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 32, shard_docs: int = 5_000, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """The rows of `mix` with their number `_row`, and by `_row` the places `_ranges` (lo, hi in words) of the chosen blocks."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash")))
    sources = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")).select("source", "source_size"), weights, share, most))
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("_docs")).withColumnRenamed("source", "_source")
    parties = sources.withColumn("_all", F.lit(0)).withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy("_all")) / block).cast("long"))
    quotas = sainte_lague(parties, "target", "_seats", ["_all"], ["source_no"]).withColumnRenamed("quota", "source_blocks")
    quotas = cut(
        quotas.join(counts, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_shards", F.ceil(F.col("_docs") / shard_docs))
        .select(F.col("source").alias("_source"), "source_no", "source_size", "target", "source_blocks", "_shards")
    )
    dealt = join_small(sized, quotas, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_order", F.xxhash64("doc_id", F.lit(seed)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("_shards")))
    stream = Window.partitionBy("source_no", "shard").orderBy("_order", "doc_id", "size", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_end", F.sum("size").over(stream)).drop("_source")
    dealt = cut(dealt.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "source_no", "source_size", "target", "source_blocks", "size", "shard", "_end", "_hash"))

    shards = dealt.groupBy("source_no", "shard", "target", "source_blocks").agg(F.max("_end").alias("_words"))
    shards = sainte_lague(shards, "_words", "source_blocks", ["source_no"], ["shard"])
    shards = (
        shards.withColumn("_budget", F.least(F.col("quota") * block, (F.lit(float(most)) * F.col("_words")).cast("long")))
        .withColumn("_times", F.when(F.col("_words") > 0, F.floor(F.col("_budget") / F.col("_words"))).otherwise(0))
        .withColumn("_rest", F.col("_budget") - F.col("_times") * F.col("_words"))
        .select("source_no", "shard", "_words", "_times", "_rest")
    )
    shards = cut(shards)

    by_seed = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64("source_no", "shard", "_block", F.lit(seed + 2)), "_block")
    by_place = Window.partitionBy("source_no", "shard").orderBy("_block")
    blocks = (
        shards.filter("_rest > 0")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_words") - 1) / block))))
        .repartition("source_no", "shard")
        .withColumn("_length", F.least(F.lit(block), F.col("_words") - F.col("_block") * block))
        .withColumn("_before", F.sum("_length").over(by_seed) - F.col("_length"))
        .withColumn("_take", F.least(F.col("_length"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before"))))
        .withColumn("_sum", F.sum("_take").over(by_place) - F.col("_take"))
        .select("source_no", "shard", "_block", "_take", "_sum")
    )
    # Words chosen before a place x of the stream, at a document's start and end: two look-ups a document.
    at = dealt.withColumn("_ends", F.array(F.col("_end") - F.col("size"), F.col("_end"))).select("*", F.posexplode("_ends").alias("_side", "_at"))
    at = at.withColumn("_block", F.floor(F.col("_at") / block)).drop("_ends")
    last = shards.select("source_no", "shard", F.col("_words").alias("_w"), "_times", "_rest")
    at = at.join(blocks, ["source_no", "shard", "_block"], "left")
    at = join_small(at, last, ["source_no", "shard"])
    chosen = F.when(F.col("_at") >= F.col("_w"), F.col("_rest")).otherwise(
        F.coalesce(F.col("_sum") + F.least(F.col("_take"), F.col("_at") - F.col("_block") * block), F.lit(0))
    )
    taken = F.sum(F.when(F.col("_side") == 1, chosen).otherwise(-chosen)) + F.first("_times") * F.col("size")
    counted = at.groupBy("_row", "_hash", "doc_id", "source", "source_size", "target", "size", "shard").agg(taken.cast("long").alias("taken")).select(
        "_row", "_hash", "doc_id", "size", "source", "source_size", "target", "taken", "shard"
    )
    begin, first = F.col("_end") - F.col("size"), F.col("_block") * block
    parts = dealt.filter("size > 0").select("*", F.explode(F.sequence(F.floor(begin / block), F.floor((F.col("_end") - 1) / block))).alias("_block"))
    parts = parts.join(blocks.filter("_take > 0"), ["source_no", "shard", "_block"])
    parts = parts.select("_row", (F.greatest(begin, first) - begin).alias("lo"), (F.least(F.col("_end"), first + F.col("_take")) - begin).alias("hi")).filter("lo < hi")
    return counted, parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_ranges"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with the words that `mix` takes: whole copies, and a copy with the text of the chosen blocks only.

    So the words of a source are those that `mix` gives it. Words keep the white space before them, but for the first
    of a copy; other columns, whatever their names, stay as they are. Rows of one id, source and size are told
    apart by their texts; texts without words are not taken; an empty table gives no rows.
    """
    taken, ranges = _mixed(docs, **options)
    chosen = F.coalesce(F.aggregate("_ranges", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"]), F.lit(0))
    copies = taken.filter("size > 0").join(ranges, "_row", "left").withColumn("_copies", F.floor((F.col("taken") - chosen) / F.col("size")).cast("int"))
    alike = Window.partitionBy("doc_id", "source", "size")
    copies = cut(copies.select("doc_id", "source", "size", "_copies", "_ranges", F.row_number().over(alike.orderBy("_hash", "_row")).alias("_number")))
    repeated = not copies.filter("_number > 1").isEmpty()
    copies = copies.filter("_copies > 0 OR _ranges IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_of"), "_copies", "_ranges", F.col("_number").alias("_no"))
    sized = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("text").alias("_text"), n_words(F.col("text")).alias("_size"))
    number = F.row_number().over(Window.partitionBy("_doc_id", "_source", "_size").orderBy(F.xxhash64("_text"))) if repeated else F.lit(1)
    same = F.col("_doc_id").eqNullSafe(F.col("_id")) & F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_size") == F.col("_of")) & (F.col("_number") == F.col("_no"))
    found = join_small(sized.withColumn("_number", number), copies, same, most=100_000)
    found = found.withColumn("_copy", F.explode(F.sequence(F.when(F.col("_ranges").isNotNull(), 0).otherwise(1), F.col("_copies"))))
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    cuts = lambda w: F.flatten(F.transform("_ranges", lambda x: F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int"))))
    part = F.regexp_replace(F.array_join(F.transform(F.array(words), cuts)[0], ""), r"^[\x20\x09-\x0D]+", "")
    text = F.when(F.col("_copy") == 0, part).otherwise(F.col("_text")).alias("text")
    return found.select(*[text if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
