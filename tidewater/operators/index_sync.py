"""Keeping an index of chunks up to date: what has not changed is kept, what has changed takes over the vectors of equal chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.graphs import _cut


def fingerprint(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def sync_index(sources: DataFrame, old_sources: DataFrame, old_chunks: DataFrame, chunked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of the index after `sources` (source_id, revision, text, error) were taken in.

    `old_sources` are (source_id, revision, fingerprint), `old_chunks` (source_id, chunk_no, chunk, hash, embedding);
    `chunked` makes source_id, chunk_no, chunk out of source_id, text. In this order:

    1. A source with an error keeps what the index has of it (state failed).
    2. One of the revision that the index has is skipped; its text is not looked at (skipped). A null revision says nothing.
    3. One whose text has the same fingerprint is kept (unchanged).
    4. Others are chunked. Without chunks, what the index has is kept (empty). Else they are added or updated: the n-th
       chunk of a hash takes the embedding of the source's n-th old chunk of that hash, if it has one (reused); the rest
       is new, with a null embedding. Old chunks that were not taken are removed.
    5. Sources of the index that are not among `sources` are removed.

    Sources: source_id, state, revision, fingerprint, n_chunks, n_reused, n_added, n_removed; those that failed or were
    empty and that the index did not have are listed with no chunks. Chunks: source_id, chunk_no, chunk, hash,
    embedding, state (kept, reused, new). Each source_id stands once in either table of sources.
    """
    old = old_sources.select("source_id", F.col("revision").alias("_revision"), F.col("fingerprint").alias("_fingerprint"), F.lit(True).alias("_had"))
    live = sources.select("source_id", "revision", "error", fingerprint(F.col("text")).alias("fingerprint"), F.lit(True).alias("_live"))
    had = F.coalesce("_had", F.lit(False))
    state = (
        F.when(F.col("_live").isNull(), "removed").when(F.col("error").isNotNull(), "failed").when(had & F.coalesce(F.col("revision") == F.col("_revision"), F.lit(False)), "skipped")
        .when(had & (F.col("fingerprint") == F.col("_fingerprint")), "unchanged").when(had, "updated").otherwise("added")
    )
    judged = _cut(live.join(old, "source_id", "full").withColumn("state", state).drop("_live", "error"))
    anew = judged.filter("state IN ('added', 'updated')").select("source_id")
    made = _cut(chunked(sources.join(anew, "source_id", "left_semi").select("source_id", "text")).select("source_id", "chunk_no", "chunk", fingerprint(F.col("chunk")).alias("hash")))
    number = F.row_number().over(Window.partitionBy("source_id", "hash").orderBy("chunk_no"))
    before = old_chunks.join(anew, "source_id", "left_semi").select("source_id", "hash", "chunk_no", "embedding").withColumn("_nth", number)
    before = before.filter(F.size("embedding") > 0).select("source_id", "hash", "_nth", "embedding")
    fresh = _cut(made.withColumn("_nth", number).join(before, ["source_id", "hash", "_nth"], "left"))
    fresh = fresh.select("source_id", "chunk_no", "chunk", "hash", "embedding", F.when(F.col("embedding").isNull(), "new").otherwise("reused").alias("state"))
    counts = fresh.groupBy("source_id").agg(F.count(F.lit(1)).alias("_made"), F.count_if(F.col("state") == "reused").alias("_reused"))
    held = old_chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("_held"))
    both = judged.join(counts, "source_id", "left").join(held, "source_id", "left").fillna(0, ["_made", "_reused", "_held"])
    state = F.when(F.col("state").isin("added", "updated") & (F.col("_made") == 0), "empty").otherwise(F.col("state"))
    both = _cut(both.withColumn("state", state))
    rebuilt, gone = F.col("state").isin("added", "updated"), F.col("state") == "removed"
    kept_values = [F.when(rebuilt | F.col("state").isin("unchanged"), F.col(c)).when(F.col("state") == "skipped", F.col(f"_{c}") if c == "fingerprint" else F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("revision", "fingerprint")]
    done = both.select(
        "source_id", "state", *kept_values, F.when(rebuilt, F.col("_made")).when(gone, 0).otherwise(F.col("_held")).alias("n_chunks"),
        F.when(rebuilt, F.col("_reused")).otherwise(0).alias("n_reused"), F.when(rebuilt, F.col("_made") - F.col("_reused")).otherwise(0).alias("n_added"),
        F.when(rebuilt, F.col("_held") - F.col("_reused")).when(gone, F.col("_held")).otherwise(0).alias("n_removed"),
    )
    stays = both.filter("state IN ('failed', 'skipped', 'unchanged', 'empty')").select("source_id")
    kept = old_chunks.join(stays, "source_id", "left_semi").select("source_id", "chunk_no", "chunk", "hash", "embedding", F.lit("kept").alias("state"))
    return done, kept.unionByName(fresh)


def summary(sources: DataFrame) -> DataFrame:
    """One row: sources of each state, and chunks reused, added and removed."""
    states = ("added", "updated", "removed", "unchanged", "skipped", "failed", "empty")
    return sources.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_reused", "n_added", "n_removed")])
