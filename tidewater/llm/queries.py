"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, merkle, mixing, neighbours, ngram_join, paragraphs, quality, revisits, secrets, simhash, syncmers, toxicity, variants
from tidewater.llm.common import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    line = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "canonical", "date", "response_id", "response_date", "status", line.alias("headers"))


ORACLE_OP1 = r"""
WITH page AS (SELECT *, page_id * 3600 AS at_, '"' || substr(md5(html), 1, 16) || '"' AS tag, 't' || (page_id * 3600 // 86400) AS modified FROM pages),
asked AS (
  SELECT page_id * 3 + n AS record_id, at_ + CASE n WHEN 1 THEN 86400 ELSE -604800 END AS date,
    regexp_replace(regexp_replace(url, '^http:', 'HTTPS:'), '#.*$', '') || CASE WHEN url LIKE '%?%' THEN '&utm_source=again' ELSE '#again' END AS url,
    CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 2 = 0 THEN 'W/' || tag ELSE tag END END AS etag,
    CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN modified END AS modified
  FROM page, (VALUES (1), (2)) AS v(n)),
named AS (
  SELECT 'q' AS kind, record_id, url, date, etag, modified, NULL AS size FROM asked
  UNION ALL SELECT 'r', page_id * 3, url, at_, tag, modified, strlen(html) FROM page),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_filter(list_sort(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|fbclid|gclid)(=|$)')), '&') AS query
  FROM named),
c AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM parts),
best AS (
  SELECT q.record_id, max((r.date, r.record_id)) AS m FROM c q JOIN c r ON q.canonical = r.canonical AND r.date < q.date WHERE q.kind = 'q' AND r.kind = 'r' GROUP BY 1),
found AS (
  SELECT q.*, r.record_id AS response_id, r.date AS response_date, r.etag AS stored_tag, r.modified AS stored_modified, r.size AS stored_size
  FROM c q LEFT JOIN best b ON q.record_id = b.record_id LEFT JOIN c r ON r.kind = 'r' AND r.record_id = b.m[2] WHERE q.kind = 'q'),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = stored_tag THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = stored_modified THEN 'resolved' ELSE 'changed' END ELSE 'unverified' END AS status FROM found)
SELECT record_id, canonical, date, response_id, response_date, status,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=600;content-length=' || stored_size || ';content-type=text/html;date=' || response_date
      || ';etag=' || coalesce(etag, stored_tag) || ';last-modified=' || coalesce(modified, stored_modified)
    ELSE 'cache-control=max-age=600;content-length=0' || coalesce(';etag=' || etag, '') || coalesce(';last-modified=' || modified, '') END AS headers
FROM judged
"""


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [k for k, _ in secrets.BASE]
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    linked = F.size(F.filter("spans", lambda s: s["linked"])).cast("long").alias("n_linked")
    return found.select("doc_id", *counts, F.sha2(line(of(*base)), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), linked)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = syncmers.compare_with_edited(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_text(F.col("anchors")).alias("fingerprint"), syncmers.as_text(F.col("edited_anchors")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


_ALL = (
    op1_revisits, op2_neighbours, op3_mixing, op4_secrets, op5_quality, op6_jaccard_join, op7_bpe, op8_syncmers, op9_toxicity, op10_paragraphs, op11_simhash,
    op12_spelling_variants, op13_merkle,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op1_revisits": ORACLE_OP1}
