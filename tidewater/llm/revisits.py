"""Not-modified revisits of web archives, resolved by an as-of join to earlier full responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small

#: Fields of a 304 answer that replace those of the stored response (fixed list: RFC 9110, 15.4.5, and freshness fields).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column, drop_params: str = r"utm_[a-z]+|fbclid|gclid") -> Column:
    """One name for URLs that lead to the same resource: lower-case host without www., no scheme, default port or
    fragment, no slash at the end, query parameters in order without tracking ones. What is no URL stays, trimmed."""
    part = lambda i: F.regexp_extract(url, URL, i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.|\.$", "")
    port = F.when(part(2).isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(part(3), r"/+$", "")
    kept = F.filter(F.array_sort(F.split(part(4), "&")), lambda p: (p != "") & ~F.lower(p).rlike(rf"^(?:{drop_params})(?:=|$)"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(part(1) != "", F.concat(host, port, path, query)).otherwise(F.trim(url))


def resolve(records: DataFrame, permitted: Sequence[str] = PERMITTED, per_part: int = 50_000) -> DataFrame:
    """Each revisit among `records` with the latest earlier full response of its canonical URL.

    `records` has record_id (unique), kind (response or revisit), url, date (long, any unit) and headers
    (map<string,string>, names in lower case). The response is the one of greatest date before the revisit's, of equal
    ones that of greatest record_id. status is resolved if an entity tag of the revisit equals the response's (weak
    comparison) or, without one, the dates of last modification are equal; else changed (validators differ),
    unverified (the revisit has none) or missing (no earlier response). Headers of resolved revisits are those of the
    response with the permitted ones of the revisit in their place; others keep their own.

    Records of one URL and date are one moment, with its last response. Moments of a URL lie on a time line of one part
    for each `per_part` of them: a window finds the response within a part, and a table of the parts' last responses the
    one before, so neither a URL nor a burst of one date has to be in one task. Null URLs and dates are left out of that
    and find no response; repeated rows each have theirs; other columns are ignored; an empty table gives no rows.

    Returns record_id, url, canonical, date, response_id, response_date, status, headers.
    """
    named = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "date", (F.col("kind") == "response").alias("_full"))
    named = named.filter("canonical IS NOT NULL AND date IS NOT NULL")
    moments = cut(named.groupBy("canonical", "date").agg(F.max(F.when(F.col("_full"), F.col("record_id"))).alias("_id")))
    counts = moments.groupBy("canonical").agg(F.count(F.lit(1)).alias("_n"), F.min("date").alias("_from"), F.max("date").alias("_to")).filter(F.col("_n") > per_part)
    crowded = cut(counts.withColumn("_width", F.ceil((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_n") / per_part))).select("canonical", "_from", "_width"))
    dealt = join_small(moments, crowded, "canonical", "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.floor((F.col("date") - F.col("_from")) / F.col("_width")), F.lit(0)))
    response = F.when(F.col("_id").isNotNull(), F.struct("date", F.col("_id").alias("record_id")))
    earlier = Window.partitionBy("canonical", "_part").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("_found", F.max(response).over(earlier))
    # Of the parts of crowded URLs: the last response before each.
    along = Window.partitionBy("canonical").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.filter("_width IS NOT NULL").groupBy("canonical", "_part").agg(F.max(response).alias("_last"))
    parts = cut(parts.withColumn("_before", F.max("_last").over(along)).filter("_before IS NOT NULL").select("canonical", "_part", "_before"))
    found = join_small(found, parts, ["canonical", "_part"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    found = found.filter("_found IS NOT NULL").select("canonical", "date", F.col("_found.record_id").alias("response_id"), F.col("_found.date").alias("response_date"))
    asked = named.filter(~F.col("_full")).join(found, ["canonical", "date"]).select("record_id", "response_id", "response_date")

    revisits = records.filter("kind = 'revisit'").select("record_id", "url", "date", "headers")
    stored = records.filter("kind = 'response'").select(F.col("record_id").alias("_key"), F.col("headers").alias("_stored")).dropDuplicates(["_key"])
    # Revisits without a response are spread by their own number, as nulls would all meet in one task.
    joined = revisits.join(asked.dropDuplicates(["record_id"]), "record_id", "left").withColumn("_key", F.coalesce("response_id", -1 - F.col("record_id")))
    joined = joined.join(stored, "_key", "left").withColumn("_stored", F.when(F.col("response_id").isNotNull(), F.col("_stored")))
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    modified = lambda h: F.element_at(h, "last-modified")
    same = F.when(tag(F.col("headers")).isNotNull(), tag(F.col("headers")).eqNullSafe(tag(F.col("_stored")))).when(
        modified(F.col("headers")).isNotNull(), modified(F.col("headers")).eqNullSafe(modified(F.col("_stored")))
    )
    status = F.when(F.col("response_id").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*permitted))
    kept = F.map_filter(F.coalesce("_stored", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return joined.select(
        "record_id", "url", canonical_url(F.col("url")).alias("canonical"), "date", "response_id", "response_date", status.alias("status"),
        F.when(status == "resolved", F.map_concat(kept, fresh)).otherwise(F.col("headers")).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive made of `pages` (page_id, url, html): a response of each page, and two revisits.

    Record ids are 3 page_id + 0, 1, 2; dates are seconds: a response at 3600 page_id, its first revisit a day later by
    another spelling of the URL, the second a week before. Of seven pages one has changed by the revisit, and of five one
    sends no entity tag; of these, every other sends no date of modification either.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    at = F.col("page_id") * 3600
    modified = F.concat(F.lit("t"), F.floor(at / 86400).cast("string"))
    text = lambda c: c.cast("string")
    full = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("cache-control", "content-length", "content-type", "date", "etag", "last-modified")]),
        F.array(F.lit("max-age=60"), text(F.octet_length("html")), F.lit("text/html"), text(at), tag, modified),
    )
    again = F.col("page_id") % 5 == 0
    later = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).when(F.col("page_id") % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    given = F.array(
        *[
            F.struct(F.lit(k).alias("k"), v.alias("v"))
            for k, v in (
                ("cache-control", F.lit("max-age=600")), ("content-length", F.lit("0")),
                ("etag", F.when(~again, later)), ("last-modified", F.when(again & (F.col("page_id") % 2 == 0), modified)),
            )
        ]
    )
    revisit = F.map_from_entries(F.filter(given, lambda e: e["v"].isNotNull()))
    other = F.concat(F.regexp_replace(F.regexp_replace("url", "^http:", "HTTPS:"), "#.*$", ""), F.when(F.col("url").rlike("[?]"), "&utm_source=again").otherwise("#again"))
    rows = F.array(
        *[
            F.struct((F.col("page_id") * 3 + n).alias("record_id"), F.lit(kind).alias("kind"), u.alias("url"), d.alias("date"), h.alias("headers"))
            for n, kind, u, d, h in ((0, "response", F.col("url"), at, full), (1, "revisit", other, at + 86400, revisit), (2, "revisit", other, at - 604800, revisit))
        ]
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")
