"""Document fingerprints of closed syncmers, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small

#: k-mers of K words, of which the least word by hash must be the first or the last.
K = 4


def _with(value: Column, use) -> Column:
    """`use(value)` with `value` computed once a row."""
    return F.transform(F.array(value), use)[0]


def syncmers(text: Column, k: int = K) -> Column:
    """array<struct<h:bigint,at:int>>: the k-word substrings whose least inner substring (a word) lies at an edge, with their places.

    h is a 32-bit hash, `at` the number of the first word; anchors are in order of place. Whether a k-mer is an anchor
    depends on it alone, so equal passages have equal anchors wherever they stand, and no more than k - 1 words apart.
    Words are lower-cased runs between white space. A text of under k words is one k-mer; a text without words has none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    anchor = lambda h, at: F.struct(h.cast("long").bitwiseAND(0xFFFFFFFF).alias("h"), at.cast("int").alias("at"))

    def anchors(h: Column) -> Column:
        edge = F.filter(
            F.sequence(F.lit(0), F.size(h) - k),
            lambda i: F.least(h[i], h[i + (k - 1)]) <= F.least(*[h[i + j] for j in range(k)]),
        )
        found = F.transform(edge, lambda i: anchor(F.xxhash64(*[h[i + j] for j in range(k)]), i))
        return F.when(F.size(h) >= k, found).when(F.size(h) > 0, F.array(anchor(F.hash(h), F.lit(0)))).otherwise(none)

    return _with(F.transform(words, lambda w: F.xxhash64(w)), anchors)


def as_text(anchors: Column) -> Column:
    """Anchors as a string: for each one eight hexadecimal digits, then the words since the one before in two (the first: since the beginning)."""
    before = F.concat(F.array(F.lit(0)), F.transform(anchors, lambda a: a["at"]))
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.array_join(F.zip_with(anchors, F.slice(before, 1, F.size(anchors)), lambda a, b: F.concat(digits(a["h"], 8), digits(a["at"] - b, 2))), "")


def steps(anchors: Column) -> Column:
    """array<bigint>: each anchor with the next one and the words between them as one number; a lone anchor stands for itself.

    Two texts have a step in common where they have two anchors in a row at equal distance, at whatever places: the
    positional match of anchors without a search for the shift between the texts.
    """
    after = F.slice(anchors, 2, F.greatest(F.size(anchors) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(anchors, 1, F.greatest(F.size(anchors) - 1, F.lit(0))), after, lambda a, b: F.xxhash64(a["h"], b["h"], b["at"] - a["at"]))
    return F.array_distinct(F.when(F.size(anchors) == 1, F.transform(anchors, lambda a: a["h"])).otherwise(pairs))


def likeness(a: Column, b: Column) -> Column:
    """Share 2 |A & B| / (|A| + |B|) of the steps (as from `steps`) that two texts have in common; 1 if both have none."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def with_next(docs: DataFrame, range_docs: int = 512, most_ranges: int = 100_000) -> DataFrame:
    """doc_id, text and next_text: that of the next document by descending doc_id (after the last one: the first).

    Documents are dealt by ranges of doc_id, so that a neighbour is found by a window over a range; the ends of ranges,
    at most about `most_ranges` rows, are joined. Ranges have equal widths; where more than four times the meant number
    of documents fall into one, it is cut again by its own least and greatest doc_id, and so on, documents of one id by
    the hash of their texts. So ids need not be spread evenly. Null texts are "", null ids come last; rows of one id are
    ordered by a hash of their texts, and repeated rows follow one another.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("_order", F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double"))
    low, high, n = base.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    each = max(range_docs, -(-n // most_ranges))

    def cell(x: Column, low: Column, high: Column, rows: Column) -> Column:
        width = F.greatest((high - low + 1) / F.ceil(rows / each), F.lit(1.0))
        return F.coalesce(F.floor((x - low) / width), F.lit(-1)).cast("long")

    number = F.col("doc_id").cast("double")
    base = base.withColumn("_range", F.array(cell(number, F.lit(float(low or 0)), F.lit(float(high or 0)), F.lit(n))))
    for _ in range(16):
        cells = base.groupBy("_range").agg(
            F.count(F.lit(1)).alias("_n"), F.min(number).alias("_a"), F.max(number).alias("_b"), F.min("_order").alias("_c"), F.max("_order").alias("_d")
        )
        heavy = cut(cells.filter((F.col("_n") > 4 * each) & ((F.col("_a") < F.col("_b")) | (F.col("_c") < F.col("_d")))))
        if heavy.isEmpty():
            break
        inner = F.when(F.col("_a") < F.col("_b"), cell(number, F.col("_a"), F.col("_b"), F.col("_n"))).otherwise(cell(F.col("_order"), F.col("_c"), F.col("_d"), F.col("_n")))
        path = F.when(F.col("_n").isNull(), F.col("_range")).otherwise(F.concat("_range", F.array(inner)))
        base = join_small(base, heavy, "_range", "left").select("doc_id", "text", "_order", path.alias("_range"))
    up = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), "_order")
    near = base.withColumn("next_text", F.lag("text").over(up))
    # The highest row of each range is the next of the lowest row in the range above.
    ends = base.groupBy("_range").agg(F.max_by("text", F.struct("doc_id", "_order")).alias("_text"))
    along = Window.partitionBy(F.lit(0)).orderBy("_range")
    above = base.select("_range").distinct().withColumn("_above", F.coalesce(F.lead("_range").over(along), F.min("_range").over(Window.partitionBy(F.lit(0)))))
    ends = ends.join(above, "_range").select(F.col("_above").alias("_range"), "_text")
    lowest = near.filter(F.col("next_text").isNull()).join(ends, "_range").select("doc_id", "text", F.col("_text").alias("next_text"))
    return near.filter(F.col("next_text").isNotNull()).select("doc_id", "text", "next_text").unionByName(lowest)


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document of `docs` (doc_id, text) and of its edited text, and their likeness.

    A fingerprint is all anchors of a text with their places. The edited text has the last half of the code points
    (rounded down) replaced by as many, or all, of the first ones of the next document (`with_next`). Returns doc_id,
    text, edited, anchors, edited_anchors, near_edited, near_next: `likeness` of the text to the edited one and to that
    of the next document. A null or empty text has no anchors and equals other texts without any; an empty table gives no
    rows; repeated rows each have theirs; other columns are ignored.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    found = with_next(docs).withColumn("edited", edited)
    found = found.select("doc_id", "text", "edited", *[syncmers(F.col(c)).alias(a) for c, a in (("text", "anchors"), ("edited", "edited_anchors"), ("next_text", "_next"))])
    own = lambda other: _with(F.struct(steps(F.col("anchors")).alias("a"), steps(F.col(other)).alias("b")), lambda x: likeness(x["a"], x["b"]))
    return found.select("doc_id", "text", "edited", "anchors", "edited_anchors", own("edited_anchors").alias("near_edited"), own("_next").alias("near_next"))
