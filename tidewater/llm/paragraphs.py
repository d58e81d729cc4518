"""Repeated paragraphs and passages: MinHash banding, exact Jaccard, removals by components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small
from tidewater.llm.ngram_join import WANTED, exact_links, tied
from tidewater.llm.vector import lean, mix, slices, text_bytes, words

U = np.uint64
PLACE = ("start", "end", "first", "last")


def tune(threshold: float, recall: float = 0.999, most: int = 32) -> tuple[int, int]:
    """(bands, rows): the fewest bands with 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= most hashes;
    of settings within three bands of that, the one with most rows, which lets the fewest unlike pairs collide."""
    able = [(b, r) for r in range(1, 9) for b in range(1, most // r + 1) if 1 - (1 - threshold**r) ** b >= recall]
    fewest = min(b for b, _ in able) if able else most
    return max((x for x in able if x[0] <= fewest + 3), key=lambda x: (x[1], -x[0])) if able else (most, 1)


@dataclass
class Units:
    """Parts of texts: document in the batch, places in code points and in words of the document, node, shingle range."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    node: np.ndarray
    shingle: np.ndarray
    of: np.ndarray


def _units(text: pa.Array, k: int, least: int, span: int) -> tuple[Units, Units]:
    """(paragraphs, passages) of a batch.

    Paragraphs are lines of at least `least` words. Passages are runs of `span` words, across lines, that start where the
    hash of a k-word shingle is the least of `span` / 2 in a row. So of n words in a row that two texts share, all but
    `span` - 2 at most are in passages of both. Nodes name the set of a paragraph's shingles and the run of a passage's.
    """
    data, _ = text_bytes(text)
    w = words(text)
    n = len(w.hash)
    place = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64) if len(data) else np.zeros(0, np.int64)
    base = np.concatenate([[0], place])[text_bytes(text)[1][:-1]] if len(text) else np.zeros(0, np.int64)
    sh = np.zeros(n, U)
    for j in range(k):
        if n > j:
            sh[: n - j] = mix(sh[: n - j] + w.hash[j:] * U(2 * j + 1))
    line = np.cumsum(data == 10)[w.start] if n else np.zeros(0, np.int64)
    opening = np.searchsorted(w.doc, np.arange(len(text)))

    def made(first: np.ndarray, last: np.ndarray, node: np.ndarray, shingle: np.ndarray, of: np.ndarray) -> Units:
        doc = w.doc[first]
        return Units(doc, place[w.start[first]] - 1 - base[doc], place[w.start[last - 1] + w.size[last - 1] - 1] - base[doc], first - opening[doc], last - opening[doc], node.view(np.int64), shingle, of)

    begin = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    begin, size = begin[size >= least], size[size >= least]
    count = size - k + 1
    of = np.repeat(np.arange(len(begin)), count)
    h = sh[np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())] if len(begin) else np.zeros(0, U)
    by = np.argsort((of.astype(U) << U(40)) | (h >> U(24)))
    of, h = of[by], h[by]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    of, h = of[new], h[new]
    ends = np.searchsorted(of, np.arange(len(begin) + 1))
    total = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
    paragraphs = made(begin, begin + size, mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(U)), h, ends)

    window = span // 2
    reach = window + k - 1  # words under `window` shingles in a row
    none = np.zeros(0, np.int64)
    if n < max(reach, span):
        return paragraphs, made(none, none, np.zeros(0, U), np.zeros(0, U), np.zeros(1, np.int64))
    first = np.argmin(np.lib.stride_tricks.sliding_window_view(sh[: n - k + 1], window), axis=1) + np.arange(n - reach + 1)
    anchor = np.unique(first[w.doc[: n - reach + 1] == w.doc[reach - 1 :]])
    anchor = anchor[anchor + span <= n]
    anchor = anchor[w.doc[anchor] == w.doc[anchor + span - 1]]
    sums = np.concatenate([[U(0)], np.cumsum(mix(sh + U(1)), dtype=U)])
    node = mix(sums[anchor + span - k + 1] - sums[anchor] + sh[anchor] * U(3))
    return paragraphs, made(anchor, anchor + span, node, np.zeros(0, U), np.zeros(1, np.int64))


def _bands(p: Units, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) keys from MinHash values of each paragraph's shingles."""
    n = len(p.node)
    keys = np.zeros((n, bands), U)
    for b in range(bands):
        key = np.full(n, U(b + 1))
        for r in range(rows):
            seed = U((b * rows + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            key = mix(key * U(31) + np.minimum.reduceat(mix(p.shingle ^ seed), p.of[:-1])) if n else key
        keys[:, b] = key
    return keys.view(np.int64)


def repeated_passages(docs: DataFrame, percent: int = 80, k: int = 5, least: int = 25, span: int = 24, passage: int = 50, recall: float = 0.999, block: int = 400_000) -> DataFrame:
    """Spans of the texts of `docs` (doc_id, text) that other documents have too: doc_id, start, end, first_doc, n_units, removed.

    Paragraphs (lines of at least `least` words) get MinHash signatures of their `k`-word shingles, banded by `tune`;
    colliding paragraphs are joined and compared by exact Jaccard similarity (links from `percent` on); components of
    the links are classes. A line can also hold a passage that is elsewhere part of another line: passages (`_units`) of
    `span` words anchored by their own content, which are equal or not (their bands would be many times the rows of
    the paragraphs'), make further classes. Classes that are found in one document only are left out. Spans without a
    paragraph that are too short for a part of `passage` words in common (of which the ends may be cut off, see
    `_units`) are left out too; all longer ones are found.

    Of a class the copy in the document of least doc_id stays; copies in other documents are to be removed. Units that
    overlap in a document are one span, those that stay and those to be removed apart; start and end (exclusive) are
    in code points, first_doc is the least document of their classes. Null and empty texts have no units; null ids
    count as -1; repeated rows of one document are one document; an empty table gives no rows; other columns are ignored.
    """
    bands, rows = tune(percent / 100, recall)
    docs = docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc"), F.col("text").cast("string").alias("text"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                p, _ = _units(part.column(1), k, least, span)
                keys = _bands(p, bands, rows)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(p.doc)), *map(pa.array, (p.node, np.diff(p.of), p.start, p.end, p.first, p.last)), lists], names=["doc", "node", "n", *PLACE, "bands"])

    paragraphs = cut(docs.mapInArrow(lean(lines), f"doc long, node long, n long, {', '.join(f'{c} long' for c in PLACE)}, bands array<long>"))
    nodes = cut(paragraphs.groupBy("node").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.first("n").alias("n")))
    once = paragraphs.dropDuplicates(["node"]).select("node", F.explode("bands").alias("h"))

    def fetch(wanted: DataFrame) -> DataFrame:
        rows_of = wanted.groupBy("doc").agg(F.collect_list(F.struct("node", "grp", "block", "bin", "pairs")).alias("w"))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 0):
                    p, _ = _units(part.column(0), k, least, span)
                    at = {(d, x): i for i, (d, x) in enumerate(zip(p.doc.tolist(), p.node.tolist()))}
                    asked = [(at[d, w["node"]], w) for d, ws in enumerate(part.column(1).to_pylist()) for w in ws if (d, w["node"]) in at]
                    out = {c: [w[c] for _, w in asked] for c in ("node", "grp", "block", "bin", "pairs")} | {"data": [p.shingle[p.of[i] : p.of[i + 1]].tobytes() for i, _ in asked]}
                    kinds = pa.schema([("node", pa.int64()), ("grp", pa.int64()), ("block", pa.int64()), ("bin", pa.int64()), ("pairs", pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())]))), ("data", pa.binary())])
                    yield pa.RecordBatch.from_pydict(out, schema=kinds)

        return join_small(docs, cut(rows_of), "doc", most=200_000).select("text", "w").mapInArrow(lean(find), WANTED)

    linked = exact_links(nodes.select("node", "doc", "n"), tied(once), fetch, percent, block)
    classes = nodes.join(linked, "node", "left").withColumn("class", F.coalesce("component", "node"))
    found = classes.groupBy("class").agg(F.min("doc").alias("first_doc"), F.max("last").alias("_last")).filter("first_doc < _last").select("class", "first_doc")
    of_node = cut(classes.join(found, "class").select("node", "first_doc"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                _, q = _units(part.column(1), k, least, span)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q.doc)), *map(pa.array, (q.node, q.start, q.end - q.start, q.first))], names=["doc", "node", "start", "size", "first"])

    # Passages are dealt by their content once, with their places; those of one document only end there.
    alike = Window.partitionBy("node")
    passages = docs.mapInArrow(lean(runs), "doc long, node long, start long, size long, first long")
    passages = passages.withColumn("first_doc", F.min("doc").over(alike)).withColumn("_last", F.max("doc").over(alike)).filter("first_doc < _last")
    passages = passages.select("doc", "start", (F.col("start") + F.col("size")).alias("end"), "first", (F.col("first") + span).alias("last"), "first_doc", F.lit(False).alias("line"))
    units = join_small(paragraphs.select("doc", "node", *PLACE), of_node, "node").select("doc", *PLACE, "first_doc", F.lit(True).alias("line")).unionByName(passages)
    units = units.withColumn("removed", F.col("doc") > F.col("first_doc"))
    along = Window.partitionBy("doc", "removed").orderBy("start", "end")
    apart = F.col("start") > F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = units.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(F.col("doc").alias("doc_id"), "removed", "_span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc"), F.count(F.lit(1)).alias("n_units"),
        (F.max("last") - F.min("first")).alias("_words"), F.max("line").alias("_line"),
    )
    return spans.filter(F.col("_line") | (F.col("_words") > passage - span + 2)).select("doc_id", "start", "end", "first_doc", "n_units", "removed")
