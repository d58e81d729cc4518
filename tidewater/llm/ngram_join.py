"""Documents alike by word n-grams: an exact Jaccard join by T-occurrence search with DivideSkip."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small
from tidewater.llm.graph import components
from tidewater.llm.vector import lean, mix, release, shingles, slices, words

U = np.uint64


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of all texts, n + 1 offsets, node): each text's distinct shingles by hash; equal sets have equal nodes."""
    doc, h = shingles(words(text), k)
    by = np.argsort((doc.astype(U) << U(44)) | (h >> U(20)))
    doc, h = doc[by], h[by]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    doc, h = doc[new], h[new]
    ends = np.searchsorted(doc, np.arange(len(text) + 1))
    total = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
    size = np.diff(ends)
    return h, ends, mix(total[ends[1:]] - total[ends[:-1]] + size.astype(U)).view(np.int64)


def size_bounds(percent: int) -> np.ndarray:
    """Rising lower bounds of classes of set sizes; sets that link lie in one class or in two neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 31:
        bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * max(1.5, 100 / percent))))
    return np.array(bounds)


def signatures(h: np.ndarray, ends: np.ndarray, chosen: np.ndarray, percent: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of the `chosen` sets, ordered by set: sets that link and differ have a signature in common.

    The shingles of a set are dealt into m parts by hash. Two sets that link differ in at most d shingles, so in at most
    d parts. In any order of parts that depends on their content alone, the parts before the first common one differ,
    so the first d + 1 parts of both sets hold it; the largest parts come first, as the least likely to be equal by
    chance. m follows from the class of the larger set's size, so a set that can link to larger ones of the next class is dealt
    twice. Two sets that both have no more than d parts with shingles are found by their first shingles instead.
    """
    size = np.diff(ends)
    own = np.searchsorted(bounds, size, side="right") - 1
    owners, values = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for step in (0, 1):
        scheme = own + step
        top = bounds[scheme + 1] - 1
        differ = (size + np.minimum(100 * size // percent, top)) * (100 - percent) // (100 + percent)
        able = chosen & (size > 0) & (differ > 0) & ((step == 0) | (100 * size >= percent * bounds[scheme]))
        at = np.flatnonzero(able)
        if not len(at):
            continue
        n, d, seed = size[at], differ[at], mix(scheme[at].astype(U) + U(77))
        parts = np.ceil(1.22 * (2 * top[at] * (100 - percent) // (100 + percent) + 1)).astype(U) + U(2)
        row = np.repeat(np.arange(len(at)), n)
        x = mix(h[np.repeat(ends[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] ^ seed[row])
        key = (row.astype(U) << U(32)) | ((x >> U(16)) % parts[row])
        by = np.argsort(key)
        key, x = key[by], x[by]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        content, owner = mix(np.add.reduceat(mix(x), begin)), (key[begin] >> U(32)).astype(np.int64)
        many = np.minimum(np.diff(np.append(begin, len(key))), 255)
        by = np.argsort((owner.astype(U) << U(40)) | ((255 - many).astype(U) << U(32)) | (content >> U(32)))
        content, owner = content[by], owner[by]
        first = np.searchsorted(owner, np.arange(len(at)))
        kept = np.arange(len(owner)) - first[owner] <= d[owner]
        owners.append(at[owner[kept]])
        values.append(content[kept])
        few = np.flatnonzero(np.bincount(owner, minlength=len(at)) <= d)
        prefix = n[few] - -(-percent * n[few] // 100) + 1
        from_ = np.repeat(ends[at[few]] - np.concatenate([[0], np.cumsum(prefix)[:-1]]).astype(np.int64), prefix) + np.arange(prefix.sum())
        owners.append(np.repeat(at[few], prefix))
        values.append(mix(h[from_] + U(2) * np.repeat(seed[few], prefix)))
    owner, value = np.concatenate(owners), np.concatenate(values)
    by = np.argsort(owner, kind="stable")
    return owner[by], value[by]


def t_occurrence(sets: list[np.ndarray], asked: np.ndarray, percent: int, mu: float = 0.05) -> list[tuple[int, int]]:
    """Links (i, j) among `sets` that connect all sets that links connect, by DivideSkip.

    `asked` marks two sides: only sets of different sides are compared, or all of them if there is one side. Sets are
    asked in order of size against those before them. A query of n shingles must have T of them in common with a set
    that is not longer. The L longest of its inverted lists are put aside; the others are merged, and what occurs in
    T - L of them is probed in the long lists by binary search. Sets that links connect already are not probed again.
    """
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets])
    by = np.argsort(size, kind="stable")
    values, inverse = np.unique(np.concatenate([sets[i] for i in by]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size[by])])
    # Inverted lists: the ranks (by size) of the sets that have a shingle, ascending.
    owner = np.repeat(np.arange(len(by)), size[by])
    grouped = np.argsort(inverse, kind="stable")
    postings, edges = owner[grouped], np.searchsorted(inverse[grouped], np.arange(len(values) + 1))
    length = np.diff(edges)
    ordered, side, two = size[by], asked[by], len(np.unique(asked)) > 1
    parent = list(range(len(by)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    for q in range(1, len(by)):
        n = int(ordered[q])
        least = -(-percent * n // 100)  # no shorter set links
        low = int(np.searchsorted(ordered[:q], least))
        if n == 0 or low == q:
            continue
        t = -(-percent * (n + int(ordered[low])) // (100 + percent))
        lists = inverse[starts[q] : starts[q + 1]]
        lists = lists[np.argsort(length[lists], kind="stable")]
        lists = lists[length[lists] > 1]
        aside = min(t - 1, int(t / (mu * math.log2(max(int(length[lists[-1]]), 2)) + 1)), len(lists)) if len(lists) else 0
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        if not len(short):
            continue
        merged = np.sort(np.concatenate([postings[edges[x] : edges[x + 1]] for x in short]), kind="stable")
        merged = merged[(merged >= low) & (merged < q)]
        found, count = np.unique(merged, return_counts=True)
        enough = count >= t - aside
        found, count = found[enough], count[enough]
        if two:
            found, count = found[side[found] != side[q]], count[side[found] != side[q]]
        need = -(-percent * (n + ordered[found]) // (100 + percent))
        # Likeliest first: one link makes the rest of its component superfluous.
        for i in np.argsort(need - count, kind="stable").tolist():
            c = int(found[i])
            if root(c) == root(q):
                continue
            overlap, left = int(count[i]), len(long)
            for x in long[::-1]:
                if overlap + left < need[i]:
                    break
                a, b = edges[x], edges[x + 1]
                at = a + int(np.searchsorted(postings[a:b], c))
                overlap += at < b and postings[at] == c
                left -= 1
            if overlap >= need[i]:
                parent[root(q)] = root(c)
                links.append((int(by[c]), int(by[q])))
    return links


def exact_links(nodes: DataFrame, ties: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, block: int) -> DataFrame:
    """node, component of the nodes that exact links connect, out of groups that `ties` (u, v) connect.

    `nodes` has node, doc (where to find it) and n (shingles). `fetch` takes a table of the nodes wanted and returns its
    other columns with `data`, the node's shingles in 64 bits each. Small groups are dealt together, about `block`
    shingles a task; those of more than `block` shingles are cut by classes of size and hash into blocks, which are
    compared in pairs whose sizes can link, so that a task never holds more than two blocks.
    """
    nodes = cut(join_small(nodes, components(ties), "node").withColumn("_class", F.floor(F.log("n") / math.log(100 / percent))))
    sums = nodes.groupBy("component", "_class").agg(F.sum("n").alias("_sum"))
    whole = sums.groupBy("component").agg(F.sum("_sum").alias("_whole"))
    large = cut(sums.join(whole.filter(F.col("_whole") > block), "component").withColumn("_parts", F.ceil(F.col("_sum") / block)))
    part = F.col("_class") * 1_000_000 + F.pmod(F.xxhash64("node"), F.col("_parts"))
    nodes = cut(join_small(nodes, large, ["component", "_class"], "left").select("node", "doc", "n", "component", part.alias("block")))
    blocks = nodes.filter("block IS NOT NULL").groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.toDF("component", "j", "low_j", "high_j")
    pairs = blocks.join(other, "component").filter(f"block = j OR (block < j AND 100 * high >= {percent} * low_j)")
    ends = pairs.select("component", F.struct(F.col("block").alias("i"), "j").alias("p"), F.explode(F.array_distinct(F.array("block", "j"))).alias("block"))
    ends = ends.groupBy("component", "block").agg(F.collect_list("p").alias("pairs"))
    small = nodes.filter("block IS NULL")
    bins = max(1, math.ceil((small.agg(F.sum("n")).first()[0] or 0) / block))
    together = F.array(F.struct(F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    wanted = small.select("doc", "node", F.col("component").alias("grp"), F.lit(0).cast("long").alias("block"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"), together.alias("pairs"))
    apart = nodes.join(ends, ["component", "block"]).select("doc", "node", F.col("component").alias("grp"), "block", F.col("component").alias("bin"), "pairs")
    sets = fetch(cut(wanted.unionByName(apart)))
    dealt = sets.withColumn("pair", F.explode("pairs")).select("bin", "pair.i", "pair.j", "grp", "node", "block", "data")

    def compare(rows: pa.Table) -> pa.Table:
        node, grp = rows.column("node").to_numpy(), rows.column("grp").to_numpy()
        data, side = rows.column("data").combine_chunks(), rows.column("block").to_numpy()
        by = np.lexsort((node, grp))
        by = by[np.concatenate([[True], (grp[by][1:] != grp[by][:-1]) | (node[by][1:] != node[by][:-1])])] if len(by) else by
        out: list[tuple[int, int]] = []
        for group in np.split(by, np.flatnonzero(np.diff(grp[by])) + 1):
            links = t_occurrence([np.frombuffer(data[int(i)].as_buffer(), U) for i in group], side[group], percent)
            out += [(int(node[group[a]]), int(node[group[b]])) for a, b in links]
        release()
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return components(dealt.groupBy("bin", "i", "j").applyInArrow(compare, "u long, v long"))


def tied(postings: DataFrame) -> DataFrame:
    """(u, v): each node of a list of `postings` (node, h) with the least node of that list; no row for the least."""
    lists = cut(postings.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("h", "least"))
    return join_small(postings, lists, "h", most=1_000_000).filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))


def tied_by_size(postings: DataFrame, percent: int) -> DataFrame:
    """(u, v): each node of a list of `postings` (node, n, h) with the next smaller one of that list, if the two can link by size.

    If two nodes of a list can link, so can all neighbours between them in order of size: the ties connect the two.
    """
    before = F.lag(F.struct("node", "n")).over(Window.partitionBy("h").orderBy("n", "node"))
    near = postings.withColumn("_b", before).filter(F.col("_b").isNotNull() & (100 * F.col("_b.n") >= percent * F.col("n")))
    return near.select(F.col("node").alias("u"), F.col("_b.node").alias("v")).filter("u != v").distinct()


WANTED = "node long, grp long, block long, bin long, pairs array<struct<i:long,j:long>>, data binary"


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 400_000) -> DataFrame:
    """doc_id, n_shingles, node, component and component_id of each row of `docs` (doc_id, text): the classes that links connect.

    A document's set are its distinct `k`-word shingles (words between white space, A-Z lower-cased; a shorter text is
    one shingle). Sets link if 100 * intersection >= `percent` * union. component_id is the least doc_id reachable.

    1. Equal sets are one node. 2. Sets that link have one of their `signatures` in common: the nodes of a signature
    are tied to the next smaller one, which takes as many rows as there are nodes. 3. Components of those ties are
    groups that hold all links; in each one the links are found by T-occurrence search. Groups of more than `block`
    shingles are cut into blocks by size and compared in pairs of blocks whose sizes can link, so that a task never
    holds more than two blocks. 4. Components of the links.

    Null and empty texts, and texts of white space only, have no shingles and link with nothing: component_id is their
    own doc_id. Repeated rows are in one component; null ids are never the least. An empty table gives no rows; other
    columns are ignored. Hashes have 64 bits.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounds = size_bounds(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                h, ends, node = shingle_sets(part.column(1), k)
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True
                owner, value = signatures(h, ends, first, percent, bounds)
                at = np.searchsorted(owner, np.arange(len(node) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(node), lists], names=["doc_id", "n", "node", "signs"])

    sets = cut(docs.mapInArrow(lean(task), f"doc_id {kind}, n long, node long, signs array<long>"))
    postings = sets.filter("size(signs) > 0").select("node", "n", F.explode("signs").alias("h"))

    def fetch(wanted: DataFrame) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 0):
                    h, ends, node = shingle_sets(part.column(0), k)
                    own = np.flatnonzero(node == part.column(1).to_numpy())
                    data = [h[ends[i] : ends[i + 1]].tobytes() for i in own]
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(own)).columns[1:], pa.array(data, pa.binary())], names=["node", "grp", "block", "bin", "pairs", "data"])

        rows = join_small(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), "text"), wanted, "doc", most=500_000)
        return rows.select("text", "node", "grp", "block", "bin", "pairs").mapInArrow(lean(find), WANTED)

    nodes = sets.groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("doc"), F.first("n").alias("n"))
    linked = exact_links(nodes, tied_by_size(postings, percent), fetch, percent, block)

    named = sets.select("doc_id", "n", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named)
    least = named.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_rows"))
    more = least.filter("_rows > 1").drop("_rows")
    done = join_small(named, more, "component", "left", most=500_000)
    return done.select("doc_id", F.col("n").alias("n_shingles"), "node", "component", F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def nodes_of(docs: DataFrame, k: int) -> DataFrame:
    """`docs` with the column `_node`: the name of each text's set of `k`-word shingles; null and empty texts have one name.

    All rows and other columns stay; a column of that name is replaced.
    """
    docs = docs.drop("_node")
    at = docs.columns.index("text")
    schema = docs.withColumn("_node", F.lit(0).cast("long")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                node = pa.array(shingle_sets(part.column(at), k)[2])
                yield pa.RecordBatch.from_arrays([*part.columns, node], names=[*part.schema.names, "_node"])

    return docs.mapInArrow(lean(task), schema)


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others, whatever their names), one of each component: that of the least doc_id.

    Null texts and texts without words are in no component and all stay. Where each doc_id stands once, the ids to
    remove are joined against; else rows are found by id and set of shingles, and of equal ones one stays. A null id is
    never the least, if its component has another. An empty table gives no rows.
    """
    found = cut(jaccard_components(docs, k, percent, **options).filter("n_shingles > 0").select("doc_id", "node", "component", "component_id"))
    n, ids = found.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if n == ids:
        removed = cut(found.filter("doc_id != component_id").select("doc_id"))
        return join_small(docs, removed, "doc_id", "left_anti", most=500_000)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    kept = found.groupBy("component").agg(least.alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.node").alias("_n"))
    named = nodes_of(docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.col("text").cast("string").alias("text")), k)
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = named.filter(words).join(kept, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_n")))
    return chosen.dropDuplicates(["_doc_id", "_node"]).select("_doc.*").unionByName(docs.filter(~words))
