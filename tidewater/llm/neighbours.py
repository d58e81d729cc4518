"""Approximate nearest neighbours: an NN-descent graph by iterative joins, queried by greedy graph search."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Written, cut, tidy
from tidewater.llm.vector import mix

#: Graph rows: a vector (its scale in double, its direction in half precision), its neighbours by falling inner product, which of them no round has compared yet, and how many the last merge brought.
GRAPH = "u long, vec binary, ids array<long>, sims array<double>, fresh array<boolean>, better int"
LISTS = "u long, ids array<long>, sims array<double>"


def top_of(u: np.ndarray, w: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest distinct w of each u, ordered by u and falling sim."""
    by = np.lexsort((w, u))
    u, w, sim = u[by], w[by], sim[by]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]) if len(u) else np.zeros(0, bool)
    u, w, sim = u[new], w[new], sim[new]
    by = np.lexsort((w, -sim, u))
    u, w, sim = u[by], w[by], sim[by]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    return u[rank < k], w[rank < k], sim[rank < k]


def local_join(x: np.ndarray, scale: np.ndarray, fresh: np.ndarray, others: np.ndarray, worst: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the members of each centre (rows of `fresh` and `others`, -1: none), the `each` best others of each one that beat its worst neighbour.

    Two of `others` were compared in an earlier round and are not again.
    """
    us, ws, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    size = (fresh >= 0).sum(axis=1), (others >= 0).sum(axis=1)
    order = np.lexsort(size[::-1])
    order = order[size[0][order] > 0]
    for a in range(0, len(order), 128):
        at = order[a : a + 128]
        wide = size[0][at].max()
        m = np.concatenate([fresh[at, :wide], others[at, : size[1][at].max()]], axis=1)
        v = x[np.maximum(m, 0)]
        s = (v @ v.transpose(0, 2, 1)) * scale[np.maximum(m, 0)][:, None, :]
        s[np.broadcast_to((m < 0)[:, None, :], s.shape)] = -np.inf
        s[:, np.arange(m.shape[1]), np.arange(m.shape[1])] = -np.inf
        s[:, wide:, wide:] = -np.inf
        s[s <= worst[np.maximum(m, 0)][:, :, None]] = -np.inf
        n = min(each, s.shape[2])
        best = np.argpartition(-s, n - 1, axis=2)[:, :, :n]
        value = np.take_along_axis(s, best, axis=2)
        u = np.broadcast_to(m[:, :, None], best.shape)
        w = np.take_along_axis(np.broadcast_to(m[:, None, :], s.shape), best, axis=2)
        good = (value > -np.inf) & (u >= 0) & (u != w)
        us.append(u[good])
        ws.append(w[good])
        sims.append(value[good])
    return np.concatenate(us), np.concatenate(ws), np.concatenate(sims)


def _lists(u: np.ndarray, w: np.ndarray, sim: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat rows in order of u as columns u, ids, sims."""
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(u)).astype(np.int32))
    return pa.array(u[first]), pa.ListArray.from_arrays(ends, pa.array(w)), pa.ListArray.from_arrays(ends, pa.array(sim.astype(np.float64)))


def _flat(owner: np.ndarray, ids: pa.ChunkedArray | pa.Array, sims: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, sims = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, sims))
    return np.repeat(owner, np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy(), sims.flatten().to_numpy()


def _flags(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(bool)


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Directions (the greatest component is 1) and scales. A list of neighbours compares products of one direction with scaled ones."""
    return _unpacked(b"".join(column.to_pylist()), len(column))


def _unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    if not size:
        return np.zeros((0, 1), np.float32), np.zeros(0)
    rows = np.frombuffer(data, np.float16).reshape(size, -1)
    return rows[:, 4:].astype(np.float32), np.ascontiguousarray(rows[:, :4]).view(np.float64)[:, 0]


def _sampled(u: np.ndarray, w: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Places of up to `most` pairs of each u, chosen by a hash of the pair."""
    order = mix(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(w.astype(np.uint64) + np.uint64(seed)))
    by = np.lexsort((order, u))
    first = np.flatnonzero(np.concatenate([[True], u[by][1:] != u[by][:-1]])) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    return by[rank < most]


def _of(kind: np.ndarray, u: np.ndarray, w: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Places, ordered by u, of up to `most` pairs of each u among those of one kind."""
    among = np.flatnonzero(kind)
    return among[_sampled(u[among], w[among], most, seed)]


class Graph:
    """An NN-descent neighbour graph over nodes u; `names` has u and vec_id.

    The upper bits of a node's number are its block, the unit of work of a task. Blocks hold vectors of one direction, so
    most neighbours are in a node's own block and what a block needs from others is little.
    """

    def __init__(self, rows: DataFrame, names: DataFrame, k: int):
        self.rows, self.names, self.k = rows, names, k
        self.written, self.pairs = Written(), Written()
        self.blocks = names.agg(F.max(self._block("u"))).first()[0] + 1

    def _block(self, column: str):
        return F.shiftright(column, 32)

    def dealt(self, rows: DataFrame, block: str):
        """`rows` grouped by block. The number of tasks is stated, as blocks are little data and much work: by size, Spark would put many into one task."""
        tasks = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(max(1, min(tasks, self.blocks)), block).groupBy(block)

    def merged(self, found: DataFrame, sample: int = 0, seed: int = 0) -> None:
        """Takes the best `k` of the neighbours known and those of `found` (LISTS), which came of the `sample` of fresh ones by `seed`."""
        k = self.k

        def merge(rows: pa.Table) -> pa.Table:
            own = rows.filter(pa.compute.is_valid(rows.column("vec"))).sort_by("u")
            u, had = own.column("u").to_numpy(), _flat(own.column("u").to_numpy(), own.column("ids"), own.column("sims"))
            node, w, sim = top_of(*_flat(rows.column("u").to_numpy(), rows.column("ids"), rows.column("sims")), k)
            size = lambda owner: np.diff(np.append(np.searchsorted(owner, u), len(owner)))
            old = size(had[0])
            # Of equal products rounding decides, which is no progress.
            least = np.full(len(u), -np.inf)
            full = old >= k
            last = had[2][np.cumsum(old)[full] - 1]
            least[full] = last + 1e-5 * abs(last)
            at, names = np.searchsorted(u, node), np.unique(np.concatenate([w, had[1]]))
            pair = lambda i, x: i * len(names) + np.searchsorted(names, x)
            is_pair, was_pair = pair(at, w), pair(np.searchsorted(u, had[0]), had[1])
            gained = ~np.isin(is_pair, was_pair) & (sim > least[at])
            compared = ~_flags(own.column("fresh"))
            compared[_of(~compared, *had[:2], sample, seed)] = True
            fresh = ~np.isin(is_pair, was_pair[compared])
            ends = pa.array(np.concatenate([[0], np.cumsum(size(node))]).astype(np.int32))
            return pa.table({
                "u": own.column("u"), "vec": own.column("vec"), "ids": pa.ListArray.from_arrays(ends, pa.array(w)), "sims": pa.ListArray.from_arrays(ends, pa.array(sim)),
                "fresh": pa.ListArray.from_arrays(ends, pa.array(fresh)), "better": pa.array(np.bincount(at[gained], minlength=len(u))[: len(u)].astype(np.int32)),
            })

        both = self.rows.unionByName(found, allowMissingColumns=True)
        self.rows = self.written.replace(self.dealt(both.withColumn("b", self._block("u")), "b").applyInArrow(merge, GRAPH))
        tidy(self.rows.sparkSession)

    def progress(self) -> float:
        """Share of all places in the lists of neighbours that the last merge filled anew."""
        n, better = self.rows.agg(F.count(F.lit(1)), F.sum("better")).first()
        return (better or 0) / max(1, n * self.k)

    def edges(self, forward: int, back: int, seed: int, apart: bool = False) -> DataFrame:
        """(centre, member, fresh, b): of each vector `forward` of its neighbours and up to `back` of those it is a neighbour of.

        `apart`: as many of the fresh ones and of the others each; else fresh tells nothing.

        Both are chosen by a hash of the pair. Those that point to one vector are thinned out batch by batch and then in
        groups of 64 blocks, 64 groups and so on, so that a vector that all others point to is never gathered whole.
        """

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, w, _ = _flat(batch.column(0).to_numpy(), batch.column(1), batch.column(2))
                fresh = _flags(batch.column(3)) & apart
                ahead = np.concatenate([_of(fresh, u, w, forward, seed), _of(~fresh, u, w, forward, seed)])
                # With `apart`, those that are chosen are chosen for both of a pair.
                reverse = np.isin(np.arange(len(u)), ahead) if apart else np.ones(len(u), bool)
                behind = np.concatenate([_of(fresh & reverse, w, u, back, seed + 1), _of(~fresh & reverse, w, u, back, seed + 1)])
                side = np.repeat([False, True], [len(ahead), len(behind)])
                columns = np.concatenate([u[ahead], w[behind]]), np.concatenate([w[ahead], u[behind]]), fresh[np.concatenate([ahead, behind])], side
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["centre", "member", "fresh", "back"])

        both = self.rows.select("u", "ids", "sims", "fresh").mapInArrow(task, "centre long, member long, fresh boolean, back boolean")
        behind, shift = both.filter("back").select("centre", "member", "fresh"), 0
        chosen = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("centre", "member", F.lit(seed)).alias("h"), "member"))), 1, back)
        while (self.blocks >> shift) > 0:
            shift += 6
            behind = behind.groupBy("centre", "fresh", F.shiftright(self._block("member"), shift).alias("g")).agg(chosen.alias("x")).select("centre", F.explode("x.member").alias("member"), "fresh")
        return both.filter("NOT back").select("centre", "member", "fresh").unionByName(behind).withColumn("b", self._block("centre"))

    def with_vectors(self, edges: DataFrame) -> DataFrame:
        """block, node, vec, worst: the vectors that the centres of each block need, once a block."""
        worst = F.when(F.size("sims") >= self.k, F.element_at("sims", -1)).otherwise(F.lit(float("-inf")))
        needed = edges.select(F.col("b").alias("block"), F.col("member").alias("node")).distinct()
        return needed.join(self.rows.select(F.col("u").alias("node"), "vec", worst.alias("worst")), "node").select("block", "node", "vec", "worst")

    def descend(self, sample: int, each: int, seed: int) -> None:
        """One round: fresh members of a neighbourhood are compared with all its members, and better neighbours are taken over."""
        edges = self.pairs.replace(self.edges(sample, sample, seed, apart=True))

        def join(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
            ids = vectors.column("node").to_numpy()
            by = np.argsort(ids)
            x, scale = _vectors(vectors.column("vec"))
            ids, x, scale, worst = ids[by], x[by], scale[by], vectors.column("worst").to_numpy()[by]
            pair = np.stack([pairs.column("centre").to_numpy(), pairs.column("member").to_numpy()], axis=1)
            old = ~pairs.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
            by = np.lexsort((old, pair[:, 1], pair[:, 0]))
            pair, old = pair[by], old[by]
            once = np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)])
            pair, old = pair[once], old[once]
            centres = np.unique(pair[:, 0])

            def table(kind: np.ndarray) -> np.ndarray:
                chosen = pair[_of(kind, pair[:, 0], pair[:, 1], 2 * sample, seed + 2)]
                row, member = np.searchsorted(centres, chosen[:, 0]), np.searchsorted(ids, chosen[:, 1])
                first = np.searchsorted(row, np.arange(len(centres)))
                made = np.full((len(centres), 2 * sample), -1)
                made[row, np.arange(len(row)) - first[row]] = member
                return made

            fresh, others = table(~old), table(old)
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for a in range(0, len(centres), 2048):
                found = local_join(x, scale, fresh[a : a + 2048], others[a : a + 2048], worst, each)
                best = [*top_of(*[np.concatenate(c) for c in zip(best, found)], 3 * each)]
            nodes, lists, sims = _lists(ids[best[0]], ids[best[1]], best[2])
            return pa.table({"u": nodes, "ids": lists, "sims": sims})

        self.merged(self.dealt(edges, "b").cogroup(self.dealt(self.with_vectors(edges), "block")).applyInArrow(join, LISTS), sample, seed)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: a vector that is not null, has only finite numbers and is not zero; of rows of one vec_id the least vector."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("embedding")).filter(good)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build(vectors: DataFrame, k: int = 32, trees: int = 6, settled: float = 0.001, sample: int = 20, each: int = 8, leaf: int = 256, block: int = 4_096) -> Graph | None:
    """The graph of `vectors` (as from `usable`): each vector with about its `k` best by inner product; None without vectors.

    Vectors are dealt into blocks by the first signs of one projection, large cells by hash: one for each shuffle task,
    but of 512 vectors at least and `block` at most. Blocks need one another's vectors, so no more of them are made than can work.
    The graph starts from the best within hash classes (signs of random projections, `trees` of them, large classes dealt at
    random into leaves), and gets better in rounds of comparing neighbours of neighbours, `sample` each way, until a round
    changes no more than the share `settled` of all neighbours.
    """
    size, greatest, width = vectors.select(F.count(F.lit(1)), F.max(F.array_max(F.transform("embedding", F.abs))), F.max(F.size("embedding"))).first()
    if not size:
        return None
    leaf = min(leaf, max(8, size // 8))
    block = min(block, max(512, -(-size // int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    bits = max(1, int(np.log2(size / leaf)))
    axes = np.random.default_rng(7).normal(size=(trees, width, bits)).astype(np.float32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
            most = np.abs(x).max(axis=1, keepdims=True, initial=0)
            scale, x = np.maximum(most / greatest, np.finfo(np.float64).tiny), x / most
            codes = np.stack([(x @ a > 0) @ (1 << np.arange(a.shape[1])) for a in axes], axis=1)
            x = x.astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() + v.tobytes() for c, v in zip(scale, x)], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["vec_id", "vec", "codes"])

    packed = vectors.filter(F.size("embedding") == width).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, "vec_id long, vec binary, codes array<long>")
    fine = min(bits, max(0, int(np.ceil(np.log2(size / block)))))
    packed = cut(packed.withColumn("cell", F.shiftright(F.col("codes")[0], bits - fine)))
    cells = packed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    cells = cells.withColumn("first", F.sum("parts").over(Window.partitionBy(F.lit(0)).orderBy("cell")) - F.col("parts"))
    dealt = packed.join(cells, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    place = F.row_number().over(Window.partitionBy("block").orderBy("vec_id"))
    packed = cut(dealt.select((F.shiftleft("block", 32) + place).alias("u"), "vec_id", "vec", "codes"))
    keyed = packed.select("u", "vec", F.posexplode("codes").alias("tree", "code"))
    parts = keyed.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).alias("parts"))
    part = F.pmod(F.xxhash64("u", "tree"), F.col("parts"))
    bins = max(1, size * trees // 16_384)
    leaves = keyed.join(parts, ["tree", "code"]).select("u", "vec", F.xxhash64("tree", "code", part).alias("leaf"))

    def best(rows: pa.Table) -> pa.Table:
        leaf_of, u, (x, scale) = rows.column("leaf").to_numpy(), rows.column("u").to_numpy(), _vectors(rows.column("vec"))
        by = np.argsort(leaf_of, kind="stable")
        found = []
        for at in np.split(by, np.flatnonzero(np.diff(leaf_of[by])) + 1):
            s = (x[at] @ x[at].T) * scale[at]
            np.fill_diagonal(s, -np.inf)
            m = min(k, len(at) - 1)
            if m > 0:
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                found.append((np.repeat(u[at], m), u[at][top.ravel()], np.take_along_axis(s, top, 1).ravel()))
        flat = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        nodes, ids, sims = _lists(*top_of(*flat, k))
        return pa.table({"u": nodes, "ids": ids, "sims": sims})

    start = packed.select("u", "vec", F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("sims"), F.array().cast("array<boolean>").alias("fresh"), F.lit(0).alias("better"))
    graph = Graph(start, packed.select("u", "vec_id"), k)
    graph.merged(leaves.groupBy(F.pmod("leaf", F.lit(bins)).alias("bin")).applyInArrow(best, LISTS))
    for i in itertools.count():
        graph.descend(sample, each, 11 * i + 1)
        if graph.progress() <= settled:
            break
    return graph


STATE = "q long, vec binary, ids array<long>, sims array<double>, seen array<long>"
#: What a block opens, in rows of up to `PART` vectors: their numbers and vectors; in the first, its centres and the places of their members, which end at `ends`.
OPENED, PART = "b long, part int, ids binary, vecs binary, centres binary, ends binary, members binary", 8_192


def search(graph: Graph, queries: DataFrame, back: int = 24, held: int = 256, expand: int = 256) -> DataFrame:
    """STATE of each node that is in `queries` (u): the best found by greedy search from its own place in the graph.

    Each hop opens the `expand` best vectors of the `held` best that are not open yet: their neighbours, both ways, are
    compared with the query in the block of the opened vector. Queries end when all they hold is open.
    Only ids and inner products travel between hops, and the query's own vector.
    """
    edges = graph.pairs.replace(graph.edges(graph.k, back, 5))
    lists = edges.groupBy("b", "centre").agg(F.collect_set("member").alias("members"))
    rows = lists.select("b", F.col("centre").alias("id"), "members", F.lit(None).cast("binary").alias("vec")).unionByName(
        graph.with_vectors(edges).select(F.col("block").alias("b"), F.col("node").alias("id"), F.lit(None).cast("array<long>").alias("members"), "vec")
    )

    def together(block: pa.Table) -> pa.Table:
        is_vector = pa.compute.is_valid(block.column("vec"))
        vectors, centres = block.filter(is_vector).sort_by("id"), block.filter(pa.compute.invert(is_vector)).sort_by("id")
        ids, vecs, members = vectors.column("id").to_numpy(), vectors.column("vec").to_pylist(), centres.column("members").combine_chunks()
        ends, at = members.offsets.to_numpy().astype(np.int64), np.searchsorted(ids, members.flatten().to_numpy())
        first = [x.astype(np.int64).tobytes() for x in (centres.column("id").to_numpy(), ends - ends[0], at)]
        out = [(block.column("b")[0].as_py(), a // PART, ids[a : a + PART].tobytes(), b"".join(vecs[a : a + PART]), *(first if not a else [b""] * 3)) for a in range(0, len(ids), PART)]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["b", "part", "ids", "vecs", "centres", "ends", "members"])

    # Each hop reads this again; as a row a vector, dealing it took more time than the comparisons.
    opened = Written().replace(graph.dealt(rows, "b").applyInArrow(together, OPENED))
    table = Written()
    state = table.replace(graph.rows.join(queries, "u", "left_semi").select(F.col("u").alias("q"), "vec", "ids", "sims", F.array().cast("array<long>").alias("seen"), F.array("u").alias("next")))

    def hop(block: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "sims": pa.array([], pa.list_(pa.float64()))})
        if not len(asked) or not len(block):
            return none
        block = block.sort_by("part")
        ids, centre, ends, flat = (np.frombuffer(b"".join(block.column(c).to_pylist()), np.int64) for c in ("ids", "centres", "ends", "members"))
        x, scale = _unpacked(b"".join(block.column("vecs").to_pylist()), len(ids))
        qs, worst, mine = asked.column("q").to_numpy(), asked.column("worst").to_numpy(), _vectors(asked.column("vec"))[0]
        nodes = asked.column("nodes").combine_chunks()
        found = []
        bounds = nodes.offsets.to_numpy() - nodes.offsets.to_numpy()[0]
        at = np.searchsorted(centre, nodes.flatten().to_numpy())
        for i in range(len(qs)):
            mine_at = [p for p in at[bounds[i] : bounds[i + 1]] if p < len(centre)]
            if not mine_at:
                continue
            near = np.unique(np.concatenate([flat[ends[p] : ends[p + 1]] for p in mine_at]))
            sim = (x[near] @ mine[i]) * scale[near]
            good = (sim > worst[i]) & (ids[near] != qs[i])
            found.append((np.full(good.sum(), qs[i]), ids[near][good], sim[good]))
        if not found:
            return none
        q, ws, sims = _lists(*top_of(*[np.concatenate(c) for c in zip(*found)], held))
        return pa.table({"q": q, "ids": ws, "sims": sims})

    def advance(rows: pa.Table) -> pa.Table:
        q = rows.column("q").to_numpy()
        best = top_of(*_flat(q, rows.column("ids"), rows.column("sims")), held)
        own = rows.filter(pa.compute.is_valid(rows.column("vec")))
        out: dict[str, list] = {c: [] for c in ("q", "vec", "ids", "sims", "seen", "next")}
        for r in own.to_pylist():
            a, b = np.searchsorted(best[0], r["q"]), np.searchsorted(best[0], r["q"], side="right")
            seen = r["seen"] + r["next"]
            closed = set(seen)
            fresh = [w for w in best[1][a:b].tolist() if w not in closed][:expand]
            for c, v in zip(out, (r["q"], r["vec"], best[1][a:b].tolist(), best[2][a:b].tolist(), seen, fresh)):
                out[c].append(v)
        kinds = {"q": pa.int64(), "vec": pa.binary(), "ids": pa.list_(pa.int64()), "sims": pa.list_(pa.float64()), "seen": pa.list_(pa.int64()), "next": pa.list_(pa.int64())}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    while True:
        worst = F.when(F.size("sims") >= held, F.element_at("sims", -1)).otherwise(F.lit(float("-inf")))
        asked = state.filter(F.size("next") > 0).select("q", "vec", worst.alias("worst"), F.explode("next").alias("node"))
        asked = asked.groupBy("q", "vec", "worst", graph._block("node").alias("block")).agg(F.collect_list("node").alias("nodes"))
        found = graph.dealt(opened, "b").cogroup(graph.dealt(asked, "block")).applyInArrow(hop, "q long, ids array<long>, sims array<double>")
        both = state.unionByName(found, allowMissingColumns=True)
        state = table.replace(graph.dealt(both.withColumn("b", graph._block("q")), "b").applyInArrow(advance, STATE + ", next array<long>"))
        tidy(state.sparkSession)
        if state.filter(F.size("next") > 0).isEmpty():
            break
    return state.drop("next")


def nearest(vectors: DataFrame, is_query, k: int = 20, few: int = 64, **build_options) -> DataFrame:
    """The `k` nearest found of each row of `vectors` (vec_id, embedding) for which the column `is_query` holds.

    Nearness is the inner product in double precision; candidates are all rows of the query's length but its own.
    Returns query_id, rank, vec_id, score by falling score, ties by vec_id. Vectors that are null, zero or hold null or
    non-finite numbers take no part; of rows of one vec_id one does. Each length has a graph of its own, but those
    of up to `few` vectors, which a graph of 32 neighbours would hold in full anyway, are compared with one another. Graph and search use directions in half precision with a scale for each vector; all
    that a search holds at its end is scored on the original vectors. An empty table gives no rows; other columns are
    ignored.
    """
    good = cut(usable(vectors).withColumn("vec_id", F.col("vec_id").cast("long")))
    lengths = good.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    large = [r["n"] for r in lengths.filter(F.col("rows") > few).collect()]
    small = good.filter(~F.size("embedding").isin(large)).select("vec_id", F.size("embedding").alias("n"))
    pairs = small.filter(is_query).withColumnRenamed("vec_id", "query_id").join(small, "n").filter("query_id != vec_id").select("query_id", "vec_id")
    for n in large:
        graph = build(good.filter(F.size("embedding") == n), **build_options)
        names = graph.names
        found = search(graph, names.join(good.filter(is_query).select("vec_id"), "vec_id", "left_semi").select("u"))
        held = found.select("q", F.explode("ids").alias("u")).join(names, "u").drop("u")
        pairs = pairs.unionByName(held.join(names.select(F.col("u").alias("q"), F.col("vec_id").alias("query_id")), "q").select("query_id", "vec_id"))
    pairs = pairs.join(good.withColumnRenamed("embedding", "_w"), "vec_id").join(good.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    score = F.aggregate(F.zip_with("_q", "_w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ranked = pairs.select("query_id", "vec_id", score.alias("score"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    top = ranked.groupBy("query_id").agg(F.slice(best, 1, k).alias("_top"))
    return top.select("query_id", F.posexplode("_top").alias("_at", "_x")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), (-F.col("_x.s")).alias("score"))
