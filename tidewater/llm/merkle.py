"""Merkle manifest of a dataset: authentication paths of all rows by traversal of aligned blocks of leaves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small

#: Children of a node, levels of a block and leaves of a block.
ARITY, HEIGHT = 16, 3
BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(row: dict[str, Column]) -> Column:
    """SHA-256 of the FIELDS of a row, each '-' if null, else its UTF-8 length, ':' and its value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in (row[f] for f in FIELDS)]
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Treehash:
    """Nodes of one level from the leaves below, one leaf at a time; it holds under ARITY nodes of each level."""

    level: int
    held: list[list[str]] = field(init=False)
    done: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.held = [[] for _ in range(self.level)]

    def _put(self, node: str, at: int) -> None:
        while at < self.level:
            self.held[at].append(node)
            if len(self.held[at]) < ARITY:
                return
            node = digest(*self.held[at])
            self.held[at].clear()
            at += 1
        self.done.append(node)

    def add(self, leaf: str) -> None:
        self._put(leaf, 0)

    def close(self) -> None:
        """After the last leaf: runs that are not full become nodes, too."""
        for at in range(self.level):
            if self.held[at]:
                node = digest(*self.held[at])
                self.held[at].clear()
                self._put(node, at + 1)


def root_of(leaves: Iterable[str], height: int) -> str:
    """Node `height` levels over `leaves`, at most ARITY ** height of them, by one treehash stack."""
    stack = Treehash(height)
    for leaf in leaves:
        stack.add(leaf)
    stack.close()
    return stack.done[0]


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[list[str], list[str]]]]:
    """For each leaf its authentication path: by level the siblings (left, right) in its run of ARITY nodes.

    Each level holds the run that the path is in, and a treehash that makes the next one. A run of level h lasts for
    ARITY ** (h + 1) leaves; in that time its treehash takes as many leaves further on, one a step, and so has the next
    run when the path gets there. Runs and stacks hold under ARITY * height ** 2 nodes.
    """
    n, span = len(leaves), [ARITY ** (h + 1) for h in range(height)]
    current: list[list[str]] = [[] for _ in range(height)]
    coming = [Treehash(h) for h in range(height)]
    taken = [0] * height

    def take(h: int) -> None:
        if taken[h] < n:
            coming[h].add(leaves[taken[h]])
            taken[h] += 1
            if taken[h] == n:
                coming[h].close()

    for h in range(height):
        for _ in range(span[h]):
            take(h)
    for i in range(n):
        for h in range(height):
            if i % span[h] == 0:
                current[h], coming[h].done = coming[h].done, []
            take(h)
        at = [i // ARITY**h % ARITY for h in range(height)]
        yield [(run[:k], run[k + 1 :]) for run, k in zip(current, at)]


def fold(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    """Root that a leaf and its path (siblings to the left and right, joined) give."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `pos`, their number from 0 within `group` by `order`, and `m`, the rows of the group.

    Rows are dealt by ranges of group and order; ranges count their rows and are added up, so no group is in one task.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))  # equal rows can be dealt apart
    ranged = salted.repartitionByRange(parts, group, *order, "_salt").sortWithinPartitions(group, *order, "_salt").drop("_salt")
    ranged = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    counts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part")
    every = Window.partitionBy(group)
    starts = counts.select(group, "_part", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("m"))
    both = join_small(ranged, cut(starts), [group, "_part"])
    return both.withColumn("pos", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def height_of(m: int) -> int:
    """Levels of a block of a group of `m` nodes: those to the group's one node, HEIGHT at most."""
    height = 0
    while m > 1 and height < HEIGHT:
        m, height = -(-m // ARITY), height + 1
    return height


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("pos", "ascending")])


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """`nodes` (grp, pos, m, node) and, each made of the one before by blocks, tiers of fewer, up to one node a group."""
    tiers = [nodes]

    def climb(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        m = rows.column("m")[0].as_py()
        top = root_of((x.as_py() for x in _sorted(rows).column("node")), height_of(m))
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "m": pa.array([-(-m // BLOCK)], pa.int64()), "node": pa.array([top], pa.string())})

    while not tiers[-1].filter("m > 1").isEmpty():
        last = tiers[-1].select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "m", "node")
        tiers.append(cut(last.groupBy("grp", "block").applyInArrow(climb, "grp string, pos long, m long, node string")))
    return tiers


PATH = "array<struct<left:string,right:string>>"


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """grp, pos, node and path of `nodes`: siblings within their block, then the path of the block out of `above` (grp, pos, path)."""

    def extend(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        leaves, rest = rows.column("node").to_pylist(), upper.column("path")[0].as_py()
        paths = [[{"left": "".join(a), "right": "".join(b)} for a, b in path] + rest for path in traverse(leaves, height_of(rows.column("m")[0].as_py()))]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"grp": rows.column("grp"), "pos": rows.column("pos"), "path": pa.array(paths, kind)})

    blocks = nodes.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "m", "node").groupBy("grp", "block")
    return blocks.cogroup(above.groupBy("grp", "pos")).applyInArrow(extend, f"grp string, pos long, path {PATH}")


def _down(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the second tier's nodes, those over the blocks of the first, from `top` (grp, pos, path): paths of the last tier's."""
    for nodes in reversed(tiers[1:-1]):
        top = cut(_paths(nodes, top))
    return top


@dataclass
class Manifest:
    """leaves (numbered within sources, with all columns given), subroots (grp, subroot), root, and above: paths of blocks of leaves."""

    leaves: DataFrame
    subroots: DataFrame
    above: DataFrame
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """Manifest of `leaves` (doc_id, source, leaf and any others): a tree for each source by doc_id, and one of their roots by source.

    While several nodes remain, each ARITY consecutive ones become their SHA-256 (the last run may be shorter, even of
    one). Sources are ordered by their UTF-8 bytes, null first, and leaves by doc_id (null first), then leaf. An empty
    table has no root.
    """
    grp = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rows = numbered(leaves.withColumn("grp", grp), "grp", ["doc_id", "leaf"])
    tiers = _tiers(rows.select("grp", "pos", "m", F.col("leaf").alias("node")))
    subroots = cut(tiers[-1].filter("pos = 0").select("grp", F.col("node").alias("subroot")))
    shared = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("subroot").alias("node")), "grp", ["of"])
    shared = cut(shared)
    over = _tiers(shared.select("grp", "pos", "m", "node"))
    last = over[-1].first()
    no_path = F.array().cast(PATH).alias("path")
    top = over[-1].select("grp", "pos", no_path)
    if len(over) > 1:
        top = _paths(over[0], _down(over, top))
    of_source = cut(shared.select("of", "pos").join(top.select("pos", "path"), "pos").select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path"))
    return Manifest(rows, subroots, _down(tiers, of_source), last["node"] if last else None)


def prove(manifest: Manifest, changed: str | None = None) -> DataFrame:
    """The rows of `manifest.leaves` with proof_sha256 (of all siblings, level by level, left to right) and folded_root.

    folded_root is recomputed from the column `changed` where that is given and not null, else from `leaf`, with the
    siblings of the untampered tree: it is the root just if the leaf is unchanged. Blocks of leaves are traversed leaf by
    leaf, and the path that their block shares is appended.
    """
    kept = [c for c in manifest.leaves.columns if c not in ("grp", "pos", "m")]
    rows = manifest.leaves.select("grp", F.floor(F.col("pos") / BLOCK).alias("_block"), "pos", "m", "leaf", F.col(changed or "leaf").alias("_changed"), *[F.col(c).alias(f"k_{c}") for c in kept])
    schema = rows.drop("_block", "m", "leaf", "_changed").withColumn("proof_sha256", F.lit("")).withColumn("folded_root", F.lit("")).schema

    def walk(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = _sorted(table)
        shared = [(x["left"], x["right"]) for x in upper.column("path")[0].as_py()]
        leaves, news = table.column("leaf").to_pylist(), table.column("_changed").to_pylist()
        proofs, roots = [], []
        above = "".join(a + b for a, b in shared)
        for leaf, new, path in zip(leaves, news, traverse(leaves, height_of(table.column("m")[0].as_py()))):
            own = [("".join(a), "".join(b)) for a, b in path]
            proofs.append(digest(*(a + b for a, b in own), above))
            roots.append(fold(leaf if new is None else new, own + shared))
        rest = [table.column(c) for c in schema.names[:-2]]
        return pa.Table.from_arrays([*rest, pa.array(proofs, pa.string()), pa.array(roots, pa.string())], names=schema.names)

    done = rows.groupBy("grp", "_block").cogroup(manifest.above.groupBy("grp", "pos")).applyInArrow(walk, schema)
    return join_small(done, manifest.subroots, "grp").select(*[F.col(f"k_{c}").alias(c) for c in kept], "subroot", F.lit(manifest.root).alias("root"), "proof_sha256", "folded_root")


def audited(docs: DataFrame, one_in: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of `docs` (FIELDS), some of them tampered with.

    Of rows where `one_in` divides the CRC-32 of the decimal doc_id, the leaf to verify is made of the text with A-Z
    lower-cased (null texts and texts without such letters are as before). verified: folded_root is root. Null ids are
    not tampered with; repeated rows are leaves of their own; an empty table gives no rows; other columns are ignored.
    """
    row = {c: F.col(c) for c in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % one_in == 0
    other = leaf_digest(row | {"text": F.translate("text", LETTERS.upper(), LETTERS)})
    leaves = docs.select("doc_id", "source", leaf_digest(row).alias("leaf"), F.when(tampered, other).alias("changed"))
    done = prove(build(leaves), "changed")
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
