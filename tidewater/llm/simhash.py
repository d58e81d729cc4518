"""SimHash fingerprints of texts and their near-duplicate classes by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small
from tidewater.llm.graph import components
from tidewater.llm.vector import lean, slices

#: Generator polynomial of the binary Golay code of 23 bits: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0xC75
#: (first bit, bits) of the segments of a fingerprint. Links differ in at most MOST bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MOST = 4
SEED = 42
#: Shingles whose bits are counted in one step.
PIECE = 1 << 16


def simhash(text: bytes, k: int) -> int:
    """Fingerprint of a text: a bit is set if over half of the XXH64 hashes of its `k`-word shingles have it."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(found) - k + 1)
    stops = ends[min(k, len(found)) - 1 :]
    counts = np.zeros(64, np.int64)
    for a in range(0, n, PIECE):
        cuts = zip(starts[a : min(n, a + PIECE)].tolist(), stops[a : a + PIECE].tolist())
        h = np.array([xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in cuts], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id and fingerprint (64 bits as a signed long) of each row of `docs` (doc_id, text).

    A text without words and a null text have fingerprint 0; a text of fewer than `k` words is one shingle. Rows and
    null ids stay as they are; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [simhash(x, k) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", text.alias("text")).mapInArrow(lean(task), f"doc_id {kind}, fingerprint long")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of the upper 12 bits of a word, the one error pattern of at most three bits for each syndrome)."""
    shifts = [1 << i for i in range(11)]
    for _ in range(12):
        x = shifts[-1] << 1
        shifts.append(x ^ GOLAY if x >> 11 else x)
    upper = np.zeros(1 << 12, np.int64)
    for i in range(12):
        upper[np.arange(1 << 12) >> i & 1 == 1] ^= shifts[11 + i]
    error = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= shifts[b]
            error[syndrome] = sum(1 << b for b in bits)
    return upper, error


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each word of 23 bits: the code is perfect, so there is one within three bits."""
    upper, error = _tables()
    return (x ^ error[upper[x >> 11] ^ (x & 0x7FF)]) >> 11


def ball(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the codewords nearest to the words within one bit of each of `x`: six of them at most.

    Two words that differ in at most two bits have a word within one bit of both, so an index in common; one of two
    words that differ in at most one bit has the other's own index.
    """
    near = np.sort(np.stack([decode(x), *(decode(x ^ (1 << b)) for b in range(bits))], axis=1), axis=1)
    fresh = np.concatenate([np.ones((len(x), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    row, at = np.nonzero(fresh)
    return row, near[row, at]


#: Sides of a key: it is compared with all of its kind, or those of one side with those of the other.
BOTH, LEFT, RIGHT = 0, 1, 2


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) so that fingerprints of at most MOST differing bits have a key in common.

    At most four errors fall on three segments. If one segment has none, another has at most two: the key is the first
    one's bits beside each index of the other's `ball` (12 + 18 bits or more, about 5 keys for each of 6 ordered
    pairs). Else two segments have one error each, and the key is 24 bits of their indices: one fingerprint has the
    own index of the first segment and the ball of the second, the other one the reverse (LEFT and RIGHT, about
    5 keys each for each of 3 pairs).
    """
    x = x.view(np.uint64)
    parts = [((x >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64) for first, bits in SEGMENTS]
    own, balls = [decode(p) for p in parts], [ball(p, bits) for p, (_, bits) in zip(parts, SEGMENTS)]
    rows, keys, sides = [], [], []

    def add(tag: int, row: np.ndarray, upper: np.ndarray, lower: np.ndarray, side: int) -> None:
        rows.append(row)
        keys.append((tag << 40) | (upper << 23) | lower)
        sides.append(np.full(len(row), side, np.int8))

    for tag, (near, same) in enumerate(permutations(range(3), 2)):
        row, index = balls[near]
        add(tag, row, index, parts[same][row], BOTH)
    for tag, (i, j) in enumerate(combinations(range(3), 2), 6):
        (row_i, index_i), (row_j, index_j) = balls[i], balls[j]
        add(tag, row_j, index_j, own[i][row_j], LEFT)
        add(tag, row_i, own[j][row_i], index_i, RIGHT)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def keyed(nodes: DataFrame) -> DataFrame:
    """fingerprint, component, key and side of the Golay keys of `nodes` (fingerprint, component)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                row, key, side = golay_keys(part.column(0).to_numpy())
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(key), pa.array(side)], names=["fingerprint", "component", "key", "side"])

    return nodes.select("fingerprint", "component").mapInArrow(task, "fingerprint long, component long, key long, side byte")


def _merged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` with the components that `edges` (u, v) between components join."""
    found = components(edges).withColumnRenamed("component", "_new")
    both = join_small(nodes, cut(found.filter("node != _new")), nodes["component"] == F.col("node"), "left", most=500_000)
    return cut(both.select("fingerprint", F.coalesce("_new", "component").alias("component")))


def linked(prints: DataFrame, most: int = MOST, rounds: int = 1) -> DataFrame:
    """fingerprint and component (its least fingerprint, as a signed long) of distinct `prints`: links of at most `most` differing bits.

    Of all fingerprints of a key, each is first compared with one, another one each round; most of a dense group is one
    component after that, by work in proportion to the keys. Then fingerprints of a key that are in different
    components are compared pair by pair, so all links between components are found and no others are asked for.
    """
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most
    nodes = cut(prints.select("fingerprint").distinct().withColumn("component", F.col("fingerprint")))
    for i in range(rounds):
        keys = keyed(nodes).filter(F.col("side") == BOTH).select("key", "fingerprint", "component")
        first = F.min_by(F.struct("fingerprint", "component"), F.xxhash64("fingerprint", F.lit(i)))
        heads = keys.groupBy("key").agg(first.alias("h"), F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a != _b")
        heads = heads.select("key", F.col("h.fingerprint").alias("head"), F.col("h.component").alias("v"))
        met = keys.join(heads, "key").filter((F.col("component") != F.col("v")) & close("fingerprint", "head"))
        nodes = _merged(nodes, met.select(F.col("component").alias("u"), "v").distinct())
    keys = keyed(nodes)
    left = keys.filter(F.col("side") != RIGHT).select("key", F.col("fingerprint").alias("a"), F.col("component").alias("u"))
    right = keys.filter(F.col("side") != LEFT).select("key", F.col("fingerprint").alias("b"), F.col("component").alias("v"))
    met = left.join(right, "key").filter((F.col("u") != F.col("v")) & (F.col("a") < F.col("b")) & close("a", "b"))
    return _merged(nodes, met.select("u", "v").distinct())


def near_classes(docs: DataFrame, k: int = 4, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of each row of `docs` (doc_id, text).

    Rows whose fingerprints (`fingerprints`) differ in at most `most` <= 4 bits link; component_id is the least doc_id
    that links reach. Equal fingerprints are one node, however many rows have them; nodes meet by Golay keys
    (`golay_keys`), are verified by their differing bits (`linked`) and joined by components. Texts without words have
    fingerprint 0 and link like any other. Null ids are never the least, unless a component has no other (then null);
    repeated rows are in one component; an empty table gives no rows; other columns are ignored.
    """
    if not 0 <= most <= MOST:
        raise ValueError(f"keys are complete for at most {MOST} differing bits")
    rows = cut(fingerprints(docs, k))
    nodes = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows")))
    named = cut(nodes.join(linked(nodes, most), "fingerprint"))
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"), F.sum("_rows").alias("_all")).filter("_all > 1")
    more = cut(named.join(least, "component").select(F.col("fingerprint").alias("_print"), "component_id", F.lit(True).alias("_found")))
    done = join_small(rows, more, F.col("fingerprint") == F.col("_print"), "left", most=500_000)
    return done.select("doc_id", "fingerprint", F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
