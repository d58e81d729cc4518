"""Merkle manifest against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest

from tidewater.llm import merkle, queries

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return out


def expected(rows):
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, mine, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way = path(trees[s], i) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], lower(r[4]))) if hit else mine
            for a, b in way:
                node = h(a, node, b)
            out.append((str(r[0]), mine, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in way)), node, node == top[-1][0]))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096])
def test_traversal(n):
    leaves = [h(str(i)) for i in range(n)]
    tree, height = levels(leaves), merkle.height_of(n)
    assert merkle.root_of(leaves, height) == tree[-1][0]
    for i, found in enumerate(merkle.traverse(leaves, height)):
        own = [("".join(a), "".join(b)) for a, b in found]
        assert own == path(tree, i) and merkle.fold(leaves[i], own) == tree[-1][0]


def test_traversal_of_block_that_is_not_the_last():
    """A short last block of a larger tree still has HEIGHT levels: lone nodes are hashed alone."""
    leaves = [h(str(i)) for i in range(4096 + 3)]
    tree = levels(leaves)
    assert merkle.root_of(leaves[4096:], 3) == tree[3][1] and len(tree[3]) == 2
    for i, found in enumerate(merkle.traverse(leaves[4096:], 3)):
        assert [("".join(a), "".join(b)) for a, b in found] == path(tree, 4096 + i)[:3]


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "a", "Ä", "zz"]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "Text ÄB", "x" * 10, "lower"])) for i in range(300)]
    rows += [(None, "a", "en", 1, "NULL id"), (None, "a", "en", 1, "NULL id"), rows[5], rows[5], (7, "a", None, 1, "A" * 2_000_000), (-5, "lone", "en", 2**40, "é")]
    rows += [(2**50 + i, f"s{i:03d}", "en", 1, "Many Sources") for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{FIELDS}, leaf string, pos int").repartition(6)
    assert result(merkle.audited(df)) == expected(rows)
    assert merkle.audited(df.limit(0)).count() == 0
    one = rows[:1]
    assert result(merkle.audited(spark.createDataFrame(one, FIELDS))) == expected(one)


def test_source_over_several_blocks(spark):
    rows = [(i, "big" if i % 9 else "small", "en", 5, f"Text {i}") for i in range(5200)]
    assert result(merkle.audited(spark.createDataFrame(rows, FIELDS).repartition(7))) == expected(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert result(queries.op13_merkle(spark, sf)) == expected(rows)
