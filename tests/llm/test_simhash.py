"""SimHash classes against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tidewater.llm import queries, simhash

SPACES = " \t\n\v\f\r"


def fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """least id of the class of each (id, fingerprint), ids not null."""
    parent = {i: i for i, _ in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, x) in enumerate(prints):
        for j, y in prints[:n]:
            if (x ^ y).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in prints}


def test_golay_code_is_perfect():
    x = np.arange(1 << 23)
    counts = np.bincount(simhash.decode(x), minlength=1 << 12)
    assert len(counts) == 1 << 12 and set(counts.tolist()) == {1 << 11}
    _, size = np.unique(simhash.ball(x[::97], 23)[0], return_counts=True)
    assert size.max() == 6


def test_keys_of_any_four_errors_meet():
    rng = random.Random(3)
    for errors in range(5):
        for _ in range(400):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), errors):
                y ^= 1 << b
            row, key, side = simhash.golay_keys(np.array([x, y], np.uint64).view(np.int64))
            has = {(r, s): {k for r2, k, s2 in zip(row.tolist(), key.tolist(), side.tolist()) if (r2, s2) == (r, s)} for r in (0, 1) for s in (0, 1, 2)}
            assert has[0, 0] & has[1, 0] or has[0, 1] & has[1, 2]
            assert bool(has[0, 0] & has[1, 0] or has[0, 2] & has[1, 1])


def test_odd_texts(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefgh") * 3 for _ in range(300_000))
    texts = [None, "", " \t\n", "One", "one", "a b c", "A  b\tc", "a b c d", "é É x y z", "x y z w v", long, long + " end"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, "One", "x", "y"), (None, "a b c", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component string").repartition(5)
    got = sorted(simhash.near_classes(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    assert [r.fingerprint & (2**64 - 1) for r in got] == [fingerprint(t) for t in (*texts[:4], "One", *texts[4:], "a b c")]
    least = brute([(i, fingerprint(t)) for i, t in enumerate(texts)])
    assert [r.component_id for r in got[:-1]] == [least[r.doc_id] for r in got[:-1]] and got[-1].component_id == least[5]
    assert least[1] == least[2] == 0 and least[4] == 3 and least[6] == 5
    assert simhash.near_classes(df.limit(0)).count() == 0


def test_dense_group_against_brute_force(spark):
    """Fingerprints scattered about a few centres: chains of links as well as groups."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted(prints, key=signed)
    for most in (1, 4):
        df = spark.createDataFrame([(signed(x),) for x in rows], "fingerprint long")
        got = {r.fingerprint: r.component for r in simhash.linked(df, most).collect()}
        parent = {x: x for x in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for n, x in enumerate(rows):
            for y in rows[:n]:
                if (x ^ y).bit_count() <= most:
                    a, b = sorted((root(x), root(y)), key=signed)
                    parent[b] = a
        assert got == {signed(x): signed(root(x)) for x in rows}
    with pytest.raises(ValueError):
        simhash.near_classes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), most=5)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in docs]
    least = brute(prints)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op11_simhash(spark, sf).collect()}
    assert got == {(i, f"{x:016x}", least[i]) for i, x in prints}
