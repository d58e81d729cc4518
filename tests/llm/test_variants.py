"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from tidewater.llm import queries, variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, times=5):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(((-counts[v], v) for v in vs), default=None)
        form[w] = best[1] if best and -best[0] >= times * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def counted(rows, length=6, least=5):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_random_words_with_blocks(spark):
    """All edits, chains of forms, ties and letters that share a bit; sets cut into blocks."""
    rng = random.Random(2)
    letters = "abcdeàéðþÿ÷" + "".join(chr(0xC0 + 34 + i) for i in range(3))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(25)]
    words = {}
    for w in base:
        for k in range(12):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            x = w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind != 2) :]
            words[x] = rng.choice([1, 2, 10, 60, 400])
            if k % 4 == 0:
                w = x
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(variants.spelling_forms(df)) == expected(words)
    pairs = lambda **o: sorted(tuple(sorted((r.a, r.b))) for r in variants.near_pairs(df, **o).collect())
    every = sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
    assert every and pairs() == every and pairs(block=7, bin_rows=50) == every


def test_odd_texts(spark):
    long = "Wörterbuch " * 50_000 + "z" * 100_000
    rows = [(1, None), (2, ""), (3, "12 ..."), (4, "WORDING wording wOrding " * 3), (4, "WORDING wording wOrding " * 3), (None, "wordin " * 6), (7, long), (8, "ÀÉÎÕÜß " * 9 + "àéîõüß " * 9), (9, "x ab " * 50)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert result(variants.spelling_variants(df)) == expected(counted(rows))
    assert result(variants.spelling_variants(df, least_length=1, least=1)) == expected(counted(rows, 1, 1))
    assert variants.spelling_variants(df.limit(0)).count() == 0
    assert variants.spelling_variants(df.filter("doc_id = 3")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op12_spelling_variants(spark, sf)) == expected(counted(rows))
