"""Seeded draws; search by edit distance, words and sound; both against brute force."""

import random
from bisect import bisect_right
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tidewater.functions import fuzzy
from tidewater.operators import draws, fuzzy_join


def stream(seed, n):
    """The generator as a state that goes on, in plain integers."""
    word, state = 2**32, seed % 2**32 or 0x6D2B79F5
    for _ in range(n):
        state = (state + 0x6D2B79F5) % word
        t = (state ^ state >> 15) * (state | 1) % word
        t ^= (t + (t ^ t >> 7) * (t | 61)) % word
        yield t ^ t >> 14


@pytest.mark.parametrize("seed", [0, 1, 42, -7, 2**32 - 1])
def test_numbers_by_draw(spark, seed):
    assert [r.random for r in draws.numbers(spark, 500, seed).orderBy("draw").collect()] == list(stream(seed, 500))


@pytest.mark.parametrize("weights", [None, [0, 3, 1, None, 1000, 5, 0, 2.5] * 50, [1e-9] * 399 + [1e6]])
def test_draws_under_any_partitioning(spark, weights):
    rows = [(i % 7, i, None if weights is None or weights[i] is None else float(weights[i]), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "k int, id int, w double, _row string")
    weight = None if weights is None else "w"
    got = [sorted((r.draw, r.id, r._row) for r in draws.sample_draws(df.repartition(p), 3000, ["k", "id"], 11, weight).collect()) for p in (1, 5, 16)]
    ordered = sorted(rows)
    ends = list(accumulate(1.0 if weights is None else r[2] or 0.0 for r in ordered))
    expected = [ordered[bisect_right(ends, x / 2**32 * ends[-1])][1] for x in stream(11, 3000)]
    assert got[0] == got[1] == got[2] and [x[1] for x in got[0]] == expected and [x[0] for x in got[0]] == list(range(3000))


def test_draws_of_odd_frames(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (None, 0.0)], "id int, w double")
    assert draws.sample_draws(df.limit(0), 5, ["id"]).count() == 0 and draws.sample_draws(df, 0, ["id"]).count() == 0
    assert {r.id for r in draws.sample_draws(df, 50, ["id"], 3, "w", "w_number").collect()} == {1}
    for bad in (float("nan"), float("inf"), -1.0):
        with pytest.raises(ValueError):
            draws.sample_draws(df.withColumn("w", F.lit(bad)), 1, ["id"], weight="w")
    with pytest.raises(ValueError):
        draws.sample_draws(df.filter("id IS NULL"), 1, ["id"], weight="w")


def swaps(a, b):
    """The definition, a cell at a time."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


def texts():
    rng = random.Random(5)
    some = ["", "a", "ab", "ba", "ca", "abc", "aaaa", "aaaab", "red ring", "rde ring", "ring red", "Äpfel 😀", "Äpfle 😀", "Robert", "Rupert", "a\x01b", "a\x01\x01b"]
    for _ in range(40):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 24)))
        cut = rng.randrange(len(base) + 1)
        some += [base, base[:cut] + rng.choice("abcd") + base[cut:], base[:cut][::-1][:2][::-1] + base[cut:], base[:cut] + base[cut : cut + 2][::-1] + base[cut + 2 :]]
    return some


def test_swap_distances(spark):
    some = texts()
    pairs = [(a, b) for a in some[::3] for b in some[::5]] + [(None, "a"), ("a", None), ("x" * 3000, "x" * 2999 + "y")]
    found = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(fuzzy.damerau("a", "b")).collect()]
    assert found == [swaps(a, b) for a, b in pairs[:-3]] + [None, None, 1]


@pytest.mark.parametrize("method", fuzzy_join.METHODS)
@pytest.mark.parametrize("least", [0.3, 0.7, 0.9])
def test_search_finds_what_all_pairs_give(spark, method, least):
    some = texts()
    a, b = some[::2] + [None, "ab"], some
    sound = dict(spark.createDataFrame([(t,) for t in {*a, *b} - {None}], "t string").select("t", fuzzy.soundex(F.col("t"))).collect()) if method == "soundex" else {}

    def score(x, y):
        if method == "soundex":
            return float(sum(p != q for p, q in zip(sound[x], sound[y])) <= 1)
        if method == "jaccard":
            p, q = set(x.split()), set(y.split())
            return len(p & q) / len(p | q) if p | q else 0.0
        if not x or not y:
            return 0.0
        return 1 - edits(x, y) / max(len(x), len(y)) if method == "levenshtein" else 1 - swaps(x, y) / min(len(x), len(y))

    expected = {(x, y, round(s, 3)) for x in {*a} - {None} for y in {*b} if (s := int(score(x, y) * 1000 + 0.5) / 1000) >= least}
    found = fuzzy_join.search(spark.createDataFrame([(t,) for t in a], "q string"), "q", spark.createDataFrame([(t,) for t in b], "q string"), "q", method, least)
    assert sorted((r.query, r.text, round(r.score, 3)) for r in found.collect()) == sorted(expected)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert all(fuzzy_join.search(df, "t", df.limit(0), "t", m).count() == 0 for m in fuzzy_join.METHODS)
    for wrong in ({"method": "other"}, {"least": 0.0}):
        with pytest.raises(ValueError):
            fuzzy_join.search(df, "t", df, "t", **wrong)


def test_names_one_edit_apart_make_no_other_candidates(spark, monkeypatch):
    made, pairs = [], fuzzy_join._pairs

    def counted(*args):
        found = pairs(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(fuzzy_join, "_pairs", counted)
    names = spark.range(0, 600).select(F.format_string("Customer#%09d", "id").alias("t"))
    found = fuzzy_join.search(names, "t", names, "t", "damerau", 0.9).collect()
    texts = [f"Customer#{i:09d}" for i in range(600)]
    assert sorted((r.query, r.text) for r in found) == sorted((a, b) for a in texts for b in texts if swaps(a[-3:], b[-3:]) <= 1)
    assert sum(made) <= len(found)


@pytest.mark.parametrize("least", [0.9, 0.97, 1.0])
@pytest.mark.parametrize("method", ["levenshtein", "damerau"])
def test_search_by_edits_on_either_side_of_the_cut(spark, method, least):
    rng = random.Random(7)
    some = []
    for n in [*range(1, 24), 33, 34, 63, 64, 65, 66]:
        base = "".join(rng.choice("aab😀") for _ in range(n))
        k, m = rng.randrange(n), rng.randrange(n)
        some += [base, base[:k] + "c" + base[k:], base[:k] + base[k + 1 :], base[:k] + "c" + base[k + 1 :], base[:k] + base[k : k + 2][::-1] + base[k + 2 :], base[:k] + "c" + base[k:m] + base[m + 1 :]]
    some = sorted({t for t in some if t})

    def score(x, y):
        return 1 - edits(x, y) / max(len(x), len(y)) if method == "levenshtein" else 1 - swaps(x, y) / min(len(x), len(y))

    expected = [(x, y, round(s, 3)) for x in some for y in some if abs(len(x) - len(y)) < 8 and (s := int(score(x, y) * 1000 + 0.5) / 1000) >= least]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    assert sorted((r.query, r.text, round(r.score, 3)) for r in fuzzy_join.search(df, "t", df, "t", method, least).collect()) == sorted(expected)
