"""Spelling variants of a vocabulary: words one edit apart, found by bands of letter-parity masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small
from tidewater.llm.vector import mix

#: Letters of a run; only A-Z are lower-cased.
RUN = "[A-Za-z\u00C0-\u00FF]"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters by how common they are in European languages; they are dealt to the bands in turn.
BY_USE = "enatirsoludcmhgpbvfzkwyjqx"
#: Bits of a mask and bands that they are dealt into.
BITS, BANDS = 60, 3
#: One run in so many loses a code point.
ONE_IN = 199


def occurrences(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """One row `word` for each run of letters of the texts of `docs` (doc_id, text), A-Z lower-cased, some with one code point deleted.

    Of a run whose CRC-32 of '<doc_id>:<run>' is divisible by ONE_IN, the code point at that number modulo its length
    goes (a run of one becomes empty). Only words of `least_length` code points or more are returned. Null texts have
    no runs; a null doc_id is an empty text in the CRC.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", LOWER.upper(), LOWER).alias("run"))
    found = found.withColumn("_h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("_h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.select(F.when(F.col("_h") % ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = 6, least: int = 5) -> DataFrame:
    """word and n of the words of `occurrences` with `least_length` code points and `least` occurrences or more."""
    return occurrences(docs, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """A bit for each letter, set if the word has an odd number of it; some rare letters share a bit.

    An inserted or deleted letter flips one bit and a replaced one two, or none if both share a bit.
    """

    def flip(mask: Column, letter: Column) -> Column:
        at = F.ascii(letter)
        place = F.when(at < 0xC0, at - ord("a")).otherwise(at - 0xC0 + len(LOWER)) % BITS
        return F.when(letter == "", mask).otherwise(mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place)))

    return F.aggregate(F.split(F.translate(word, BY_USE, LOWER), ""), F.lit(0).cast("long"), flip)


#: Bits of each band: every BANDS-th one.
BAND = [sum(1 << b for b in range(i, BITS, BANDS)) for i in range(BANDS)]


def _letters(words: pa.Array, size: int) -> np.ndarray:
    """(words, size) code points of words that all have `size` of them; the letters of RUN have one byte each in Latin-1."""
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(len(words), size)


def _one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y (code points; y as long or longer by one) are one edit apart."""
    n = x.shape[1]
    if y.shape[1] == n:
        return (x != y).sum(axis=1) == 1
    same, moved = x == y[:, :n], x == y[:, 1:]
    before = np.where(same.all(axis=1), n, same.argmin(axis=1))
    after = np.where(moved.all(axis=1), n, moved[:, ::-1].argmin(axis=1))
    return before + after >= n


def _halves(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n // 2 letters and of the last n - n // 2 ones: one edit of words of n letters or n + 1 leaves one of both as it is."""
    wide, weight = x.astype(np.uint64), mix(np.arange(1, n + 1, dtype=np.uint64))
    first, last = wide[:, : n // 2] @ weight[: n // 2], wide[:, x.shape[1] - (n - n // 2) :] @ weight[n // 2 :]
    return (first >> np.uint64(32)).astype(np.uint32), (last >> np.uint64(32)).astype(np.uint32)


def _near(mask_x: np.ndarray, x: np.ndarray, mask_y: np.ndarray, y: np.ndarray, no: int, within: bool, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of x and y one edit apart whose first equal band is `no`, in steps of about `most` pairs."""
    step = max(1, most // max(1, len(mask_y)))
    (head_x, tail_x), (head_y, tail_y) = _halves(x, x.shape[1]), _halves(y, x.shape[1])
    for a in range(0, len(mask_x), step):
        b, low = a + step, a + 1 if within else 0
        able = (head_x[a:b, None] == head_y[None, low:]) | (tail_x[a:b, None] == tail_y[None, low:])
        flipped = mask_x[a:b, None] ^ mask_y[None, low:]
        i, j = np.nonzero(able & (np.bitwise_count(flipped) <= 2))
        bits = flipped[i, j]
        i, j = i + a, j + low
        able = (bits & np.uint64(BAND[no])) == 0
        for earlier in BAND[:no]:
            able &= (bits & np.uint64(earlier)) != 0
        if within:
            able &= i < j
        i, j = i[able], j[able]
        if len(i):
            close = _one_edit(x[i], y[j])
            yield i[close], j[close]


#: Sides of a comparison: one set of words with another one, or a set in itself.
ONE, OTHER, WITHIN = 0, 1, 2
PAIRS = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def _compare(rows: pa.Table) -> pa.Table:
    """Pairs of the sets of a bin: rows of word, n, mask, no, size (of the shorter words of a set), set and side."""
    key, size, side = (rows.column(c).to_numpy() for c in ("set", "size", "side"))
    by = np.lexsort((side, size, key))
    rows = rows.take(pa.array(by)).combine_chunks()
    key, size, side, no = (rows.column(c).to_numpy() for c in ("set", "size", "side", "no"))
    mask, word = rows.column("mask").to_numpy().view(np.uint64), rows.column("word").combine_chunks()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1]), [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        n, mid = int(size[a]), a + int((side[a:b] == ONE).sum())
        within = side[a] == WITHIN
        if b - a < 2 or not within and mid in (a, b):
            continue
        if within:
            x = y = _letters(word[a:b], n)
            first, second = a, a
            found = _near(mask[a:b], x, mask[a:b], y, int(no[a]), True)
        else:
            x, second = _letters(word[a:mid], n), mid
            first, y = a, _letters(word[mid:b], len(word[mid].as_py()))
            found = _near(mask[a:mid], x, mask[mid:b], y, int(no[a]), False)
        for i, j in found:
            left.append(i + first)
            right.append(j + second)
    i, j = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
    n = rows.column("n").combine_chunks()
    return pa.Table.from_arrays([word.take(i), n.take(i), word.take(j), n.take(j)], schema=PAIRS)


def near_pairs(words: DataFrame, block: int = 20_000, bin_rows: int = 60_000) -> DataFrame:
    """(a, n_a, b, n_b): the pairs of `words` (word, n; distinct words) that one inserted, deleted or replaced code point makes equal, each once.

    Two flipped bits at most leave one of three bands of a mask equal, so words meet in sets of one band, its value and
    a length, with those of the same length and those longer by one. Within a set, words whose masks differ in two bits
    at most, with one half in common, are verified by the edit distance; a pair is taken in its first equal band. Sets of more than `block` words
    are cut into blocks that are compared in pairs; sets are dealt together, about `bin_rows` rows a task. Words of
    letters beyond those of RUN are not for this.
    """
    masked = words.select("word", "n", F.length("word").alias("size"), parity_mask(F.col("word")).alias("mask"))
    bands = F.array(*[F.struct(F.lit(i).alias("no"), F.col("mask").bitwiseAND(F.lit(b)).alias("part")) for i, b in enumerate(BAND)])
    masked = cut(masked.withColumn("_b", F.explode(bands)).select("word", "n", "size", "mask", "_b.*"))
    large = cut(masked.groupBy("no", "part", "size").agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts")).filter("_parts > 1"))
    parts = join_small(masked, large, ["no", "part", "size"], "left")
    for name, step in (("_longer", 1), ("_shorter", -1)):
        other = large.select("no", "part", (F.col("size") - step).alias("size"), F.col("_parts").alias(name))
        parts = join_small(parts, other, ["no", "part", "size"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), count("_parts")).cast("int")
    all_of = lambda c: F.sequence(F.lit(0), count(c) - 1)

    def place(kind: str, i: Column, j: Column, side: Column, size: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), "no", "part", size, i, j).alias("set"), size.alias("size"), side.cast("tinyint").alias("side"))

    size, mine = F.col("size"), F.col("_own")
    same = F.transform(all_of("_parts"), lambda j: place("same", F.least(mine, j), F.greatest(mine, j), F.when(mine == j, WITHIN).when(mine < j, ONE).otherwise(OTHER), size))
    longer = F.transform(all_of("_longer"), lambda j: place("next", mine, j, F.lit(ONE), size))
    shorter = F.transform(all_of("_shorter"), lambda i: place("next", i, mine, F.lit(OTHER), size - 1))
    placed = parts.withColumn("_own", own).withColumn("_p", F.explode(F.concat(same, longer, shorter)))
    placed = placed.select("word", "n", "mask", "no", "_p.*")
    bins = max(1, 9 * words.count() // bin_rows)
    return placed.groupBy(F.pmod("set", F.lit(bins)).alias("_bin")).applyInArrow(_compare, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each row of `forms` (word, form): where following the forms ends. Words are distinct, without circles.

    Pointers are doubled, so the rounds are the logarithm of the longest chain.
    """
    now = cut(forms.select("word", F.col("form").alias("root")).filter("root IS NOT NULL"))
    while True:
        further = now.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        found = now.join(further, F.col("root") == F.col("_from"), "left")
        now = cut(found.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        if now.filter("_moved").isEmpty():
            return now.drop("_moved")
        now = now.drop("_moved")


def spelling_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of `words` (word, n; distinct words).

    n_near counts the words one edit away. Of those, the one of largest n (ties: the smallest in code-point order) is
    the form, if its n is at least `times` the word's own; the root is where forms end, the word itself if it has none.
    """
    pairs = near_pairs(words)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    both = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))
    able = F.col("form_n") >= times * F.col("n")
    named = cut(named.select("word", "n", "n_near", F.when(able, F.col("form")).alias("form"), F.when(able, F.col("form_n")).alias("form_n")))
    done = named.join(roots(named), "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long"), F.col("n_near").cast("long"), F.col("form_n").cast("long"))


def spelling_variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """`spelling_forms` of the `vocabulary` of `docs` (doc_id, text).

    Null and empty texts have no words and an empty table gives no rows; repeated rows count as often as they stand; a
    run of any length is one word; other columns are ignored.
    """
    return spelling_forms(cut(vocabulary(docs.select("doc_id", "text"), least_length, least)), times)
