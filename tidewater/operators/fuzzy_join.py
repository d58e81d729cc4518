"""Search of texts that are alike, without comparing all pairs: by edit distance, common words or sound."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import fuzzy

METHODS = ("levenshtein", "damerau", "jaccard", "soundex")
#: Texts of up to this many characters are cut at each place, where one edit at most is left.
CUT_AT_ALL = 64
#: Hint of joins whose sides Spark takes for smaller than they are, as rows are exploded; none of them may be broadcast.
MERGE = "merge"


def _sides(df: DataFrame, text: str) -> DataFrame:
    """Distinct texts under a digest, which stands for them until pairs are compared."""
    return df.select(F.col(text).cast("string").alias("text")).filter("text IS NOT NULL").distinct().select(F.sha2("text", 256).alias("key"), "text", F.length("text").alias("n"))


def _grams(side: DataFrame, q: int) -> DataFrame:
    """key, n, g: q-grams of a text marked at both ends (q = 2) or its characters (q = 1), repeats numbered."""
    end = F.lit("\x01") if q > 1 else F.lit("")
    text = F.concat(end, "text", end)
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    counted = side.filter("n > 0").select("key", "n", F.explode(cut).alias("g")).groupBy("key", "n", "g").agg(F.count(F.lit(1)).alias("times"))
    return counted.select("key", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("i"), "g").select("key", "n", F.struct("g", "i").alias("g"))


def _words(side: DataFrame) -> DataFrame:
    """key, n (number of distinct words), g."""
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return side.select("key", F.size(words).alias("n"), F.explode(words).alias("g"))


def _prefix(listed: DataFrame, often: DataFrame, kept: Column) -> DataFrame:
    """The `kept` rarest of what each text has."""
    ranked = listed.join(often, "g", "left").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g"))).alias("o"))
    return ranked.select("key", "n", F.explode(F.slice("o", F.lit(1), kept.cast("int"))).alias("o")).select("key", "n", F.col("o.g").alias("g"))


def _pairs(a: DataFrame, b: DataFrame, kept: Column, ratio: float, able: Column | None = None) -> DataFrame:
    """a, b: keys that share one of the rarest parts, whose sizes na and nb are within `ratio` of each other and `able`."""
    often = b.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    x = _prefix(a, often, kept).select(F.col("key").alias("a"), F.col("n").alias("na"), "g")
    y = _prefix(b, often, kept).select(F.col("key").alias("b"), F.col("n").alias("nb"), "g")
    near = F.greatest("na", "nb") <= F.least("na", "nb") * (ratio + 1e-9)
    return x.join(y.hint(MERGE), "g").filter(near if able is None else near & able).select("a", "b").distinct()


def _one_edit(a: DataFrame, b: DataFrame, swaps: bool) -> DataFrame:
    """query, text, na, nb, edits: all pairs of texts with no edit or one, each once.

    A replaced character leaves the same rest around the same place in both texts; a text with a character left out, or
    with two neighbours swapped, is the other text. So all joins are by equality and make only pairs that count.
    """
    part = lambda i, n: F.substring("text", i, n)
    i, n = F.col("i"), F.col("n")

    def places(side: DataFrame) -> DataFrame:
        return side.select("text", "n", F.explode(F.sequence(F.lit(1), "n")).alias("i")).withColumns({"rest": F.concat(part(F.lit(1), i - 1), part(i + 1, n)), "c": part(i, F.lit(1))})

    def whole(c: str) -> Column:
        return F.concat(F.substring("rest", F.lit(1), i - 1), F.col(c), F.substring("rest", i, F.length("rest")))

    def shorter(side: DataFrame, other: DataFrame) -> DataFrame:
        """long, rest: of a run of equal characters the first is left out. Only texts one longer than any of the other side."""
        found = side.join(F.broadcast(other.select((n + 1).alias("n")).distinct()), "n", "left_semi")
        return places(found).filter((i == 1) | (F.col("c") != part(i - 1, F.lit(1)))).select(F.col("text").alias("long"), "n", F.col("rest").alias("text"))

    names = ["query", "text", "na", "nb", "edits"]
    x, y = (places(side).select("i", "rest", F.col("c").alias(c)) for side, c in ((a, "x"), (b, "y")))
    size = F.length("rest") + 1
    same = a.join(b.select("text").hint(MERGE), "text").select("text", "text", "n", "n", F.lit(0)).toDF(*names)
    replaced = x.join(y.hint(MERGE), ["i", "rest"]).filter("x != y").select(whole("x"), whole("y"), size, size, F.lit(1)).toDF(*names)
    left_out = shorter(a, b).join(b.select("text").hint(MERGE), "text").select("long", "text", "n", n - 1, F.lit(1)).toDF(*names)
    put_in = shorter(b, a).join(a.select("text").hint(MERGE), "text").select("text", "long", n - 1, "n", F.lit(1)).toDF(*names)
    found = same.union(replaced).union(left_out).union(put_in)
    if swaps:
        turned = F.concat(part(F.lit(1), i - 1), part(i + 1, F.lit(1)), part(i, F.lit(1)), part(i + 2, n))
        other = places(a).filter((i < n) & (part(i, F.lit(1)) != part(i + 1, F.lit(1)))).select(F.col("text").alias("query"), "n", turned.alias("text"))
        found = found.union(other.join(b.select("text").hint(MERGE), "text").select("query", "text", "n", "n", F.lit(1)).toDF(*names))
    return found


def _edit_candidates(a: DataFrame, b: DataFrame, swaps: bool, least: float, able: Column) -> DataFrame:
    """An edit changes at most e of a text's q-grams, so of two texts with d edits, all but e * d of the longer one's are common.

    Two-grams are taken where that leaves one at least at any length, else single characters, where an edit changes one.
    """
    share, touched = 1 - least, 3 if swaps else 2
    q, touched = (2, touched) if share * touched < 1 else (1, 1)
    kept = F.floor(F.col("n") * (touched * share) + 1e-9) + 1
    return _pairs(_grams(a, q), _grams(b, q), kept, 2 - least if swaps else 1 / least, able)


def _by_edits(a: DataFrame, b: DataFrame, swaps: bool, least: float) -> DataFrame:
    """query, text, na, nb, edits of all pairs that can score `least`.

    A score is by one of the two lengths: below `few`, one edit at most can be left, and pairs are made as they are;
    from there on candidates by q-grams are compared.
    """
    a, b, share = a.filter("n > 0"), b.filter("n > 0"), 1 - least
    edits = lambda n: int(share * n + 1e-9)
    few = next(n for n in count(1) if n > CUT_AT_ALL or edits(n) > 1)
    able = (F.least if swaps else F.greatest)("na", "nb") >= few
    short, long = F.col("n") <= few, F.col("n") >= few * (1 if swaps else least) - 1e-6
    near = _one_edit(a.filter(short), b.filter(short), swaps).filter(~able)
    x, y = a.filter(long), b.filter(long)
    found = _compared(_edit_candidates(x, y, swaps, least, able), x, y)
    far = found.withColumn("edits", fuzzy.damerau("query", "text") if swaps else F.levenshtein("query", "text"))
    return near.union(far.select(near.columns))


def _compared(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """query, text, na, nb of pairs of keys."""
    sided = pairs.join(a.select(F.col("key").alias("a"), F.col("text").alias("query"), F.col("n").alias("na")).hint(MERGE), "a")
    return sided.join(b.select(F.col("key").alias("b"), "text", F.col("n").alias("nb")).hint(MERGE), "b").select("query", "text", "na", "nb")


def _sound_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Texts whose codes have three of four places in common: codes are joined by each three, once for all their texts."""
    coded = [side.select("key", fuzzy.soundex(F.col("text")).alias("code")) for side in (a, b)]
    masks = F.array(*[F.concat(F.substring("code", 1, i), F.lit("_"), F.substring("code", i + 2, 4)) for i in range(4)])
    x, y = [c.select("code").distinct().select("code", F.explode(masks).alias("mask")) for c in coded]
    codes = x.select(F.col("code").alias("code_a"), "mask").join(y.select(F.col("code").alias("code_b"), "mask"), "mask").select("code_a", "code_b").distinct()
    left = coded[0].select(F.col("key").alias("a"), F.col("code").alias("code_a"))
    return left.join(codes, "code_a").join(coded[1].select(F.col("key").alias("b"), F.col("code").alias("code_b")), "code_b").select("a", "b")


def search(queries: DataFrame, query: str, collection: DataFrame, text: str, method: str = "levenshtein", least: float = 0.7) -> DataFrame:
    """query, text, score (to three places, half up): pairs of distinct texts that score at least `least`, which is above 0.001.

    `levenshtein`: 1 - edits / the longer length; `damerau`: 1 - edits with swaps of neighbours / the shorter length;
    `jaccard`: share of common words between white space; `soundex`: 1 if the codes differ in one place at most. Lengths
    are in code points. Null texts have no pairs; empty ones none but by sound (0000).

    Candidates share one of their rarest q-grams or words, and their lengths are near; none that could score is left out.
    Where one edit at most can be left, pairs are made by equality of texts that are edited, without candidates.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if least <= 0.001:
        raise ValueError("`least` of 0.001 or less would be all pairs")
    a, b, raw = _sides(queries, query), _sides(collection, text), least - 0.0005  # what rounds up to `least` counts
    if method == "soundex":
        found = _compared(_sound_candidates(a, b) if least <= 1 else _sound_candidates(a, b).limit(0), a, b)
    elif method == "jaccard":
        found = _compared(_pairs(_words(a), _words(b), F.col("n") - F.ceil(F.col("n") * raw - 1e-9) + 1, 1 / raw), a, b)
    else:
        found = _by_edits(a, b, method == "damerau", raw)
    score = {
        "levenshtein": lambda: 1 - F.try_divide("edits", F.greatest("na", "nb")),  # no error, wherever Spark moves the filter to
        "damerau": lambda: 1 - F.try_divide("edits", F.least("na", "nb")),
        "jaccard": lambda: fuzzy.token_jaccard(F.col("query"), F.col("text")),
        "soundex": lambda: F.lit(1.0),
    }[method]()
    return found.select("query", "text", (F.floor(score * 1000 + 0.5) / 1000).alias("score")).filter(F.col("score") >= least)
