"""Secret scans with multipart credential linking, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, join_small

#: Fixed patterns, in the order in which kinds at the same place are listed.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
#: Fewest characters: of the second group for assign, of the match for the others.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Candidates that are reported only beside the part that they lack.
ENDPOINT = r"""(?<![A-Za-z0-9])(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"""
WEAK_ID = r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{12,19}(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{20,64}(?![A-Za-z0-9+/])"
WEAK = (("endpoint", ENDPOINT), ("weak_id", WEAK_ID), ("weak_secret", WEAK_SECRET))
KINDS = (*[k for k, _ in BASE], *[k for k, _ in WEAK])
#: Parts that complete one another.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "endpoint": "endpoint", "weak_id": "id", "weak_secret": "secret"}


SPANS = "array<struct<start:int,end:int,kind_no:int,fingerprint:string>>"
BLANK = r"\n[\x20\t]*\n"


def _in_blocks(items: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """SPANS that a fold over `items` gives, `step` making (at, spans) of a place and an item.

    An array that grows by one is copied each time, so items are folded in blocks, and blocks are put together.
    """
    state = f"struct<at:int,spans:{SPANS}>"

    def item(acc: Column, x: Column) -> Column:
        done = step(acc["at"], x)
        return F.struct(done["at"].alias("at"), F.concat(acc["spans"], done["spans"]).alias("spans")).cast(state)

    def whole(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(SPANS).alias("spans")).cast(state), item)
        both = F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], F.array(d["spans"])).alias("parts")))
        return both[0].cast(f"struct<at:int,parts:array<{SPANS}>>")

    def folded(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / block).cast("int")
        parts = F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(x, i * block + 1, F.lit(block)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts")).cast(f"struct<at:int,parts:array<{SPANS}>>")
        return F.flatten(F.aggregate(parts, start, whole, lambda acc: acc["parts"]))

    return F.transform(F.array(items), folded)[0]  # items are made once


def _found(text: Column, kind_no: int, pattern: str, least: int = 1, group: int = 0, usable: str = "") -> Column:
    """SPANS of the leftmost non-overlapping matches, in code points; dropped if the group has under `least` characters.

    `split` gives what lies between the matches, so lengths of pieces and matches add up to places. `usable` is a
    cheap pattern without which a text can have no span. Breaks between scopes (kind_no under 0) have no fingerprint.
    """
    seen = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else seen

    def step(at: Column, x: Column) -> Column:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["match"])
        print_ = F.sha2(x["match"], 256) if kind_no >= 0 else F.lit(None).cast("string")
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind_no).alias("kind_no"), print_.alias("fingerprint"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.array(span)).otherwise(F.array().cast(SPANS)).alias("spans"))

    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(seen))
    spans = _in_blocks(F.arrays_zip(gaps.alias("gap"), seen.alias("match"), values.alias("value")), step)
    return F.when(F.regexp_like(text, F.lit(usable or pattern)), spans).otherwise(F.array().cast(SPANS))


def _all_found(text: Column) -> Column:
    base = [_found(text, KINDS.index(k), p, LEAST[k], 2 if k == "assign" else 0, "[0-9a-f]{24}" if k == "hex" else "") for k, p in BASE]
    return F.concat(*base, *[_found(text, KINDS.index(k), p) for k, p in WEAK], _found(text, -1, BLANK))


def scan(docs: DataFrame, window: int = 160) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) without their texts, with `spans`: those of all kinds reported.

    A part is an access identifier, a secret or an endpoint. The base kinds (assign, access, hex) are always reported.
    Weak candidates (an endpoint; an upper-case identifier; a mixed token like a secret) stay only where a complementary
    part (identifier and secret, endpoint and either) lies within `window` code points of them in the same scope, at
    least one of the two being of a base kind. Scopes are blocks of text between blank lines. A weak candidate that
    overlaps a base span is dropped. The parts are linked by an interval join: they are dealt by document and by the
    stretches of `window` characters that they touch, and meet the parts whose stretches, widened by `window`, are among
    them. Spans of a kind do not overlap, so a stretch has a bounded number of parts however long the text.

    Spans are struct<kind, start, end, fingerprint, linked>, by start, then kind in the order of KINDS, ends exclusive,
    places in code points; fingerprint is the SHA-256 of the match and linked says that a complement is near. A null or
    empty text has no spans; repeated rows each get theirs; an empty table gives no rows. Other columns, whatever their
    names, stay, but one of the name `spans` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [c for c in docs.columns if c not in ("text", "spans")]
    found = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keys).alias("_keys"), _all_found(text).alias("_spans")))
    none = F.array().cast("array<struct<start:int,end:int,kind_no:int,fingerprint:string,linked:boolean>>")

    parts = found.select("_row", F.explode("_spans").alias("s")).select("_row", "s.*")
    scope = F.sum((F.col("kind_no") == -1).cast("int")).over(Window.partitionBy("_row").orderBy("start", "kind_no"))
    parts = parts.withColumn("_scope", scope).filter("kind_no >= 0")
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind_no") + 1)
    parts = parts.withColumn("_role", role).withColumn("_base", F.col("kind_no") < len(BASE))
    parts = parts.withColumn("_at", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.col("end") - 1) / window))))
    near = F.sequence(F.floor(F.greatest(F.col("start") - window, F.lit(0)) / window), F.floor((F.col("end") + window) / window))
    reach = parts.filter(F.col("_at") == F.floor(F.col("start") / window)).select("_row", "_scope", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("_role").alias("_r"), F.col("_base").alias("_b"), F.explode(near).alias("_at"))
    close = (F.col("start") <= F.col("_e") + window) & (F.col("end") >= F.col("_s") - window)
    overlap = (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    both = parts.join(reach, ["_row", "_scope", "_at"])
    links = both.filter(close & (F.col("_base") | F.col("_b"))).groupBy("_row", "start", "end", "kind_no", "fingerprint", "_base").agg(
        F.max((F.col("_r") != F.col("_role")) & ~overlap).alias("linked"), F.max(F.col("_b") & overlap).alias("_hit")
    )
    kept = links.filter(F.col("_base") | (F.col("linked") & ~F.col("_hit")))
    kept = kept.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "fingerprint", "linked"))).alias("_kept"))
    named = F.transform(
        "_kept",
        lambda s: F.struct(
            F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind_no"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["fingerprint"].alias("fingerprint"), s["linked"].alias("linked"),
        ),
    )
    empty = none.cast("array<struct<kind:string,start:int,end:int,fingerprint:string,linked:boolean>>")
    both = found.drop("_spans").join(kept.select("_row", named.alias("spans")), "_row", "left")
    return both.select(*[F.col("_keys").getField(c).alias(c) for c in keys], F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", window: int = 160) -> DataFrame:
    """`docs` with the spans of `scan` in their texts replaced by `mark`; overlapping spans by one mark.

    All rows and columns stay, whatever their names; null texts stay null, equal rows are treated alike, and an empty
    table gives no rows.
    """
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    found = scan(named, window).filter(F.size("spans") > 0)
    found = cut(found.groupBy(F.col("id").alias("_id"), F.col("hash").alias("_hash")).agg(F.first("spans").alias("_spans")))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"))
    both = join_small(rows, found, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_hash")), "left", most=200_000)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    text = F.when(F.col("_spans").isNotNull(), text).otherwise(F.col("_text")).alias("text")
    return both.select(*[text if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
