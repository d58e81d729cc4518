"""String functions of columns; null in, null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_name(name: str) -> str:
    """A column name in lower case with single underscores."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9A-Za-z]+", "_", spaced).strip("_").lower()


def snake(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(spaced, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2_000_000_000)))


def title(c: Column) -> Column:
    """Each run of letters, digits and apostrophes capitalised; what lies between stays."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}']+|[^\p{L}\p{N}']+"), F.lit(0))
    return F.array_join(F.transform(words, capitalize), "")


def strip(c: Column, side: str = "both") -> Column:
    """Without white space at one end or both."""
    return F.regexp_replace(c, {"both": r"^\s+|\s+$", "left": r"^\s+", "right": r"\s+$"}[side], "")


def pad(c: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Filled up to `width`; longer texts stay whole."""
    return F.when(F.length(c) < width, (F.lpad if side == "left" else F.rpad)(c, width, fill)).otherwise(c)


def zfill(c: Column, width: int) -> Column:
    """Filled with zeros after a sign."""
    signed = F.substring(c, 1, 1).isin("+", "-")
    rest = F.substring(c, 2, 2_000_000_000)
    return F.when(signed, F.concat(F.substring(c, 1, 1), pad(rest, width - 1, "left", "0"))).otherwise(pad(c, width, "left", "0"))


def cut_out(c: Column, start: int, stop: int | None = None) -> Column:
    """Characters from `start` to before `stop`; negative places count from the end."""
    n = F.length(c)
    place = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    first, last = place(start), n if stop is None else place(stop)
    return F.substring(c, first + 1, F.greatest(last - first, F.lit(0)))


def replace(c: Column, old: str, new: str, every: bool = True) -> Column:
    """Replaces a plain text, everywhere or where it is first."""
    if every:
        return F.replace(c, F.lit(old), F.lit(new))
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def join(a: Column, b: Column, separator: str = " ") -> Column:
    return F.concat(a.cast("string"), F.lit(separator), b.cast("string"))


def _key(secret: str) -> Column:
    """32 bytes made of a secret of any length."""
    return F.unhex(F.sha2(F.lit(secret).cast("binary"), 256))


def encrypt(c: Column, key: str) -> Column:
    """AES of the text in Base64, different each time."""
    return F.base64(F.aes_encrypt(c.cast("binary"), _key(key)))


def decrypt(c: Column, key: str) -> Column:
    """The text that `encrypt` was given; null for another key."""
    return F.try_aes_decrypt(F.unbase64(c), _key(key)).cast("string")


def matches(c: Column, pattern: str) -> Column:
    """Whether a regular expression is found; false for null."""
    return F.coalesce(c.rlike(pattern), F.lit(False))
