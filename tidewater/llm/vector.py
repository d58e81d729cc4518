"""Word hashes of whole Arrow batches with numpy, for use inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier of the polynomial hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 19
SPACES = b" \t\n\v\f\r"

#: Bytes of words between white space; bytes of words of letters, digits and anything beyond ASCII.
NOT_SPACE = ~np.isin(np.arange(256), list(SPACES))
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each 64-bit number."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch in order: hash, document (position in the batch), first byte and length."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    prefix: dict[int, np.ndarray] = field(default_factory=dict)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the n + 1 offsets in them."""
    text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type)
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def words(text: pa.Array, is_word: np.ndarray = NOT_SPACE, lower: np.ndarray | None = ASCII_LOWER, prefixes: Sequence[int] = ()) -> Words:
    """Words of each text, with hashes of the first `prefixes` bytes (0 where a word is no longer than that).

    Bytes are taken in pieces of about PIECE that end between words, so that memory does not follow the longest text.
    """
    data, ends = text_bytes(text)
    inside = is_word[data]
    first = ends[:-1][ends[:-1] < len(data)]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    before[first] = False
    begin = inside & ~before
    after = np.concatenate([~inside[1:] | begin[1:], [True]]) if len(data) else inside
    starts, stops = np.flatnonzero(begin), np.flatnonzero(inside & after) + 1
    del before, begin, after, inside
    out, pre = np.empty(len(starts), np.uint64), {p: np.zeros(len(starts), np.uint64) for p in prefixes}
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + PIECE, side="right")))
        low, high = int(starts[a]), int(stops[b - 1])
        piece = data[low:high]
        piece = (lower[piece] if lower is not None else piece).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(piece * _powers(BASE, len(piece))[: len(piece)], dtype=np.uint64)])
        s, e = starts[a:b] - low, stops[a:b] - low
        back = _powers(INVERSE, len(piece))[s]
        out[a:b] = mix((sums[e] - sums[s]) * back + (e - s).astype(np.uint64))
        for p, found in pre.items():
            longer = np.flatnonzero(e - s > p)
            at = s[longer]
            found[a + longer] = mix((sums[at + p] - sums[at]) * back[longer] + np.uint64(p << 32))
        a = b
    doc = np.searchsorted(ends, starts, side="right") - 1
    return Words(out, doc, starts, stops - starts, pre)


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all k-word shingles; a document of fewer words has one of all of them, without words none."""
    n = len(found.hash)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total[: n - j] = mix(total[: n - j] + found.hash[j:] * np.uint64(2 * j + 1)) if n > j else total[: n - j]
    whole = np.zeros(n, bool)
    if n >= k:
        whole[: n - k + 1] = found.doc[: n - k + 1] == found.doc[k - 1 :]
    doc, value = found.doc[whole], total[whole]
    counts = np.bincount(found.doc, minlength=1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = np.searchsorted(found.doc, short)
        few = np.zeros(len(short), np.uint64)
        for j in range(k - 1):  # the j-th word of those that have one
            has = counts[short] > j
            few[has] = mix(few[has] * np.uint64(31) + found.hash[at[has] + j])
        few = mix(few + counts[short].astype(np.uint64))
        doc, value = np.concatenate([doc, short]), np.concatenate([value, few])
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of its text column, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Gives memory that is free back to the system: a Python worker lives on and serves later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(task: Task) -> Task:
    """`task` for `mapInArrow`, followed by `release`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        release()

    return run
