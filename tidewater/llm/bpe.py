"""BPE encoding and decoding by traversal of a trie of distinct words that shares the work of common prefixes."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.vector import lean, slices

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{SPACE}]+")
#: Characters that Python, but not Unicode, takes for white space.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
END = "</w>"
#: Ends a word in the trie: a character that the byte alphabet does not have.
MARK = " "


@dataclass(frozen=True)
class Alphabet:
    """Letters and digits as character classes, and lower case where it is not Python's: all as the tokenizers library has them."""

    letter: str
    digit: str
    lower: dict[int, str]

    @staticmethod
    def of_library() -> Alphabet:
        """Asked of the library itself, whose Unicode version is neither Python's nor that of other regular expressions."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        split = {k: pre_tokenizers.Split(Regex(rf"\p{{{k}}}+"), "removed", invert=True) for k in "LN"}
        kinds, lower, normalizer = {k: "" for k in split}, {}, normalizers.Lowercase()
        for first in range(0, sys.maxunicode + 1, 1 << 12):
            points = [p for p in range(max(first, 1), first + (1 << 12)) if not 0xD800 <= p < 0xE000]
            every = "".join(map(chr, points))
            for k, cut in split.items():
                kinds[k] += "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in cut.pre_tokenize_str(every))
            lowered = normalizer.normalize_str("\0".join(every)).split("\0")
            lower |= {p: low for p, low in zip(points, lowered) if low != chr(p).lower()}
        return Alphabet(kinds["L"], kinds["N"], lower)

    def word_pattern(self, below: int = sys.maxunicode + 1) -> re.Pattern:
        """How text of code points `below` is cut into words, as the vocabulary's own file states it.

        Sets without characters beyond U+FFFF are tables for `re`, others are gone through range by range.
        """
        letter, digit = ("".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", runs) if int(r[2:10], 16) < below) for runs in (self.letter, self.digit))
        return re.compile(f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digit}]|[^{SPACE}{letter}{digit}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, where printable in Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(others)) for b in range(256)]


def _symbols(token: str) -> list[str]:
    body = token.removesuffix(END) if len(token) > len(END) else token
    return [*body[:-1], body[-1] + END] if body != token else [*body]


class Merges:
    """The vocabulary and its merges: which tokens are encodings of themselves, and which can stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int], alphabet: Alphabet):
        self.ids, self.special, self.alphabet = vocabulary, special, alphabet
        self.token = {i: t for t, i in (vocabulary | special).items()}
        self.rank = {tuple(m): r for r, m in enumerate(merges)}
        self.none = len(self.rank)
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in vocabulary.items():
            if self.plain(_symbols(token)) == [token]:
                body = token.removesuffix(END) if len(token) > len(END) else token
                (self.inner if body == token else self.final)[body] = i

    def _steps(self, symbols: list[str]) -> Iterator[int]:
        """BPE as defined: again and again merges the leftmost pair of least rank, and says which rank. Only for short pieces."""
        rank, none = self.rank, self.none
        while len(symbols) > 1:
            least, at = min((rank.get(pair, none), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if least == none:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            yield least

    def plain(self, symbols: list[str]) -> list[str]:
        for _ in self._steps(symbols):
            pass
        return symbols

    def edges(self, token: int) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
        """How a token comes about: (rank of the next merge, outermost symbol before it), at its left and at its right."""
        symbols = _symbols(self.token[token])
        left, right = [symbols[0]], [symbols[-1]]
        ranks = []
        for rank in self._steps(symbols):
            ranks.append(rank)
            left.append(symbols[0])
            right.append(symbols[-1])
        ranks.append(self.none)
        return list(zip(ranks, left)), list(zip(ranks, right))


class PrefixTrie:
    """Depth-first traversal of the trie of sorted words.

    A word is encoded by t1 .. tn exactly if each token is its own encoding and each two neighbours fit. So each prefix
    has one last token, found from the last tokens of shorter prefixes. Of sorted words, those on the path to the
    present word are the prefixes it shares with the one before: the states of a path are computed once for all words
    below it, and only the path is held. Tokens that end at a place are found by an Aho-Corasick automaton; the mark
    at the end of a word is a place like others, where only tokens that end words do.
    """

    def __init__(self, merges: Merges, most_pairs: int = 150_000):
        self.merges, self.most_pairs = merges, most_pairs
        self.tokens, self.size = ahocorasick.Automaton(), {}
        for table, mark in ((merges.inner, ""), (merges.final, MARK)):
            for body, i in table.items():
                self.size[i] = len(body + mark)
                self.tokens.add_word(body + mark, (self.size[i], i))
        self.tokens.make_automaton()
        self._packed = {i: pack([i]) for i in merges.token}
        self._edges: dict[int, tuple[list[tuple[int, str]], list[tuple[int, str]]]] = {}
        self._fits: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self._pairs = 0

    def _edge(self, token: int, side: int) -> list[tuple[int, str]]:
        if (found := self._edges.get(token)) is None:
            found = self._edges[token] = self.merges.edges(token)
        return found[side]

    def beside(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' symbols gives the two tokens again: no pair across the border is ever next.

        The merges of both go on by least rank, of equal ones the leftmost first; between them lies the pair across.
        """
        fits = self._fits[a].get(b)
        if fits is not None:
            return fits
        left, right = self._edge(a, 1), self._edge(b, 0)
        rank, none, i, j, fits = self.merges.rank, self.merges.none, 0, 0, True
        while True:
            (next_left, x), (next_right, y) = left[i], right[j]
            across = rank.get((x, y), none)
            if across < next_left and across <= next_right and across < none:
                fits = False
                break
            if next_left == none and next_right == none:
                break
            if next_left <= next_right:
                i += 1
            else:
                j += 1
        if self._pairs >= self.most_pairs:
            self._fits.clear()
            self._pairs = 0
        self._fits[a][b] = fits
        self._pairs += 1
        return fits

    def encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of the sorted distinct `words`, written in the byte alphabet, with its ids, packed."""
        m, beside, fits, packed, before, last = self.merges, self.beside, self._fits, self._packed, "", [-1]
        found_in, sizes = self.tokens.iter, self.size
        for word in words:
            marked = word + MARK
            n = len(marked)
            shared, most = 0, min(n, len(before))
            while shared < most and marked[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            last += [-1] * (n - shared)
            before = marked
            for at, (size, token) in found_in(marked):
                # Tokens that end at a place come by falling size; the first that fits is the one.
                if at >= shared and last[at + 1] < 0:
                    if size > at:
                        last[at + 1] = token
                    elif (previous := last[at + 1 - size]) >= 0:
                        known = fits[previous].get(token)
                        if known or (known is None and beside(previous, token)):
                            last[at + 1] = token
            if (token := last[n]) < 0:  # symbols outside the vocabulary: the definition itself, which leaves them out
                yield word, pack([m.ids[t] for t in m.plain(_symbols(word + END)) if t in m.ids])
            elif (at := n - sizes[token]) == 0:
                yield word, packed[token]
            else:
                found = [packed[token]]
                while at > 0:
                    token = last[at]
                    found.append(packed[token])
                    at -= sizes[token]
                yield word, b"".join(found[::-1])


def pack(ids: list[int]) -> bytes:
    """Ids as four bytes each: joining such bytes joins lists of ids."""
    return np.array(ids, dtype=np.int32).tobytes()


class Encoder:
    """Encodes batches of texts: distinct pieces of text once, their distinct words once through the trie.

    Pieces are kept for later batches, up to `most_kept`; those used since the last clearing stay. So are words,
    of which new pieces are often made, up to `most_words`.
    """

    def __init__(self, merges: Merges, most_kept: int = 120_000, most_words: int = 350_000):
        self.merges, self.trie, self.most_kept, self.most_words = merges, PrefixTrie(merges), most_kept, most_words
        self.lower = merges.alphabet.lower
        self.odd_case = re.compile("[" + "".join(map(chr, self.lower)) + "]" if self.lower else "(?!)")
        # Most texts have neither characters of an odd case nor such as make the pattern slow.
        plain = min([0x10000, *self.lower])
        self.beyond = re.compile(f"[{chr(plain)}-{chr(sys.maxunicode)}]")
        self.ascii_pattern, self.plain_pattern, self.word_pattern = map(merges.alphabet.word_pattern, (0x80, plain, sys.maxunicode + 1))
        self.bytes = {b: ord(c) for b, c in enumerate(byte_alphabet()) if ord(c) != b}
        self.special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        self.tokens = pa.array(map(merges.token.get, range(max(merges.token, default=-1) + 1)), pa.string())
        self.fixed: dict[str | int, bytes] = {"": b""} | {i: pack([i]) for i in merges.special.values()}
        self.pieces = dict(self.fixed)
        self.words: dict[str, bytes] = {}

    def shrink(self) -> None:
        """Leaves out what was kept from texts; what was learned of the vocabulary stays."""
        self.pieces, self.words = dict(self.fixed), {}

    def split(self, text: str) -> list[str]:
        """Pieces between white space, in Unicode's composed form and lower case, character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        return SPACES.sub(" ", text).strip(" ").split(" ") if any(c in text for c in ODD_SPACE) else text.split()

    def _written(self, word: str) -> str:
        """A word in the byte alphabet."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)

    def _cut(self, piece: str) -> list[str]:
        """A piece's words."""
        if piece.isascii():
            return self.ascii_pattern.findall(piece)
        if not self.beyond.search(piece):
            return self.plain_pattern.findall(piece)
        # Characters of another case than Python's are none that Python itself changes, so this can wait until here.
        return self.word_pattern.findall(piece.translate(self.lower) if self.odd_case.search(piece) else piece)

    def learn(self, pieces: set[str]) -> None:
        whole = {p for p in pieces if p.isascii() and p.isalpha()}
        cut = {p: self._cut(p) for p in pieces.difference(whole)}
        asked = whole.union(chain.from_iterable(cut.values()))
        new = asked.difference(self.words)
        if len(self.words) + len(new) > self.most_words:
            self.words = {w: self.words[w] for w in asked.difference(new)}
        words, written = self.words, {self._written(w): w for w in new}
        for form, ids in self.trie.encode(sorted(written)):
            words[written[form]] = ids
        self.pieces.update((p, words[p]) for p in whole)
        self.pieces.update((p, words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])) for p, ws in cut.items())

    def _parts(self, text: str | None) -> list[str | int]:
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self.split(text)
        parts, at = [], 0
        for hit in self.special.finditer(text):
            parts += [*self.split(text[at : hit.start()]), self.merges.special[hit[0]]]
            at = hit.end()
        return [*parts, *self.split(text[at:])]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed."""
        parts = [self._parts(t) for t in texts]
        distinct = set(chain.from_iterable(parts))
        new = distinct.difference(self.pieces)
        if len(self.pieces) + len(new) > self.most_kept:
            had = self.pieces
            self.pieces = self.fixed | {p: had[p] for p in distinct.difference(new)}
        self.learn(new)
        known = self.pieces.__getitem__
        return [b"".join(map(known, row)) for row in parts]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, dtype=np.int32).tolist() for x in self.packed(texts)]

    def arrays(self, texts: list[str | None], decode: bool) -> list[pa.Array]:
        """The ids of each text and, if asked for, their tokens joined by one space."""
        found = self.packed(texts)
        ends = pa.array(np.cumsum([0, *map(len, found)]) // 4, pa.int32())
        flat = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
        ids = pa.ListArray.from_arrays(ends, flat)
        return [ids, pc.binary_join(pa.ListArray.from_arrays(ends, self.tokens.take(flat)), " ")] if decode else [ids]


def read_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    return j["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]], {x["content"]: x["id"] for x in j["added_tokens"]}


def read_merges(path: str) -> Merges:
    return Merges(*read_vocabulary(path), Alphabet.of_library())


_ENCODERS: dict[int, Encoder] = {}


def encode(docs: DataFrame, path: str, decode: bool = True, batch_bytes: int = 1 << 21) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, ids array<int> and, if asked for, decoded: the tokens of the ids joined by one space.

    The vocabulary (of a fixed size, a few MB) is broadcast. No row leaves its partition: each task gathers the
    distinct words of some `batch_bytes` of text at a time (one text at least), puts them in order and passes
    depth-first over their trie. Strings of special tokens in a text become those tokens, as the tokenizer file's own
    library has it. Null and empty texts have no ids and decode to ""; each row is encoded for itself; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_merges(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        encoder = _ENCODERS[key]
        for batch in batches:
            for part in slices(batch, 1, batch_bytes):
                columns = [part.column(0), *encoder.arrays(part.column(1).to_pylist(), decode)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
        encoder.shrink()

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(lean(task), f"doc_id {kind}, ids array<int>" + (", decoded string" if decode else ""))
