"""Texts as flat numpy arrays: words, their hashes and hashed features, without a loop over words.

Hashes of substrings come from running sums of character codes times powers of an odd number modulo 2^64;
a substring's sum times the inverse power of its start doesn't depend on where it stands.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np

#: Characters that are worked on at once, unless one text alone has more.
CHUNK_CHARS = 400_000
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `limit` characters in all, or one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def release() -> None:
    """Gives freed memory back to the system after large arrays, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _ODD), ("q", pow(_ODD, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(x)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of the ranges of an array of small codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.p, self.q = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * self.p[: len(codes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.q[starts] + (ends - starts).astype(np.uint64))


#: No letter has a code point from here on.
LETTERS_END = 0x34000


def _table(f) -> np.ndarray:
    return np.fromiter((f(chr(i)) for i in range(LETTERS_END)), np.uint32, LETTERS_END)


_TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For code points under `LETTERS_END`: the lower-case letter (of one code point), or 0 for other characters."""
    if "low" not in _TABLES:
        _TABLES["low"] = _table(lambda c: ord(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else 0)
    return _TABLES["low"]


class Words:
    """The words (runs of letters, lower-cased) of some texts.

    low: lower-case codes of all texts' characters, 0 for what is no letter; start and end: the words' ranges;
    doc: each word's text; base: where each text begins."""

    def __init__(self, texts: list[str]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(texts)]
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.low = letters()[np.minimum(codes, LETTERS_END - 1)]
        self.base = self.base + 1
        inside = self.low > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.n_docs = len(texts)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> str:
        return "".join(map(chr, self.low[self.start[i] : self.end[i]]))


class Features:
    """Hashed features of words: fixed columns (word, prefixes, suffixes) and a trigram at each letter."""

    #: Slots of a weight table; slot 0 is for features that a word lacks, and has no weight.
    def __init__(self, words: Words, bits: int, prefixes: tuple[int, ...], suffixes: tuple[int, ...], trigrams: bool) -> None:
        h, size = Hasher(words.low), words.end - words.start
        shift = np.uint64(64 - bits)
        columns = [h.of(words.start, words.end)]
        self.has = [None]
        for k in prefixes:
            columns.append(h.of(words.start, np.minimum(words.start + k, words.end)) + np.uint64(k))
            self.has.append(size >= k)
        for k in suffixes:
            columns.append(h.of(np.maximum(words.end - k, words.start), words.end) ^ np.uint64(0x5555 + k))
            self.has.append(size >= k)
        self.fixed = np.stack([np.where(has, mix(c) >> shift, 0) if has is not None else mix(c) >> shift for c, has in zip(columns, self.has, strict=True)], 1).astype(np.int32)
        self.letter = self.word = None
        if trigrams:
            at = np.flatnonzero(words.low)
            x = words.low.astype(np.uint64)
            with np.errstate(over="ignore"):
                t = x[at - 1] * np.uint64(0x9E3779B97F4A7C15) + x[at] * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 1] * np.uint64(0x165667B19E3779F9)
            self.letter = (mix(t) >> shift).astype(np.int32)
            self.first = np.searchsorted(at, words.start)

    def emissions(self, table: np.ndarray) -> np.ndarray:
        """Sum of each word's weights for each state; the trigrams count by their mean."""
        out = np.zeros((len(self.fixed), table.shape[1]), np.float64)
        for j in range(self.fixed.shape[1]):
            out += table[self.fixed[:, j]]
        if self.letter is not None and len(out):
            n = np.diff(np.concatenate([self.first, [len(self.letter)]]))
            out += np.add.reduceat(table[self.letter].astype(np.float64), self.first, axis=0) * (2.0 / n)[:, None]
        return out
