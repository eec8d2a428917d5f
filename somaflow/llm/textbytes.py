"""Words of many texts at once, as byte ranges and 64-bit hashes, in numpy.

Texts are joined with a separator byte; a table says which bytes belong to
words and what they become in lower case.  In UTF-8 every byte of a non-ASCII
character is 0x80 or more, so classes that take all or none of the non-ASCII
characters are exact on bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _flags(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM = _flags(lambda b: 48 <= b < 58 or 97 <= b < 123 or b >= 128)
#: ``[^\x20\x09-\x0D]``
NOT_SPACE = _flags(lambda b: b != 32 and not 9 <= b <= 13)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        n = -(-n >> 18) << 18 if n > 1 << 19 else 1 << 19
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


class Hasher:
    """Hashes of any ranges of one byte buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD)


class Words:
    """Words of a list of texts: lower-cased bytes, word ranges, and each text's first word."""

    def __init__(self, texts: list[bytes], inside: np.ndarray):
        self.inside = inside
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(sizes + 1)))
        raw = np.frombuffer(b"\x20".join(texts) + b"\x20" + b"\x00" * 8, np.uint8)
        self.padded = _LOWER[raw]
        self.data = self.padded[:-8]
        flags = np.zeros(len(self.data) + 1, np.int8)
        flags[1:] = inside[self.data]
        change = np.diff(flags)
        self.starts = np.flatnonzero(change == 1)
        self.ends = np.flatnonzero(change == -1)
        self.first = np.searchsorted(self.starts, self.text_at)

    @functools.cached_property
    def _hashes(self) -> np.ndarray:
        return Hasher(self.data).ranges(self.starts, self.ends)

    def hashes(self) -> np.ndarray:
        return self._hashes

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def text_of(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row + 1, UTF-8 texts; null: empty) in runs of about ``limit`` bytes."""
    texts, start, size, held = batch.column(column), 0, 0, []
    for at in range(0, len(batch), 128):
        for t in texts.slice(at, 128).cast(pa.binary()).to_pylist():
            held.append(t or b"")
            size += len(held[-1])
            if size >= limit:
                yield start, start + len(held), held
                start, size, held = start + len(held), 0, []
    if held:
        yield start, start + len(held), held


class Lookup:
    """Places of 64-bit keys in a sorted table, with a bitmap in front for those absent."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each key in ``keys``, or -1."""
        out = np.full(len(x), -1, np.int64)
        if not len(self.keys):
            return out
        maybe = np.flatnonzero(self.seen[(x >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, x[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == x[maybe], at, -1)
        return out


_ENDS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether the i-th words of ``a`` are the j-th of ``b``, byte for byte."""
    x, y = (np.ndarray(len(w.data) + 1, "<u8", w.padded, strides=(1,)) for w in (a, b))
    size = a.ends[i] - a.starts[i]
    same = size == b.ends[j] - b.starts[j]
    at, rest = 0, np.flatnonzero(same & (size > 0))
    while len(rest):
        mask = _ENDS[np.minimum(size[rest] - at, 8)]
        equal = (x[a.starts[i[rest]] + at] ^ y[b.starts[j[rest]] + at]) & mask == 0
        same[rest[~equal]] = False
        at += 8
        rest = rest[equal & (size[rest] > at)]
    return same


class Vocabulary:
    """Numbers of the distinct words of some texts; hashes propose a word, its bytes decide."""

    def __init__(self, words: Words):
        hashes = words.hashes()
        self.lookup = Lookup(hashes)
        model = np.zeros(len(self.lookup.keys), np.int64)
        at = np.searchsorted(self.lookup.keys, hashes)
        model[at[::-1]] = np.arange(len(hashes))[::-1]
        # words whose hash is that of another one
        self.more: dict[bytes, int] = {}
        for k in np.flatnonzero(~same_words(words, np.arange(len(at)), words, model[at])).tolist():
            self.more.setdefault(words.word(k), len(model) + len(self.more))
        self.size = len(model) + len(self.more)
        self.models = Words([b" ".join(words.word(k) for k in model.tolist())], words.inside)

    def find(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for those that aren't here."""
        out = self.lookup.find(words.hashes())
        held = np.flatnonzero(out >= 0)
        for k in held[~same_words(words, held, self.models, out[held])].tolist():
            out[k] = self.more.get(words.word(k), -1)
        return out
