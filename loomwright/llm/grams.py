"""Words and word n-grams of whole UTF-8 texts as 64-bit hashes, many texts at a time.

All separators of the word classes used here are ASCII, so words are found
on the UTF-8 bytes: a table says for each byte value whether it belongs to
a word, and one pass over the buffer yields the words of all its texts.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[0x30:0x3A] = LETTERS_DIGITS[0x61:0x7B] = LETTERS_DIGITS[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U))
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_GRAM = _U(0xD1342543DE82EF95)


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


class Words:
    """The words of several texts: byte starts and ends, the text each is in, a hash each, and words per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: np.ndarray | None = LOWER):
        low = data if lower is None else lower[data]
        inside = table[low]
        self.low, self.texts = low, len(offsets) - 1
        first, last = inside.copy(), inside.copy()
        if len(data):
            filled = offsets[1:] > offsets[:-1]
            edge = np.zeros(len(data), bool)
            edge[offsets[:-1][filled]] = True
            first[1:] &= ~inside[:-1] | edge[1:]
            last[:-1] &= ~inside[1:] | edge[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.count = np.bincount(self.text, minlength=self.texts)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.hash = np.zeros(0, _U)
        if len(self.starts):
            size = self.ends - self.starts
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            self.hash = mix(np.add.reduceat(_BYTE[low[inside]] * _powers(int(size.max()))[place], at) + size.astype(_U))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive items, over text borders too; [i] starts at item i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix(out + _U(k))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, back to back, and their offsets.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    every = grams(words.hash, k)
    sets, ends = [], np.zeros(words.texts + 1, np.int64)
    for t in range(words.texts):
        a, b = words.first[t], words.first[t + 1]
        if b - a >= k:
            part = np.sort(every[a : b - k + 1])
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        else:
            part = grams(words.hash[a:b], int(b - a)) if b > a else every[:0]
        sets.append(part)
        ends[t + 1] = ends[t] + len(part)
    return np.concatenate(sets) if sets else np.zeros(0, _U), ends
