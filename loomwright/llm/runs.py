"""Periodic runs of words by the Gusfield-Stoye method, on arrays.

The texts of a batch are one sequence of word numbers with a separator of
its own after each. Three steps, as in Gusfield and Stoye (2004):

1. The sequence is cut into Lempel-Ziv blocks. The leftmost occurrence of
   a repetition crosses a block border, so for each border and each period
   up to the size of the two blocks beside it, common extensions to both
   sides give the leftmost-covering repetitions.
2. Suffix links complete the vocabulary: from the place of a repetition in
   the suffix tree, the link to the next suffix leads to its rotation, as
   long as the covering run goes on. A place is an interval of the suffix
   array and a depth.
3. The leaves below a place are the occurrences of its repetition; those
   of one period that overlap merge into runs.

Repetitions are `exponent`-th powers here, squares for exponent 2. Equal
words have equal numbers, extensions compare ranks of blocks of 1, 2, 4, ...
words, so nothing is decided by hashing but the word's own 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, others, slices, text_buffers
from .grams import NOT_SPACE, Words, grams

SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Words in a row that the filter before the search looks at.
GRAM = 3
_U = np.uint64


class Ranks:
    """Ranks of all blocks of 1, 2, 4, ... numbers of a sequence, its suffix array and inverse.

    A block that passes the end ranks below longer ones with the same start.
    """

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
        self.n, self.levels = n, [rank.astype(np.int32)]
        size = 1
        order = np.argsort(rank, kind="stable")
        while size < n and len(rank) and rank.max() < n - 1:
            key = rank * (n + 1)
            key[: n - size] += rank[size:] + 1
            order = np.argsort(key, kind="stable")
            part = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(part[1:] != part[:-1])))
            self.levels.append(rank.astype(np.int32))
            size *= 2
        self.order, self.rank = order, np.empty(n, np.int64)
        self.rank[order] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers that the suffixes at a and b have in common at their start (a and b differ)."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[rank[a[inside]] == rank[b[inside]]]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers in common before a and b, nearest first."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[k], 1 << k
            inside = np.flatnonzero((a >= size) & (b >= size))
            same = inside[rank[a[inside] - size] == rank[b[inside] - size]]
            a[same] -= size
            b[same] -= size
        return start - a


def lz_blocks(ranks: Ranks, common: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest piece that also starts earlier, or one new number.

    common[i] is what the i-th and (i+1)-th suffix in order share.
    """
    n, order = ranks.n, ranks.order.tolist()
    # nearest suffixes in order, to both sides, that start earlier, and what is shared with them
    longest = [0] * n
    shared = common.tolist()
    for places in (range(n), range(n - 1, -1, -1)):
        stack: list[tuple[int, int]] = []
        step = places.step
        for i in places:
            p = order[i]
            least = n if not stack else shared[i - 1 if step > 0 else i]
            while stack and stack[-1][0] > p:
                below = stack.pop()[1]
                least = min(least, below)
            if stack and least > longest[p]:
                longest[p] = least
            stack.append((p, least))
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += max(longest[at], 1)
    return np.array(starts, np.int64)


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with j = 0, 1, ..., counts[i] - 1."""
    i = np.repeat(np.arange(len(counts)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def _extend(ranks: Ranks, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch with that period around words at and at + period."""
    return at - ranks.backward(at, at + period), at + period + ranks.forward(at, at + period)


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch of at least exponent periods once, with its smallest period."""
    long = end - start >= exponent * period
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def covering_runs(ranks: Ranks, seq: np.ndarray, common: np.ndarray, longest: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, end, period) that cross a block border; longest[i] bounds the period at i."""
    starts = lz_blocks(ranks, common)
    size = np.diff(np.concatenate((starts, [ranks.n])))
    after, before = np.concatenate((size[1:], [0])), np.concatenate(([0], size[:-1]))
    # periods whose first repeat is at the border, then those whose repeat ends a block
    b, k = _counted(np.minimum(size + after, longest[starts]))
    h, p = starts[b], k + 1
    right = h + p < ranks.n
    h, p = h[right], p[right]
    same = seq[h] == seq[h + p]
    at, period = [h[same]], [p[same]]
    b, k = _counted(np.minimum(np.minimum(before + size, longest[starts]), starts))
    h, p = starts[b], k + 1
    same = seq[h] == seq[h - p]
    at.append(h[same] - p[same])
    period.append(p[same])
    at, period = np.concatenate(at), np.concatenate(period)
    start, end = _extend(ranks, at, period)
    return _distinct(start, end, period, exponent)


def _interval(common: np.ndarray, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix, in order, below the place of the suffix at `rank` and that depth.

    Minima over 1, 2, 4, ... neighbours are made level by level and used going back down.
    """
    levels = [common]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        last, size = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-size], last[size:]))
    lo, hi = rank.copy(), rank.copy()
    for k in range(len(levels) - 1, -1, -1):
        size, least = 1 << k, levels[k]
        can = np.flatnonzero((hi + size - 1 < len(common)) & (hi < len(least)))
        go = can[least[hi[can]] >= depth[can]]
        hi[go] += size
        can = np.flatnonzero(lo - size >= 0)
        go = can[least[lo[can] - size] >= depth[can]]
        lo[go] -= size
    return lo, hi


def vocabulary(ranks: Ranks, common: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (first leaf, last leaf, period) of all powers in the covering runs, each once.

    The suffix link of the place of a power at i leads to the one at i + 1;
    after a whole period it comes back to the first.
    """
    run, step = _counted(np.minimum(period, end - start - exponent * period + 1))
    at, p = start[run] + step, period[run]
    lo, hi = _interval(common, ranks.rank[at], exponent * p)
    order = np.lexsort((lo, p))
    lo, hi, p = lo[order], hi[order], p[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (p[1:] != p[:-1])
    return lo[new], hi[new], p[new]


def all_runs(seq: np.ndarray, longest: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs (start, end, smallest period) of at least `exponent` periods, by start, then period."""
    none = np.zeros(0, np.int64)
    if not len(seq):
        return none, none, none
    ranks = Ranks(seq)
    common = ranks.forward(ranks.order[:-1], ranks.order[1:])
    start, end, period = covering_runs(ranks, seq, common, longest, exponent)
    if not len(start):
        return none, none, none
    lo, hi, p = vocabulary(ranks, common, start, end, period, exponent)
    place, leaf = _counted(hi - lo + 1)
    at, p = ranks.order[lo[place] + leaf], p[place]
    order = np.lexsort((at, p))
    at, p = at[order], p[order]
    # occurrences of one period at neighbouring words belong to one run
    first = np.ones(len(at), bool)
    first[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    stop = np.concatenate((begin[1:], [len(at)])) - 1
    start, end, period = _distinct(at[begin], at[stop] + exponent * p[begin], p[begin], exponent)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def gram_size(exponent: int, least: int) -> int:
    """The longest gram, up to GRAM words, that every run repeats at its period at least once."""
    return max(min(GRAM, least - 1, *(max(least, exponent * q) - q for q in range(1, least + 2))), 1)


def may_hold_runs(words: Words, exponent: int, least: int) -> np.ndarray:
    """A flag for each word; every run lies inside one stretch of flagged words of a text.

    In a run of period q, each gram that starts q words or more after the
    start has occurred q words before, so its last occurrence is at most q
    back; a stretch of t such grams means exponent * q <= t + q + gram - 1.
    Grams whose last occurrence is farther than their stretch allows are
    left out until nothing changes.
    """
    n, g = len(words.hash), gram_size(exponent, least)
    flags = np.zeros(n, bool)
    every = grams(words.hash, g)
    m = len(every)
    if not m:
        return flags
    order = np.argsort(every, kind="stable")
    back = np.full(m, n + 1, np.int64)
    same = np.flatnonzero((every[order[1:]] == every[order[:-1]]) & (words.text[order[1:]] == words.text[order[:-1]]))
    back[order[same + 1]] = order[same + 1] - order[same]
    back[words.text[:m] != words.text[g - 1 :]] = n + 1
    good = back <= n
    while True:
        a, b = _stretches(good)
        most = (b - a + g - 1) // (exponent - 1)
        now = np.zeros(m, bool)
        i, j = _counted(b - a)
        at = a[i] + j
        now[at] = back[at] <= most[i]
        if (now == good).all():
            break
        good = now
    if not len(a):
        return flags
    # a stretch, the period before it and the gram's end behind it, within its text
    lo = np.maximum(a - most, words.first[words.text[a]])
    hi = np.minimum(b + g - 1, words.first[words.text[a] + 1])
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, lo, 1)
    np.add.at(depth, hi, -1)
    return np.cumsum(depth[:-1]) > 0


def find_runs(words: Words, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least `least` words and `exponent` periods in all texts: start (in words of the batch), length, period."""
    flags = may_hold_runs(words, exponent, least)
    at = np.flatnonzero(flags)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    # neighbouring stretches of different texts, or with words left out between, get a separator
    new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(words.text[at]) > 0)))
    part = np.cumsum(new) - 1
    number = np.unique(words.hash[at], return_inverse=True)[1].astype(np.int64)
    place = np.arange(len(at)) + part
    size = len(at) + part[-1] + 1
    seq = np.full(size, -1, np.int64)
    seq[place] = number
    gaps = np.flatnonzero(seq < 0)
    seq[gaps] = len(at) + np.arange(len(gaps))
    origin = np.full(size, -1, np.int64)
    origin[place] = at
    longest = np.zeros(size, np.int64)
    longest[place] = (np.bincount(part) // exponent)[part]
    start, end, period = all_runs(seq, longest, exponent)
    long = end - start >= least
    return origin[start[long]], (end - start)[long], period[long]


def _collapsed(words: Words, data: np.ndarray, offsets: np.ndarray, dropped: np.ndarray) -> pa.Array:
    """The texts' kept words, one space between; the byte behind a word that isn't a text's last is always a blank."""
    stay = np.flatnonzero(~dropped)
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, words.starts[stay], 1)
    np.add.at(keep, words.ends[stay], -1)
    take = np.cumsum(keep[:-1]) > 0
    behind = words.ends[stay[:-1]][words.text[stay[1:]] == words.text[stay[:-1]]] if len(stay) else stay
    out = data.copy()
    out[behind] = 0x20
    take[behind] = True
    ends = np.concatenate(([0], np.cumsum(take, dtype=np.int64)))[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(out[take].tobytes()))


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """The kept columns, n_words, runs and collapsed for each row.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of words with smallest
    period q, at least `least` words and exponent * q words long, that can't
    be made longer with period q; runs come by start, then period, numbered
    from word 0. collapsed has the words that no run contains after its
    first q words, one space between.

    Null and empty texts have no words, no runs and an empty text. Equal rows
    get equal results, an empty table an empty one; kept columns named like
    a result are replaced by it. A very long text is worked on alone; memory
    grows with the words of its parts that may hold runs (about 100 bytes a word).
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    keep = others(keep, "n_words", "runs", "collapsed")
    schema = fields(docs, keep) + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, offsets = text_buffers(batch.column("__text"))
            words = Words(data, offsets, NOT_SPACE, lower=None)
            start, length, period = find_runs(words, exponent, least)
            depth = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            owner = words.text[start]
            counts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=words.texts))))
            items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - words.first[owner], length, period)], ["start", "length", "period"])
            columns = [batch.column(c) for c in keep]
            columns.append(pa.array(words.count, pa.int64()))
            columns.append(pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items))
            columns.append(_collapsed(words, data, offsets, np.cumsum(depth[:-1]) > 0).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "runs", "collapsed"])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
