"""Byte-level BPE: pre-tokenisation by transition-function scans, cached pair merging, decoding.

The split pattern is a finite automaton over classes of code points. Each
symbol is a function from state to state, functions compose, and
composition is associative; all of them together form a small monoid. So
a prefix scan over a table of products gives the state before every
character of many texts at once, and state and symbol say whether a piece
starts there. No regular expression runs.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, others, slices

# classes of code points
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# symbols: a class, told apart further by what follows
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_LAST, S_RUN = range(8)
# states
END, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
SYMBOLS = STATES = 8
# Ranges of letters and numbers that Unicode 16 added. tiktoken knows them, Python 3.13's unicodedata doesn't.
NEW_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B
1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C
18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Pieces that a worker keeps with their ids; beyond, it starts anew. Longer pieces are not kept.
CACHE, CACHE_BYTES = 300_000, 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at the symbol."""
    if symbol == S_LETTER:
        if state in (TWO_LEFT, ONE_LEFT):  # the letters of a contraction
            return (ONE_LEFT if state == TWO_LEFT else END), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if symbol == S_OTHER or state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, state not in (IN_OTHERS, AFTER_BLANK)
        return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
    if symbol == S_JOIN:  # a blank that goes with what follows
        return AFTER_BLANK, True
    if symbol == S_LAST:  # another white space character before something else stands alone
        return END, True
    return IN_SPACES, state != IN_SPACES


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product table, state that each element leads to from END, starts by state and symbol).

    Symbols from SYMBOLS on are the same at the start of a text: constant functions.
    """
    functions = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    functions += [(f[END],) * STATES for f in functions]
    elements = list(dict.fromkeys(functions))
    for f in elements:  # grows while it is read
        for g in functions:
            if (h := tuple(g[s] for s in f)) not in elements:
                elements.append(h)
    number = {f: i for i, f in enumerate(elements)}
    product = np.array([[number[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] + [True] * SYMBOLS for s in range(STATES)])
    return np.array([number[f] for f in functions], np.uint8), product, np.array([f[END] for f in elements], np.uint8), starts


def scan(items: np.ndarray, product: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive prefix products: within blocks side by side, then over the blocks' totals, then both combined."""
    n, size, table = len(items), len(product), product.ravel()
    if n <= block:
        out = items.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    blocks = -(-n // block)
    grid = np.zeros(blocks * block, np.uint8)
    grid[:n] = items
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    for j in range(1, block):
        grid[j] = table[grid[j - 1].astype(np.int32) * size + grid[j]]
    carry = scan(grid[-1].copy(), product, block)[:-1].astype(np.int32) * size
    grid[:, 1:] = table[carry + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode()
    kinds = np.frombuffer(kinds, np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for low, high in (r.split("-") for r in ranges.split()):
            out[int(low, 16) : int(high, 16) + 1] = kind
    # the code points with the property White_Space
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[0x20] = BLANK
    return out


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts that lie back to back, each starting at one of `firsts`."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    opens = np.zeros(n + 2, bool)
    opens[firsts] = opens[n:] = True
    symbol = kind.copy()  # LETTER, NUMBER and OTHER are their own symbols
    white = kind >= SPACE
    follows = np.zeros(n, bool)  # something that isn't white space, in the same text
    follows[:-1] = ~white[1:] & ~opens[1:n]
    symbol[white] = S_RUN
    symbol[white & follows] = S_LAST
    symbol[(kind == BLANK) & follows] = S_JOIN
    at = np.flatnonzero(points == 0x27)
    if len(at):
        ahead = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = ahead[at + 1], ahead[at + 2]
        near = ~opens[at + 1]
        symbol[at[near & np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[at[near & ~opens[at + 2] & pair]] = S_LONG
    symbol[opens[:n]] += SYMBOLS
    element, product, after, starts = _monoid()
    state = np.zeros(n, np.uint8)
    state[1:] = after[scan(element[symbol], product)[:-1]]
    return np.flatnonzero(starts.ravel()[state.astype(np.int32) * (2 * SYMBOLS) + symbol])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank is merged first, the leftmost of equals.

    A heap holds the pairs, so long pieces take n log n steps.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    nxt, prev, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or stop[j] != end:
            continue  # one of the two parts has changed since
        alive[j] = False
        stop[i], nxt[i] = end, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(piece[i : stop[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop[nxt[i]]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[piece[i : stop[i]]] for i in range(n) if alive[i]]


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """token -> rank from a tiktoken file, once in each worker."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Pieces(dict):
    """piece -> its number; the ids of all pieces lie back to back in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.ids, self.ends = ranks, array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.ids.extend(merge(piece.encode(), self.ranks))
        self.ends.append(len(self.ids))
        number = len(self.ends) - 2
        if len(piece) <= CACHE_BYTES:
            self[piece] = number
        return number


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, back to back."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes back to back, by id, and their ends."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in by_id])))


def _encode(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Pieces(load_ranks(path))
        _, token_ends = _token_bytes(path)
        token_sizes = np.diff(token_ends)
        for batch in slices(batches, column):
            if len(cache.ends) > CACHE:
                cache = Pieces(cache.ranks)
            texts = [t or "" for t in batch.column(column).to_pylist()]
            whole = "".join(texts)
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            stops = np.cumsum([len(t) for t in texts])
            firsts = stops - [len(t) for t in texts]
            starts = piece_starts(points, firsts[firsts < stops])
            cuts = [*starts.tolist(), len(whole)]
            number = np.fromiter((cache[whole[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)), np.int64, len(starts))
            ends = np.frombuffer(bytes(cache.ends), np.int64)
            first, count = ends[number], ends[number + 1] - ends[number]
            ids = np.frombuffer(bytes(cache.ids), np.int32)[_flat(first, count)]
            piece_of = np.searchsorted(starts, np.concatenate((firsts, [len(whole)])))
            list_ends = np.concatenate(([0], np.cumsum(count)))[piece_of].astype(np.int32)
            sizes = np.concatenate(([0], np.cumsum(token_sizes[ids])))
            offsets = (sizes[:-1] - np.repeat(sizes[list_ends[:-1]], np.diff(list_ends))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(list_ends, pa.array(v, pa.int32())) for v in (ids, offsets)]
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != column), *lists], [*(n for n in batch.schema.names if n != column), "ids", "offsets"])

    return run


def _decode(path: str, ids: str, offsets: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, token_ends = _token_bytes(path)
        sizes = np.diff(token_ends)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists, places = part.column(ids), part.column(offsets)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                size = sizes[flat]
                row_bytes = np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum(counts) - counts, len(size))) * (counts > 0)
                base = np.cumsum(row_bytes) - row_bytes
                out = np.empty(int(row_bytes.sum()), np.uint8)
                target = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(base, counts)
                out[_flat(target, size)] = data[_flat(token_ends[flat], size)]
                ends = np.concatenate(([0], np.cumsum(row_bytes))).astype(np.int64)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())
                keep = [n for n in part.schema.names if n not in (ids, offsets)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), part.column(ids), texts], [*keep, ids, to])

    return run


def encode(df: DataFrame, vocabulary: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of df with ids and offsets: token ids of the whole text, and the byte at which each token starts.

    `vocabulary` is the path of a tiktoken rank file on every executor.
    Control strings of chat formats are ordinary text. Null and empty
    texts have no tokens. Rows are independent: repeated rows give
    repeated results, an empty table an empty one. A column of df that is
    not named is dropped; a named one called ids or offsets is replaced by
    the result. A text of any length is encoded whole.
    """
    columns = others(columns, "ids", "offsets")
    kept = df.select(*columns, F.col(text_col).cast("string").alias("__text"))
    return kept.mapInArrow(_encode(vocabulary, "__text"), f"{fields(df, columns)}ids array<int>, offsets array<int>")


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", offsets_col: str = "offsets", to: str = "decoded") -> DataFrame:
    """df with the bytes of its ids, each token put where its offset says, in place of the offsets.

    Null ids and empty lists give no bytes. Rows are independent and keep
    their other columns; one called `to` is replaced by the result. An
    empty table gives an empty one.
    """
    kept = others(df.columns, ids_col, offsets_col, to)
    rows = df.select(*kept, ids_col, offsets_col)
    return rows.mapInArrow(_decode(vocabulary, ids_col, offsets_col, to), f"{fields(df, kept)}`{ids_col}` array<int>, `{to}` binary")
