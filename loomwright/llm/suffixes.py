"""Exact removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

All suffixes that can share `length` bytes fall into one bucket: a suffix
is put under the smallest gram hash of its first `length` bytes (its
anchor), which depends on those bytes alone. Consecutive suffixes with one
anchor form a run, and a run's bytes a block. Equal blocks are counted,
not sorted; a bucket with one block is done. The blocks of the other
buckets are sorted one pack of buckets at a time: by the first COVER bytes,
and longer ties by precomputed ranks of a difference cover sample, which
decide any two suffixes in one look. Neighbours in that order that share
`length` bytes are repeats. Buckets with very many blocks are settled by
counting their suffixes' digests over all tasks instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored, text_buffers
from .grams import _BYTE, mix

_U = np.uint64
#: Bytes of the gram whose smallest hash is the anchor.
GRAM = 96
#: Period of the difference cover: 0..7 and the multiples of 8, so that every distance is a difference of two of them.
COVER, STEP = 64, 8
IN_COVER = np.array([i < STEP or i % STEP == 0 for i in range(COVER)])
#: Blocks of a bucket up to which a task sorts it, and bytes of a pack of buckets.
MOST_BLOCKS, PACK = 2000, 1 << 21
#: Windows whose anchors are found at once; places take the low PLACE_BITS of the compared values.
PIECE, PLACE_BITS = 1 << 22, 24

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, _U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=_U)
    return have[:n]


class Rolling:
    """Hashes of any substrings of a buffer, each in constant time."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.inverse = _power(pow(_BASE, -1, 1 << 64), len(data) + 1)

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w values in a row, from minima up to and from block borders."""
    n = len(values)
    grid = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    grid[:n] = values
    grid = grid.reshape(-1, w)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - w + 1], upto[w - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window start, windows, anchor, block) of all runs; starts count from the text's first byte."""
    found = []
    rolling, n = Rolling(data), len(data)
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(valid, dtype=np.int8).astype(bool)
    opens = np.zeros(n + 1, bool)
    opens[offsets[:-1]] = True
    for at in range(0, max(0, n - length + 1), PIECE):
        windows = min(PIECE, n - length + 1 - at)
        grams = rolling.of(slice(at, at + windows + length - gram), slice(at + gram, at + windows + length))
        places = np.arange(len(grams), dtype=_U)
        low = _U((1 << PLACE_BITS) - 1)
        place = (sliding_min((grams & ~low) | places, length - gram + 1) & low).astype(np.int64)
        inside = valid[at : at + windows]
        breaks = opens[at : at + windows].copy()
        breaks[1:] |= place[1:] != place[:-1]
        breaks[1:] |= ~inside[:-1]
        breaks[:1] = True
        first = np.flatnonzero(inside & breaks)
        ends = np.ones(windows, bool)
        ends[:-1] = breaks[1:] | ~inside[1:]
        last = np.flatnonzero(inside & ends)
        anchor = grams[place[first]]
        block = mix(rolling.of(first + at, last + at + length) + (last - first + 1).astype(_U) * _U(0xD1342543DE82EF95) + (place[first] - first).astype(_U))
        text = np.searchsorted(offsets, first + at, "right") - 1
        found.append((text, first + at - offsets[text], last - first + 1, anchor, block))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (int, int, int, _U, _U))


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffers(batch.column("text"))
            text, first, count, anchor, block = runs_of(data, offsets, length, gram)
            if len(text):
                d1, d2 = (batch.column(c).to_numpy()[text] for c in ("d1", "d2"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1, d2, first.astype(np.int32), count.astype(np.int32), anchor.view(np.int64), block.view(np.int64))], ["d1", "d2", "first", "windows", "anchor", "block"])

    return run


# ---- sorting a pack


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank) by several keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank of the suffix at each place of the cover sample by its first `depth` bytes or more; -1 elsewhere.

    A place of the sample plus COVER is one again, so ranks by COVER bytes
    double to ranks by twice as many without any other place.
    """
    at = np.flatnonzero(np.resize(IN_COVER, n))
    rank = np.full(n + 2 * max(depth, COVER) + COVER, -1, np.int64)
    rank[at] = _ranks([words[at + 8 * i] for i in range(COVER // 8)])[1]
    known = COVER
    while known < depth:
        rank[at] = _ranks([rank[at], rank[at + known]])[1]
        known *= 2
    return rank


#: How far two suffixes, by their places modulo COVER, are from two places of the sample.
_TOGETHER = np.array([[next(d for d in range(COVER) if IN_COVER[(a + d) % COVER] and IN_COVER[(b + d) % COVER]) for b in range(COVER)] for a in range(COVER)], np.int64)


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in suffix order by `depth` bytes at least, big-endian 8-byte words at all places)."""
    n = len(data)
    padded = np.zeros(n + 2 * depth + 4 * COVER, np.uint8)
    padded[:n] = data
    words = np.zeros(len(padded) - 8, _U)
    for i in range(8):
        words = (words << _U(8)) | padded[i : len(words) + i]
    ranks = cover_ranks(words, n, depth)
    order, group = _ranks([words[starts + 8 * i] for i in range(COVER // 8)])
    open_, place = starts[order], np.arange(len(starts))
    group, out = group[order], np.empty(len(starts), np.int64)
    # ties are parted by a pivot each: less, equal, greater by cover ranks; all groups at once
    while len(open_):
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(heads, len(group)))
        pivot = np.repeat(open_[heads + size // 2], size)
        shift = _TOGETHER[open_ % COVER, pivot % COVER]
        side = np.sign(ranks[open_ + shift] - ranks[pivot + shift])
        order, fresh = _ranks([group, side])
        open_, side, group = open_[order], side[order], fresh[order]
        alone = np.bincount(group)[group] == 1
        done = alone | (side == 0)
        out[place[done]] = open_[done]
        open_, group, place = open_[~done], group[~done], place[~done]
    return out, words


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which starts have another one with the same `length` bytes."""
    order, words = suffix_order(data, starts, length)
    a, b = order[:-1], order[1:]
    at = np.arange(len(a))
    for i in [*range(0, length - 7, 8), length - 8]:
        at = at[words[a[at] + i] == words[b[at] + i]]
    hit = np.zeros(len(data) + 1, bool)
    hit[a[at]] = hit[b[at]] = True
    return hit[starts]


def _ranges(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"a": a, "b": b} for a, b in edges.reshape(-1, 2).tolist()]


def _sorted(length: int):
    """Rows of whole buckets in bucket order -> the repeated windows of each block, as ranges."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        sizes = np.array([len(r[2]) for r in rows])
        windows = sizes - length + 1
        firsts = np.cumsum(sizes) - sizes
        before = np.cumsum(windows) - windows
        starts = np.repeat(firsts - before, windows) + np.arange(int(windows.sum()))
        hit = repeated(data, starts, length)
        found = [_ranges(hit[s : s + w]) for s, w in zip(before, windows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(found, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["anchor", "block", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= PACK and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield settle(rows)

    return run


# ---- Spark


def _blocks(length: int):
    """Texts with the runs wanted of them -> (anchor, block, hot, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = text.encode()
                out += [(r["anchor"], r["block"], r["hot"], raw[r["first"] : r["first"] + r["windows"] + length - 1]) for r in runs]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "block", "hot", "data"])

    return run


def _digests(length: int):
    """Blocks -> a row per window with two digests of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(row[2], np.uint8)
                n = len(data) - length + 1
                one = Rolling(data).of(slice(0, n), slice(length, length + n))
                two = Rolling(255 - data[::-1]).of(slice(0, n), slice(length, length + n))[::-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row[0])), pa.array(np.full(n, row[1])), pa.array(np.arange(n, dtype=np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["anchor", "block", "a", "w1", "w2"])

    return run


def _cut(length: int):
    """Texts with their repeated windows -> spans to remove and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans, kept, sizes = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = text.encode()
                parts = sorted((r["first"] + x["a"], r["first"] + x["b"] - 1 + length) for r in runs or () for x in r["ranges"])
                merged: list[list[int]] = []
                for a, b in parts:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                at, left = 0, []
                for a, b in merged:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(left))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """d1, d2, text of every different text: tasks drop their copies before any row is dealt by its digests, so a text with very many copies is a row a task."""
    return docs.groupBy("d1", "d2").agg(F.first("text").alias("text"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """id, n_bytes, spans (start, end in bytes) and kept (the bytes outside the spans) of every row.

    A span is a maximal run of bytes that are each covered by a string of
    `length` bytes which starts at another place too, in any row, itself
    included; all strings are judged on the input. Null and empty texts
    have no bytes and no spans, texts shorter than `length` no spans.
    Repeated rows count as often as they occur, so they lose what
    `length` allows. Null ids are kept as they are; other columns are
    ignored, whatever their names. An empty table gives an empty one.
    `length` is at least GRAM. Strings are told apart by two 64-bit hashes
    or byte by byte.
    """
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"))
    docs = docs.withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(7), "text"))
    runs = stored(docs.where(F.octet_length("text") >= length).mapInArrow(_runs(length, min(GRAM, length)), "d1 long, d2 long, first int, windows int, anchor long, block long"), "runs")
    own = ["d1", "d2", "first", "windows"]
    # both sides of the join by anchor come from a table, so that a hot anchor's blocks can be split; what it says of a bucket goes along with its blocks
    blocks = stored(runs.groupBy("anchor", "block").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in own)), "block-counts")
    buckets = stored(blocks.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("blocks")).where("total > 1").select("anchor", "blocks"), "buckets")
    met = stored(blocks.join(buckets, "anchor"), "blocks")
    discard(blocks, buckets)
    mixed = met.where("blocks > 1").withColumn("hot", F.col("blocks") > MOST_BLOCKS)
    # the bytes of one block of each kind, from one row of each text
    wanted = mixed.groupBy("d1", "d2").agg(F.collect_list(F.struct("anchor", "block", "first", "windows", "hot")).alias("runs"))
    data = stored(one_of_each(docs.where(F.octet_length("text") >= length)).join(wanted, ["d1", "d2"]).select("text", "runs").mapInArrow(_blocks(length), "anchor long, block long, hot boolean, data binary"), "block-bytes")
    normal = data.where("not hot").select("anchor", "block", "data")
    ranges = "anchor long, block long, ranges array<struct<a: int, b: int>>"
    by_sort = normal.repartition("anchor").sortWithinPartitions("anchor", "block").mapInArrow(_sorted(length), ranges)
    hot = data.where("hot").select("anchor", "block", "data")
    windows = hot.mapInArrow(_digests(length), "anchor long, block long, a int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    by_count = windows.join(twice, ["w1", "w2"], "left_semi").groupBy("anchor", "block").agg(F.collect_list(F.struct("a", (F.col("a") + 1).alias("b"))).alias("ranges"))
    partly = stored(by_sort.unionByName(by_count).where(F.size("ranges") > 0), "ranges")
    whole = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b"))))
    known = met.join(partly, ["anchor", "block"], "left").select("anchor", "block", F.coalesce(whole, "ranges").alias("ranges")).where("ranges is not null")
    # both sides come from a table and are shuffled alike, so that a hot block's rows can be split
    known = stored(known, "known-blocks")
    verdicts = runs.join(known, ["anchor", "block"]).groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "ranges")).alias("runs"))
    verdicts = stored(verdicts, "verdicts")
    for used in (data, partly, met, known, runs):
        discard(used)
    out = docs.join(verdicts, ["d1", "d2"], "left").select("id", "text", "runs")
    kind = dict(docs.dtypes)["id"]
    found = out.mapInArrow(_cut(length), f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return found.withColumnRenamed("id", id_col)
