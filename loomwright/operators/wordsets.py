"""Pairs of rows with similar word sets, exactly: shared rare words, signatures, then whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.measures import tokens
from loomwright.sources.scratch import discard, stored

#: Slots in which words are counted, and slots of one block of them.
SLOTS, BLOCK = 1 << 22, 1 << 12
#: Words that a pair has to share among the first of both (fewer for the smallest sets); 12 can be divided by it.
SHARED = 3
#: Sets with one word that meet at most in one task as the larger ones of their pairs; members of a bucket of comparisons, about.
PART, MEMBERS = 4096, 1000
#: Members up to which each executor gets all of their buckets (not their words); more are joined by a shuffle.
MOST_BROADCAST = 250_000
#: Words, or pairs, that are worked on at a time.
WORDS, PAIRS = 1 << 19, 1 << 20


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and the bounds of each row's; a null has none."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)


class Marks:
    """Which of a column's numbers there are, a bit for each."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        at = F.col(name)
        found = rows.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits")).collect()
        found.sort(key=lambda r: r.block)
        self.blocks = np.array([r.block for r in found], np.int64)
        self.bits = np.array([np.frombuffer(r.bits, np.uint8) for r in found], np.uint8).reshape(len(found), 4096)

    def has(self, k: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.blocks, k >> 15), max(0, len(self.blocks) - 1))
        if not len(self.blocks):
            return np.zeros(len(k), bool)
        return (self.blocks[at] == k >> 15) & (self.bits[at, (k & 32767) >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)


def _marked(marks: Marks, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """The marked rows, with their keys, words and bounds, about WORDS words at a time."""
    for batch in batches:
        batch = batch.filter(pa.array(marks.has(batch.column("k").to_numpy())))
        sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
        turn = (np.cumsum(sizes) - 1) // WORDS
        for start, stop in zip(*(np.flatnonzero(np.diff(x)) for x in (np.r_[-1, turn], np.r_[turn, -1])), strict=True) if len(turn) else ():
            part = batch.slice(start, stop - start + 1)
            yield part, part.column("k").to_numpy(), *_lists(part.column("words"))


def _tallied(marks: Marks):
    """How often a task's words hit each slot, by blocks of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int32)
        for _, _, words, _ in _marked(marks, batches):
            slots, n = np.unique(words & (SLOTS - 1), return_counts=True)
            counts[slots] += n.astype(np.int32)
        rows = counts.reshape(-1, BLOCK)
        hit = np.flatnonzero(rows.any(1))
        packed = pa.array([pa.compress(rows[i].tobytes(), "zstd", asbytes=True) for i in hit.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), packed], ["block", "counts"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's counts over all tasks as levels: 0 for none, 1 for one, then eight for each power of two."""
    sums = sum(np.frombuffer(pa.decompress(x, BLOCK * 4, "zstd", asbytes=True), np.int32).astype(np.int64) for x in rows["counts"])
    levels = np.where(sums > 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(sums, 1)))), 0)
    return pd.DataFrame({"block": rows["block"].iloc[:1], "levels": [levels.astype(np.uint8).tobytes()]})


def _levels(sets: DataFrame, marks: Marks) -> np.ndarray:
    """A level of frequency for each slot; 1 only where one set alone has a word of that slot."""
    out = np.zeros((SLOTS // BLOCK, BLOCK), np.uint8)
    for row in sets.mapInArrow(_tallied(marks), "block int, counts binary").groupBy("block").applyInPandas(_added, "block int, levels binary").collect():
        out[row.block] = np.frombuffer(row.levels, np.uint8)
    return out.ravel()


def _rare_words(levels: np.ndarray, marks: Marks, percent: int):
    """A row for each of the first words of a set, rare ones first.

    A set that is the smaller one of a pair has to share SHARED of its first
    `small` words, the larger one of its first `large`. role: 1 smaller, 2
    larger, 3 both. before: a hash of the SHARED words before, 0 for fewer.
    Words of many sets have parts; the larger ones are dealt over these, and
    the smaller ones go to all.
    """
    mixed = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93][: SHARED + 1], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, k, words, bounds in _marked(marks, batches):
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(k)), n)
            words = words.view(np.uint64)
            level = levels[(words & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((level.astype(np.uint64) << np.uint64(56) | words >> np.uint64(8), owner))
            words, level = words[order], level[order]
            place = np.arange(len(words)) - bounds[:-1][owner] + 1
            least = {"small": -(-2 * percent * n // (100 + percent)), "large": -(-percent * n // 100)}
            most = {side: n - o + np.minimum(SHARED, o) for side, o in least.items()}
            before = np.zeros(len(words), np.uint64)
            for i in range(1, SHARED + 1):
                before[i:] += words[:-i] * mixed[i]
            before[place <= SHARED] = 0
            kept = np.flatnonzero((place <= most["large"][owner]) & (level > 1))
            words, level, place, before, owner = (x[kept] for x in (words, level, place, before, owner))
            small = place <= most["small"][owner]
            parts = 1 + (2.0 ** ((level.astype(float) - 1) / 8) / PART).astype(np.int64)
            own = (k[owner].view(np.uint64) * mixed[0] >> np.uint64(33)).astype(np.int64) % parts
            copies = np.where(small, parts, 1)
            at = np.repeat(np.arange(len(words)), copies)
            part = np.where(small[at], np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies), own[at])
            role = np.where(part == own[at], np.where(small[at], 3, 2), 1)
            key = words[at] + part.astype(np.uint64) * mixed[0]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(k[owner][at]), pa.array(n[owner][at].astype(np.int32)), pa.array((place[at] << 2 | role).astype(np.int32)), pa.array(before[at].view(np.int64))], ["key", "k", "size", "place", "before"])

    return run


def _counted(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each pair, with the sum of its weights."""
    x, y, weight = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), pa.array(np.add.reduceat(weight[order], first).astype(np.int32))], ["x", "y", "weight"])


def _met(percent: int):
    """Rows in order of key and size -> pairs that a key has, with 12 over the number of keys that they need.

    A pair is left out where its sizes or the places of the word tell that it
    isn't similar, where the word isn't among the first that two sets of just
    these sizes have to share, and where the SHARED words before are the same
    too: these count already.
    """

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        key, k, size, place, before = (rows[c] for c in ("key", "k", "size", "place", "before"))
        role, place, size = place & 3, (place >> 2).astype(np.int64), size.astype(np.int64)
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]]).astype(np.int64) << 32
        left = np.flatnonzero(role & 1)
        width = np.searchsorted(group + size, group[left] + 100 * size[left] // percent, "right") - left - 1
        turn, start = np.cumsum(width) // PAIRS, 0
        while start < len(left):
            stop = max(start + 1, int(np.searchsorted(turn, turn[start], "right")))
            i, w = left[start:stop], width[start:stop]
            for low in range(0, int(w.max()), PAIRS):  # of one set alone, if it has more
                v = np.minimum(w - low, PAIRS).clip(0)
                a = np.repeat(i, v)
                b = a + 1 + low + np.arange(len(a)) - np.repeat(np.cumsum(v) - v, v)
                fine = ((role[b] & 2) > 0) & ((before[a] != before[b]) | (before[a] == 0))
                a, b = a[fine], b[fine]
                least = -(-percent * (size[a] + size[b]) // (100 + percent))
                need = np.minimum(SHARED, least)
                both = np.minimum(place[a], place[b]) + np.minimum(size[a] - place[a], size[b] - place[b])
                fine = (both >= least) & (place[a] <= size[a] - least + need) & (place[b] <= size[b] - least + need)
                yield k[a[fine]], k[b[fine]], 12 // need[fine]
            start = stop

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch.column(c).to_numpy() for c in batch.schema.names})
            if held[0]["key"][0] != held[-1]["key"][-1]:
                rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
                held = [{c: v[cut:] for c, v in rows.items()}]
                yield {c: v[:cut] for c, v in rows.items()}
        if held:
            yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for rows in whole(batches):
            for some in pairs(rows):
                found.append(some)
                n += len(some[0])
                if n > 4 * PAIRS:
                    yield _counted(found)
                    found, n = [], 0
        if n:
            yield _counted(found)

    return run


def _signs(marks: Marks):
    """A bit for each of a power of two of slots: whether an odd number of the set's words is in it. Differing bits are at most the words that two sets don't share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, k, words, bounds in _marked(marks, batches):
            n = np.diff(bounds)
            bits = 1 << np.clip(np.ceil(np.log2(0.75 * n)), 6, 14).astype(np.int64)
            ends = np.cumsum(bits)
            slot = (words.view(np.uint64) >> np.uint64(24)).astype(np.int64) & np.repeat(bits - 1, n)
            odd = np.bincount(np.repeat(ends - bits, n) + slot, minlength=int(ends[-1])).astype(np.uint8) & 1
            packed = np.packbits(odd, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int32)), pa.array([packed[a:b] for a, b in zip(((ends - bits) // 8).tolist(), (ends // 8).tolist(), strict=True)], pa.binary())], ["k", "size", "sign"])

    return run


def _close(percent: int):
    """Drops pairs whose signatures differ in more bits than similar sets may have words of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("sign_x", "sign_y")]
            wide = [np.array(pc.binary_length(s)) for s in sides]
            total = batch.column("size_x").to_numpy().astype(np.int64) + batch.column("size_y").to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            fine = np.zeros(batch.num_rows, bool)
            for a, b in np.unique(np.stack(wide, 1), axis=0):
                rows = np.flatnonzero((wide[0] == a) & (wide[1] == b))
                least = min(a, b)
                folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(s.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1, least), axis=1) for s in sides]
                fine[rows] = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64) <= most[rows]
            yield batch.select(["x", "y"]).filter(pa.array(fine))

    return run


def _chosen(marks: Marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_ in _marked(marks, batches):
            yield part.select(["k", "words"])

    return run


def _compared(percent: int):
    """Buckets of sets and, behind them, pairs of these -> similar pairs: ids, rows, sizes of the intersection and of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            found = []
            words, bounds = _lists(batch.column("words"))
            for i, (bucket, x, y, name, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y", "id", "n")), strict=True)):
                if bucket != now:
                    now, sets = bucket, {}
                if y is None:
                    sets[x] = frozenset(words[bounds[i] : bounds[i + 1]].tolist()), name, n
                    continue
                (a, *x), (b, *y) = sets[x], sets[y]
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    found.append((*x, *y, both, len(a) + len(b)))
            kinds = {"id_x": batch.schema.field("id").type, "n_x": pa.int64(), "id_y": batch.schema.field("id").type, "n_y": pa.int64(), "both": pa.int32(), "sum": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return run


def jaccard_pairs(df: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Pairs of rows whose word sets have 100 * |intersection| >= percent * |union|.

    Equal sets are compared once: pairs are those of set representatives
    (the smallest key) and n_a, n_b say how many rows have the set. Words
    are 64-bit hashes, sets are told apart by the MD5 of their words. Sets
    meet by the first words of each in one order of all words, rare ones
    first, so many that similar sets must share SHARED of these. How
    frequent a word is comes from counts by slots of its hash, which make
    any order a valid one, if seldom a worse one. What has met is compared
    by signatures, and what these leave by whole sets, which go once to
    each bucket of pairs of a family. Sets themselves are written once and
    never shuffled as a whole.
    """
    words = F.sort_array(F.array_distinct(F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w))))
    # not by the array's size, which would find all words twice
    some = F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(r"[\p{L}\p{N}_]")
    rows = df.where(some).select(F.col(key).alias("id"), words.alias("words"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("k"), "id", F.unhex(F.md5(F.col("words").cast("string"))).alias("digest"), "words"), "sets")
    heads = stored(rows.groupBy("digest").agg(F.min("k").alias("k"), F.min("id").alias("id"), F.count("*").alias("n")).drop("digest"), "heads")
    sets, one = rows.select("k", "words"), Marks(heads, "k")
    first = sets.mapInArrow(_rare_words(_levels(sets, one), one, percent), "key long, k long, size int, place int, before long")
    met = first.repartition("key").sortWithinPartitions("key", "size", "k").mapInArrow(_met(percent), "x long, y long, weight int")
    met = met.groupBy("x", "y").agg(F.sum("weight").alias("weight")).where("weight >= 12").select("x", "y")
    signs = stored(sets.mapInArrow(_signs(one), "k long, size int, sign binary"), "signs")
    side = lambda s, table, *columns: table.select(F.col(columns[0]).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns[1:]))
    signed = met.join(side("x", signs, "k", "size", "sign"), "x").join(side("y", signs, "k", "size", "sign"), "y")
    close = stored(signed.mapInArrow(_close(percent), "x long, y long"), "close")
    ends = close.select(F.explode(F.array(F.struct(F.col("x").alias("k"), F.col("y").alias("other")), F.struct(F.col("y").alias("k"), F.col("x").alias("other")))).alias("e")).select("e.*")
    family = stored(ends.groupBy("k").agg(F.min(F.least("k", "other")).alias("label"), F.count("*").alias("degree")), "families")
    part = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("degree_x") / MEMBERS))
    pairs = close.join(side("x", family, "k", "label", "degree"), "x")
    pairs = stored(pairs.select(F.xxhash64("label_x", part("x"), part("y")).alias("bucket"), "x", "y"), "buckets")
    members = stored(pairs.select("bucket", F.explode(F.array("x", "y")).alias("k")).distinct().join(heads, "k"), "members", counted=True)
    chosen = sets.mapInArrow(_chosen(Marks(family, "k")), "k long, words array<long>")
    sent = chosen.join(F.broadcast(members) if members.rows <= MOST_BROADCAST else members, "k").select("bucket", F.col("k").alias("x"), F.lit(None).cast("long").alias("y"), "words", "id", "n")
    sent = sent.unionByName(pairs, allowMissingColumns=True)
    kind = df.schema[key].dataType.simpleString()
    found = sent.repartition("bucket").sortWithinPartitions("bucket", F.col("y").asc_nulls_first()).mapInArrow(_compared(percent), f"id_x {kind}, n_x long, id_y {kind}, n_y long, both int, sum int")
    found = stored(found.where("id_x != id_y"), "similar")
    discard(rows, heads, signs, close, family, pairs, members)
    swap = F.col("id_x") > F.col("id_y")
    of = lambda c, s, t: F.when(swap, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}"))
    return found.select(of("id", "x", "y").alias("id_a"), of("id", "y", "x").alias("id_b"), of("n", "x", "y").alias("n_a"), of("n", "y", "x").alias("n_b"), F.round(F.col("both") / (F.col("sum") - F.col("both")), 6).alias("jaccard"))
