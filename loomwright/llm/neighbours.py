"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A unit vector x, rotated at random, is stored as its signs s and the
factor f = <s / sqrt(d), x>. For a unit vector y, <s / sqrt(d), y> / f is
an unbiased estimate of <x, y>, whose error is below
EPSILON * sqrt((1 - f^2) / (f^2 (d - 1))) with overwhelming probability.
Vectors whose largest components agree after one of many rotations meet
in a bucket. What goes to the buckets is a code of d / 8 bytes of signs,
d / 2 bytes of rotated components in 16 steps and three numbers, made once
for each vector. Estimates from both sides and their bounds settle nearly
all pairs there; only members of a pair that they leave open are fetched
with their components, by a join, and computed exactly in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import connected_components, forest
from .grams import mix

_U = np.uint64
#: A pair at the threshold itself is in no common bucket with at most this probability; closer pairs far more rarely.
MISS = 1e-3
#: Standard deviations that the bound allows the estimate's error.
EPSILON = 5.0
#: Bits of a key at most; more than 2^44 vectors would be needed to fill them.
MOST_BITS = 48
#: Members of a bucket up to which one task compares them; larger ones are dealt out as pairs of parts.
PART = 1500
#: Members of a bucket up to which buckets are taken many at a time.
SMALL = 64


@lru_cache(256)
def rotation(d: int, number: int) -> np.ndarray:
    """A random rotation of d dimensions, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng([number, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def key_bits(rows: int) -> int:
    """Bits of a key: buckets hold a few unrelated vectors at any size."""
    return max(1, min(MOST_BITS, math.ceil(math.log2(max(rows, 2))) + 4))


def shape(bits: int, d: int) -> tuple[int, int]:
    """(parts of a key, coordinates that a part looks at) for keys of about so many bits."""
    parts = math.ceil(bits / math.log2(2 * min(d, 64)))
    return parts, min(d, math.ceil(2 ** (bits / parts) / 2))


@lru_cache(64)
def tables_for(bits: int, threshold: float, d: int) -> int:
    """Tables that keep MISS for vectors of d components.

    After a random rotation the chance that a pair agrees in a part of a
    key depends on its cosine and d alone; it is measured on random pairs
    at the threshold, less two standard errors.
    """
    parts, width = shape(bits, d)
    draw, rounds, size, same = np.random.default_rng(d), 20, 1000, 0
    for _ in range(rounds):
        x, z = draw.standard_normal((2, size, d))
        x = unit(x)
        z -= np.einsum("ij,ij->i", x, z)[:, None] * x
        y = threshold * x + math.sqrt(1 - threshold**2) * unit(z) if d > 1 else x
        same += int((largest(x[:, :width]) == largest(y[:, :width])).sum())
    chance = same / (rounds * size)
    chance = (chance - 2 * math.sqrt(chance * (1 - chance) / (rounds * size))) ** parts
    return max(1, math.ceil(math.log(MISS) / math.log1p(-chance))) if chance < 1 else 1


def largest(x: np.ndarray) -> np.ndarray:
    """The largest component of each row by size, and its sign, as one number."""
    at = np.abs(x).argmax(axis=1)
    return (2 * at + (x[np.arange(len(x)), at] > 0)).astype(_U)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def keys_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys (rows x tables) of unit vectors: which rotated component is largest, in several blocks; a rotation serves d // width blocks."""
    d = x.shape[1]
    parts, width = shape(bits, d)
    per, out = d // width, np.zeros((len(x), tables), _U)
    for block in range(parts * tables):
        if block % per == 0:
            turned = x @ rotation(d, 1 + block // per)
        t, at = block // parts, block % per * width
        out[:, t] = out[:, t] * _U(2 * width) + largest(turned[:, at : at + width])
    return out


def pack(x: np.ndarray) -> np.ndarray:
    """Codes (rows x bytes) of unit vectors: factor, lowest component and step as 32-bit numbers, signs, components in 16 steps."""
    d = x.shape[1]
    turned = x @ rotation(d, 0)
    factor = np.abs(turned).sum(1) / math.sqrt(d)
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / 15, 1e-12)
    head = np.stack([factor, low, step], axis=1).astype(np.float32).view(np.uint8)
    steps = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    steps = np.pad(steps, ((0, 0), (0, d % 2)))
    return np.concatenate([head, np.packbits(turned > 0, axis=1), steps[:, ::2] << 4 | steps[:, 1::2]], axis=1)


def unpack(codes: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs / sqrt(d), components in steps, factor, step) of codes."""
    factor, low, step = np.ascontiguousarray(codes[:, :12]).view(np.float32).T
    signs = np.unpackbits(codes[:, 12 : 12 + -(-d // 8)], axis=1, count=d).astype(np.float32)
    pairs = codes[:, 12 + -(-d // 8) :]
    steps = np.stack([pairs >> 4, pairs & 15], axis=2).reshape(len(codes), 2 * pairs.shape[1])[:, :d]
    return (2 * signs - 1) / np.float32(math.sqrt(d)), low[:, None] + step[:, None] * steps, np.maximum(factor, 1e-6), step


def _margin(factor: np.ndarray, step: np.ndarray, d: int) -> np.ndarray:
    """What the estimate by a code of that factor may lack: its own error, and that of the other's rounding (uniform in a step, EPSILON deviations)."""
    return EPSILON * (np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(d - 1, 1)) + step / math.sqrt(12) / factor)


def undecided(one: np.ndarray, two: np.ndarray, d: int, threshold: float) -> np.ndarray:
    """Which pairs (rows of one, rows of two) may be linked by both sides' codes."""
    s1, y1, f1, t1 = unpack(one, d)
    s2, y2, f2, t2 = unpack(two, d)
    by_one = s1 @ y2.T / f1[:, None] + _margin(f1[:, None], t2[None], d) >= threshold
    return by_one & (y1 @ s2.T / f2[None] + _margin(f2[None], t1[:, None], d) >= threshold)


def links_between(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Linked (row of x, row of y), computed exactly."""
    i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
    good = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return np.stack([i[good], j[good]], axis=1)


def _keyed(bits: int, threshold: float):
    """Distinct vectors -> a row per table: its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, sizes = part.column("node").to_numpy(), part.column("d").to_numpy()
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                for d in np.unique(sizes):  # vectors of different lengths never meet
                    rows = np.flatnonzero(sizes == d)
                    x = unit(flat[(starts[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d).astype(float))
                    tables = tables_for(bits, threshold, int(d))
                    keys = keys_of(x, bits, tables)
                    keys = mix(keys ^ mix(np.arange(tables, dtype=_U) + (_U(d) << _U(32)))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int16), len(rows))), pa.array(keys.ravel())], ["node", "t", "key"])

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct vectors -> their codes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sizes, codes = part.column("d").to_numpy(), [b""] * part.num_rows
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                made = pack(unit(flat[(starts[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d).astype(float)))
                for i, code in zip(rows.tolist(), made, strict=True):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("d"), pa.array(codes, pa.binary())], ["node", "d", "code"])


def first_met(x: np.ndarray, pairs: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of rows share no bucket of a table before theirs."""
    rows, at = np.unique(pairs, return_inverse=True)
    fresh = np.ones(len(pairs), bool)
    if len(pairs) and table.max():
        keys = keys_of(x[rows], bits, int(table.max()))
        i, j = at.reshape(pairs.shape).T
        for t in range(keys.shape[1]):
            fresh &= (keys[i, t] != keys[j, t]) | (table <= t)
    return fresh


def _small_pairs(x: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """Linked pairs of rows that lie in one place, rows being sorted by place: all shifts, each for all places at once."""
    out, shift = [np.zeros((0, 2), np.int64)], 1
    while len(i := np.flatnonzero(place[shift:] == place[:-shift])):
        j = i + shift
        good = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        out.append(np.stack([i[good], j[good]], axis=1))
        shift += 1
    return np.concatenate(out)


def _open(threshold: float):
    """Places in order -> the rows of theirs that are in a pair that the codes leave open."""

    def small(codes: np.ndarray, place: np.ndarray, d: int) -> np.ndarray:
        signs, near, factor, step = unpack(codes, d)
        keep, shift = np.zeros(len(codes), bool), 1
        while len(i := np.flatnonzero(place[shift:] == place[:-shift])):
            j = i + shift
            open_ = np.einsum("ij,ij->i", signs[i], near[j]) / factor[i] + _margin(factor[i], step[j], d) >= threshold
            open_ &= np.einsum("ij,ij->i", near[i], signs[j]) / factor[j] + _margin(factor[j], step[i], d) >= threshold
            keep[i[open_]] = keep[j[open_]] = True
            shift += 1
        return keep

    def settle(rows: pa.Table) -> list[pa.RecordBatch]:
        sizes, places, sides, crossed = (rows.column(c).to_numpy() for c in ("d", "place", "side", "cross"))
        keep = np.zeros(rows.num_rows, bool)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            codes = np.frombuffer(b"".join(rows.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
            place, side, cross = places[at], sides[at], crossed[at]
            cuts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
            mine = np.zeros(len(at), bool)
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                if q - p <= SMALL and not cross[p]:
                    continue
                one = two = np.arange(p, q)
                if cross[p]:  # only pairs between the two parts
                    one, two = one[side[p:q] == side[p]], one[side[p:q] != side[p]]
                found = undecided(codes[one], codes[two], int(d), threshold)
                if one is two:
                    np.fill_diagonal(found, False)
                mine[one[found.any(1)]] = True
                mine[two[found.any(0)]] = True
            few = np.repeat(np.diff(cuts) <= SMALL, np.diff(cuts)) & ~cross
            mine[few] = small(codes[few], place[few], int(d))
            keep[at] = mine
        return rows.select(["place", "cross", "t", "side", "node"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return _by_place(settle)


def _linked(threshold: float, bits: int):
    """Places in order -> rows (a, b, n): n links of node a first met here, and an edge a-b of a spanning forest of them.

    A pair counts in the first table whose bucket it shares, so a link is counted once however many buckets show it.
    """

    def large(x, node, copies, t, side, cross):
        one = two = np.arange(len(node))
        if cross:  # only pairs between the two parts
            one, two = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
        found = links_between(x[one], x[two], threshold)
        if one is two:
            found = found[found[:, 0] < found[:, 1]]
        found = np.stack([one[found[:, 0]], two[found[:, 1]]], axis=1)
        found = found[first_met(x, found, np.full(len(found), t), bits)]
        a, b = found.T
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        roots = forest(zip(node[a].tolist(), node[b].tolist(), strict=True))
        some = np.flatnonzero(links)
        return node[some], np.array([roots[x] for x in node[some].tolist()], np.int64), links[some].astype(np.int64)

    def settle(rows: pa.Table) -> list[pa.RecordBatch]:
        sizes, place = rows.column("d").to_numpy(), rows.column("place").to_numpy()
        out = [(np.zeros(0, np.int64),) * 3]
        lengths = np.unique(sizes)
        for d in lengths:
            part = rows.filter(pa.array(sizes == d)) if len(lengths) > 1 else rows
            node, copies, t, side, place, cross = (part.column(c).to_numpy() for c in ("node", "copies", "t", "side", "place", "cross"))
            x = unit(np.asarray(part.column("v").combine_chunks().flatten(), float).reshape(-1, d))
            cuts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                if q - p > SMALL or cross[p]:
                    out.append(large(x[p:q], node[p:q], copies[p:q], t[p], side[p:q], cross[p]))
            few = np.repeat(np.diff(cuts) <= SMALL, np.diff(cuts)) & ~cross
            x, node, copies, t, place = x[few], node[few], copies[few], t[few], place[few]
            if len(node):
                found = _small_pairs(x, place, threshold)
                found = found[first_met(x, found, t[found[:, 0]], bits)]
                a, b = found.T
                out += [(node[a], node[b], copies[b]), (node[b], node[a], copies[a])]
        a, b, n = (np.concatenate(c) for c in zip(*out, strict=True))
        return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])]

    return _by_place(settle)


def _by_place(settle):
    """settle() over rows sorted by place, whole places at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            cut = int(np.flatnonzero(place == place[-1])[0])
            if held and place[0] != held[-1].column("place")[held[-1].num_rows - 1].as_py():
                yield from settle(pa.Table.from_batches(held))
                held = []
            if cut:  # rows come sorted by place: all but the last place are complete
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per input row: id, n_links (other vectors at cosine >= threshold), component_id (smallest id that it reaches) and kept.

    Cosines are computed in double precision. Null and zero vectors and
    those with a null or non-finite component link with nothing, vectors
    of different lengths neither. Vectors with equal components are one
    node with as many copies; rows that share an id count each as a
    vector, and their id reaches what any of them reaches. A null id
    cannot be named: component_id is null and kept true. Other columns
    are ignored, whatever their names; an empty table gives an empty one.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    zero = F.lit(0).cast(df.schema[vector_col].dataType.elementType)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    every = stored(vectors.select("id", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda x: x + zero)).alias("v")).withColumn("digest", F.sha2(F.to_json(F.struct("v")), 256)), "vectors")
    usable = every.where("v is not null and id is not null")
    nodes = stored(usable.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("d", F.size("v")), "nodes")
    facts = nodes.agg(F.count("*").alias("rows")).first()
    bits = key_bits(facts.rows)
    keyed = stored(nodes.select("node", "d", "v").mapInArrow(_keyed(bits, threshold), "node long, t short, key long"), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(sizes, "key")
    # small buckets are one place; of a large one each pair of parts is a place
    parts = F.ceil(F.col("size") / PART).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = met.withColumn("side", F.when(F.col("size") <= PART, 0).otherwise(mine)).select("key", "t", "node", "side", "size", other.alias("other"))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    placed = dealt.select("t", "node", "side", (F.col("size").cast("long") > PART).alias("big"), (low != high).alias("cross"), F.when(F.col("size") <= PART, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("place"))
    placed = placed.withColumn("cross", F.col("big") & F.col("cross")).drop("big")
    coded = stored(nodes.select("node", "d", "v").mapInArrow(_coded, "node long, d int, code binary"), "codes")
    ordered = lambda rows: rows.repartition("place").sortWithinPartitions("place", "side", "node")
    rows = placed.join(coded, "node").select("place", "cross", "t", "side", "node", "d", "code")
    left = stored(ordered(rows).mapInArrow(_open(threshold), "place long, cross boolean, t short, side int, node long"), "open")
    # both parts of a place come back, if only as far as they have members in open pairs
    rows = left.join(nodes.select("node", "copies", "d", "v"), "node").select("place", "cross", "t", "side", "node", "copies", "d", "v")
    found = stored(ordered(rows).mapInArrow(_linked(threshold, bits), "a long, b long, n long"), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    named = every.join(nodes.select("digest", "node", "copies"), "digest", "left").where("id is not null and v is not null")
    same = named.where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()
    groups = connected_components(found.where("a <> b").select("a", "b").union(same), "a", "b").withColumnRenamed("node", "member")
    own = nodes.join(counts, nodes["node"] == counts["a"], "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = every.select("id", F.when(F.col("v").isNotNull() & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(own, "digest", "left")
    out = out.join(groups, F.col("id") == F.col("member"), "left")
    component = F.coalesce("component", "id")
    discard(keyed, coded, left)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
