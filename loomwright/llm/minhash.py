"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash (Ertl 2017): every shingle draws a random permutation of the
signature's slots and puts the value rank + r, r in [0, 1), into each slot;
a slot keeps its minimum. Ranks of one shingle differ in all slots, which
lowers the variance below that of independent hashes, and a document is
done as soon as all its slots hold less than the next rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored, text_buffers
from .components import connected_components
from .grams import NOT_SPACE, Words, mix, shingle_sets

_U = np.uint64
#: 32 bands of 4 slots: a pair at similarity 0.8 is missed with probability (1 - 0.8^4)^32, below 5e-8.
BANDS, ROWS = 32, 4
#: Buckets in common from which two centres are taken for texts of one group: unlikely below a similarity of 0.4.
SEVERAL = 2
#: Members of a centre, and shingles that they differ from it in, that one side of a comparison has.
PART, CELLS = 1500, 500_000
#: Shingles that are looked at in one step.
WIDTH = 2048


def superminhash(elements: np.ndarray, ends: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """Signatures (texts x m) of the element sets that lie back to back in `elements`."""
    texts = len(ends) - 1
    best = np.full((texts, m), np.iinfo(np.uint64).max, _U)
    flat = best.ravel()
    owner = np.repeat(np.arange(texts), np.diff(ends))
    live, perm = mix(elements + _U(seed)), None
    for j in range(m):
        if not len(live):
            break
        draw = mix(live + mix(np.array([j + 1], _U)))
        value = (_U(j) << _U(32)) | (draw >> _U(32))
        k = j + (((draw & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)
        rows = np.arange(len(live))
        slot = k if perm is None else perm[rows, k]
        np.minimum.at(flat, owner * m + slot, value)
        # only texts with a slot above the next rank go on
        goes = (best.max(axis=1) >> _U(32) > j)[owner]
        kept = np.flatnonzero(goes)
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(kept), 1))
            rows = np.arange(len(kept))
        else:
            perm, rows = (perm[kept], np.arange(len(kept))) if len(kept) < len(live) else (perm, rows)
        k = k[kept]
        perm[rows, k] = perm[:, j]
        live, owner = live[kept], owner[kept]
    return best


def _sketch(k: int, bands: int, rows: int):
    m = bands * rows
    weights = mix(np.arange(1, m + 1, dtype=_U)) | _U(1)
    band = mix(np.arange(1000, 1000 + bands, dtype=_U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            data, offsets = text_buffers(batch.column("text"))
            sets, ends = shingle_sets(Words(data, offsets, NOT_SPACE), k)
            signature = superminhash(sets, ends, m)
            keys = mix((mix(signature) * weights).reshape(-1, bands, rows).sum(axis=2, dtype=_U) + band).view(np.int64)
            size = np.diff(ends)
            digests = [hashlib.md5(sets[a:b].tobytes()).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(digests, pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel()),
                ],
                ["id", "digest", "n", "bands"],
            )

    return run


def _compare(k: int, percent: int):
    """For pairs of a centre a and a member b: whether they are linked, b's set size, the shingles that b
    adds to a's and those of a's that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            one, two = (shingle_sets(Words(*text_buffers(batch.column(c)), NOT_SPACE), k) for c in ("text_a", "text_b"))
            linked, size, added, removed = [], [], [], []
            for i in range(batch.num_rows):
                x, y = one[0][one[1][i] : one[1][i + 1]], two[0][two[1][i] : two[1][i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                size.append(len(y))
                added.append(np.setdiff1d(y, x, assume_unique=True).view(np.int64))
                removed.append(np.setdiff1d(x, y, assume_unique=True).view(np.int64))
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (added, removed)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), *lists], ["a", "b", "linked", "size", "added", "removed"])

    return run


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of all ids in the pairs, stored. The ids grow with the table and have no proven bound, so they aren't broadcast."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return stored(docs.join(wanted.hint("merge"), "id", "left_semi").select("id", "text").distinct(), "pair-texts")


def _compared(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) compared by their full shingle sets."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    schema = "a long, b long, linked boolean, size long, added array<long>, removed array<long>"
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(k, percent), schema), "compared")


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each array of the first list shares with each of the second; no array repeats a value."""
    out = np.zeros((len(one), len(two)), np.float32)
    flat = [np.concatenate(side) if side else np.zeros(0, np.int64) for side in (one, two)]
    # values of one side alone are shared by nobody
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    cells = []
    for side, values in zip((one, two), flat, strict=True):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(shared, values)
        met = at < len(shared)
        met[met] = shared[at[met]] == values[met]
        row, at = row[met], at[met]
        order = np.argsort(at, kind="stable")
        cells.append((row[order], at[order]))
    for low in range(0, len(shared), WIDTH):
        held = []
        for side, (row, at) in zip((one, two), cells, strict=True):
            i, j = np.searchsorted(at, [low, low + WIDTH])
            block = np.zeros((len(side), min(WIDTH, len(shared) - low)), np.float32)
            block[row[i:j], at[i:j] - low] = 1
            held.append(block)
        out += held[0] @ held[1].T
    return out


def linked_parts(one: dict, two: dict, percent: int) -> list[tuple[int, int]]:
    """A forest of what the links between two lists of a centre's members connect, as (node, a smaller node).

    x and y differ in the shingles that one of them adds to the centre's and the other doesn't, and in
    those that one lacks and the other doesn't, so their difference d is known without their texts, and
    they are linked if and only if (100 + percent) * d <= (100 - percent) * (|x| + |y|).
    """
    same = _common(one["added"], two["added"]) + _common(one["removed"], two["removed"])
    apart = [np.array([len(x) + len(y) for x, y in zip(s["added"], s["removed"], strict=True)], np.int64) for s in (one, two)]
    d = apart[0][:, None] + apart[1] - 2 * same.astype(np.int64)
    size = one["size"][:, None] + two["size"]
    links = ((100 + percent) * d <= (100 - percent) * size) & (one["component"][:, None] != two["component"])
    left, right = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    links, least = links[np.ix_(left, right)], np.iinfo(np.int64).max
    a, b = one["node"][left], two["node"][right]
    x, y = a.copy(), b.copy()
    while len(left):
        before = x.sum(dtype=object) + y.sum(dtype=object)
        x = np.minimum(x, np.where(links, y, least).min(1))
        y = np.minimum(y, np.where(links, x[:, None], least).min(0))
        if x.sum(dtype=object) + y.sum(dtype=object) == before:
            break
    return [(int(n), int(r)) for n, r in zip([*a, *b], [*x, *y], strict=True) if n != r]


def residual_links(compared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members of one centre of which one at least is not linked with it, as far as they join components.

    Members are dealt to parts of about PART rows or CELLS differences, those that aren't linked with the
    centre and the others apart. Each part of the former meets each part by itself, in a task that
    compares all their members at once by what they differ from the centre in and returns a forest, so
    rows stay near the number of members times their parts, however many pairs are linked or nearly so.
    Centres whose members are all in one component are left out, and so are pairs inside a component.
    Rows that repeat an id with another text are compared each.
    """
    group = groups.select(F.col("node").alias("b"), "component")
    named = compared.join(group, "b", "left").withColumn("component", F.coalesce("component", "b"))
    cells = F.size("added") + F.size("removed")
    deal = lambda c: F.ceil(F.greatest(F.count_if(c) / PART, F.sum(F.when(c, cells).otherwise(0)) / CELLS)).cast("int")
    facts = named.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), deal(~F.col("linked")).alias("odd"), deal(F.col("linked")).alias("even")).where("odd > 0 and low < high")
    members = named.join(facts.select("a", "odd", "even"), "a")
    mine = F.pmod(F.xxhash64("b", "added"), F.when(F.col("linked"), F.col("even")).otherwise(F.col("odd"))).cast("int")
    members = members.withColumn("part", F.when(F.col("linked"), F.col("odd") + mine).otherwise(mine))
    # (i, j): part i of those that aren't linked and part j of all, not before it
    meets = F.when(F.col("linked"), F.transform(F.sequence(F.lit(0), F.col("odd") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"))))
    every = F.transform(F.sequence(F.lit(0), F.col("odd") + F.col("even") - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j")))
    dealt = members.select("a", "b", "component", "size", "added", "removed", "part", F.explode(F.coalesce(meets, every)).alias("m"))
    dealt = dealt.select("a", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "b", "component", "size", "added", "removed", "part")

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        sides = []
        for side in (table.column("i")[0].as_py(), table.column("j")[0].as_py()):
            rows = table.filter(pa.array(part == side))
            lists = {c: [np.asarray(x.values) for x in rows.column(c)] for c in ("added", "removed")}
            sides.append(lists | {"node": rows.column("b").to_numpy(), "component": rows.column("component").to_numpy(), "size": rows.column("size").to_numpy()})
        found = linked_parts(*sides, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    # the join left a centre's rows together; its pairs of parts go to tasks of their own
    return dealt.repartition("a", "i", "j").groupBy("a", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id and kept.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and
    taken as sets of k-word shingles; two are linked if
    100 * |intersection| >= percent * |union|. component_id is the
    smallest id reachable over links, kept is id = component_id.

    Null, empty and blank texts have no shingles and link with nothing.
    Rows that share an id are one node: what any of them links with, the
    id links with, so repeated rows give the same row as often. A null id
    cannot be named: component_id is null and kept true. Other columns
    are ignored, whatever their names. An empty table gives an empty one.

    Candidates are pairs that share a band. Each band's bucket has a
    centre, the member that shares most buckets with others, or that
    member's own centre, and every member is compared with it, so a group
    of copies costs one comparison a member and not one a pair. Members
    that are not linked with their centre are then compared with all
    others of it, in parts (residual_links), which loses no link inside a
    bucket.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = stored(docs.mapInArrow(_sketch(k, BANDS, ROWS), "id long, digest binary, n long, bands array<long>"), "signatures")
    signed = every.where("id is not null and n > 0")
    # equal sets: one representative, and an edge to it from each other id
    reps = stored(signed.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "sets")
    copies = signed.select("digest", "id").join(reps.where("copies > 1").select("digest", "node"), "digest").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()
    buckets = reps.select(F.explode("bands").alias("key"), "node")
    shared = stored(buckets.join(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "buckets")
    weighed = shared.join(shared.groupBy("node").agg(F.sum("size").alias("weight")), "node")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("node").alias("last"))).alias("most")).select("key", F.bitwise_not("most.last").alias("centre"))
    met = shared.join(centres, "key").groupBy("centre", "node").agg(F.count("*").alias("n"))
    met = stored(met, "met")
    # a centre's buckets go to the heaviest other centre that it shares several with, so that a group has few centres
    weight = weighed.groupBy("node").agg(F.max("weight").alias("weight"))
    heavier = met.where(F.col("n") >= SEVERAL).join(met.select(F.col("centre").alias("node")).distinct(), "node", "left_semi").join(weight.select(F.col("node").alias("centre"), "weight"), "centre")
    roots = heavier.groupBy("node").agg(F.max(F.struct("weight", F.bitwise_not("centre").alias("last"))).alias("most")).select(F.col("node").alias("centre"), F.bitwise_not("most.last").alias("root"))
    stars = met.join(roots, "centre", "left").select(F.coalesce("root", "centre").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    stars = stored(stars, "stars")
    texts = _texts(docs, stars)
    first = _compared(texts, stars, k, percent)
    links = first.where("linked").select("a", "b")
    part = stored(connected_components(links, "a", "b"), "groups")
    residual = stored(residual_links(first, part, percent), "residual")
    groups = connected_components(links.union(residual).union(copies), "a", "b")
    for used in (reps, shared, met, stars, texts, first, part, residual):
        discard(used)
    out = every.select("id", "n").join(groups, every["id"] == groups["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
