"""Centroid clustering with Yinyang bounds over integer vectors.

Centroids are put into groups once. Each vector keeps an upper bound of the
distance to its centroid and one lower bound for each group's other
centroids; both follow the centroids as they move. A vector whose upper
bound is below all its lower bounds keeps its centroid without any distance
(the global filter); otherwise only groups whose bound isn't above its
distance are looked at (the group filter), and in these all centroids that
may be nearer are measured exactly.

Vectors never move: each round reads the table of vectors with their bounds
and writes the next one, and only sums of clusters are shuffled. Bounds are
doubles rounded to the safe side; decisions between centroids compare exact
integers, so results are those of the plain algorithm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Centroids that one group has on average.
GROUP_SIZE = 4
#: Components of at most this size have squared distances that fit 64 bits.
MOST = 1 << 27
#: Sums of so many components of that size fit 64 bits; a task's sums are passed on before.
ROWS = 1 << 20
#: Vectors that one vectorised step inside a task works on.
STEP = 8192
#: Relative error allowed for a bound, far above that of a double.
SLACK = 1e-9
STATE = "vec_id {kind}, x array<long>, cluster int, upper double, lower array<double>"


def integer_vectors(rows: DataFrame, dims: int, scale: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * component), of the vectors with `dims` components, none null or non-finite."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    ok = (F.size(vector) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(ok).select(F.col(id).alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def starting_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; equal ids by their components; all if there are fewer."""
    named = vectors.select(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("at"), "x")
    return np.array([r.x for r in named.orderBy("at", "x").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c (to the one row, if c is one)."""
    d = x - c
    return np.einsum("...i,...i->...", d, d)


def group_centroids(c: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A group for each centroid, by a few rounds of plain clustering of the centroids themselves."""
    t = max(-(-len(c) // GROUP_SIZE), 1)
    middle = c[:: max(len(c) // t, 1)][:t].astype(float)
    for _ in range(rounds):
        group = np.argmin(((c[:, None] - middle[None]) ** 2).sum(2), 1)
        for g in range(len(middle)):
            if (group == g).any():
                middle[g] = c[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


def _matrix(batch: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
    values = batch.column(name).flatten()
    return values.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, width)


def _full(x: np.ndarray, c: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its distance and the lower bounds, from all distances."""
    d = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        d[:, j] = squared(x, c[j])
    best = np.argmin(d, 1)
    upper = np.sqrt(d[np.arange(len(x)), best].astype(float)) * (1 + SLACK)
    rest = np.sqrt(d.astype(float)) * (1 - SLACK)
    rest[np.arange(len(x)), best] = np.inf
    lower = np.full((len(x), groups), np.inf)
    for g in range(groups):
        lower[:, g] = rest[:, group == g].min(1, initial=np.inf)
    return best, upper, lower


def _filtered(x: np.ndarray, c: np.ndarray, moved: np.ndarray, group: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _full, by the bounds of the last round; `moved` has how far each centroid went."""
    groups = lower.shape[1]
    before = lower
    upper = (upper + moved[best]) * (1 + SLACK)
    lower = (before - np.array([moved[group == g].max() for g in range(groups)])) * np.where(before > 0, 1 - SLACK, 1)
    near = np.flatnonzero(upper >= lower.min(1))  # global filter; at equality a smaller number may win
    if not len(near):
        return best, upper, lower
    exact = squared(x[near], c[best[near]])
    upper[near] = np.sqrt(exact.astype(float)) * (1 + SLACK)
    still = upper[near] >= lower[near].min(1)
    near, exact = near[still], exact[still]
    best, old, old_exact = best.copy(), best[near].copy(), exact.copy()
    found, least = old.copy(), exact.copy()
    entry = np.sqrt(exact.astype(float)) * (1 + SLACK)
    scanned = np.zeros((len(near), groups), bool)
    second = np.full((len(near), groups), np.inf)
    for g in range(groups):
        rows = np.flatnonzero(entry >= lower[near, g])  # group filter
        scanned[rows, g] = True
        for j in np.flatnonzero(group == g):
            ask = rows[old[rows] != j]
            # a centroid that was at least `before` away and moved by moved[j] is still farther than the best
            bound = (before[near[ask], g] - moved[j]) * (1 - SLACK)
            skip = bound > np.sqrt(least[ask].astype(float)) * (1 + SLACK)
            second[ask[skip], g] = np.minimum(second[ask[skip], g], bound[skip])
            ask = ask[~skip]
            d = squared(x[near[ask]], c[j])
            win = (d < least[ask]) | ((d == least[ask]) & (j < found[ask]))
            # the loser bounds its own group
            loser, loser_d = np.where(win, found[ask], j), np.where(win, least[ask], d)
            rest = np.sqrt(loser_d.astype(float)) * (1 - SLACK)
            np.minimum.at(second, (ask, group[loser]), rest)
            found[ask], least[ask] = np.where(win, j, found[ask]), np.where(win, d, least[ask])
    lower[near] = np.where(scanned, second, lower[near])
    # the former centroid joins the others of its group, also where that group wasn't scanned
    left = np.flatnonzero(found != old)
    own = np.sqrt(old_exact[left].astype(float)) * (1 - SLACK)
    np.minimum.at(lower, (near[left], group[old[left]]), own)
    best[near] = found
    upper[near] = np.sqrt(least.astype(float)) * (1 + SLACK)
    return best, upper, lower


def _assign(state: DataFrame, c: np.ndarray, group: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after one assignment; without bounds yet (moved is None) all distances are taken."""
    dims, groups = c.shape[1], int(group.max()) + 1
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                x = _matrix(batch, "x", dims, np.int64)
                if moved is None:
                    best, upper, lower = _full(x, c, group, groups)
                else:
                    best = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                    upper = batch.column("upper").to_numpy(zero_copy_only=False).copy()
                    best, upper, lower = _filtered(x, c, moved, group, best, upper, _matrix(batch, "lower", groups, float))
                ends = pa.array(np.arange(len(x) + 1) * groups, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(best, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))], ["vec_id", "x", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE.format(kind=kind))


def cluster_sums(state: DataFrame, k: int, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of each cluster; each task sends k sums, not vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sums, counts):
            full = np.flatnonzero(counts)
            rows = [pa.array(full, pa.int32()), pa.array(counts[full], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * dims, pa.int32()), pa.array(sums[full].ravel(), pa.int64()))]
            return pa.RecordBatch.from_arrays(rows, ["cluster", "n", "total"])

        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, best = _matrix(batch, "x", dims, np.int64), batch.column("cluster").to_numpy(zero_copy_only=False)
            if counts.sum() + len(x) > ROWS:
                yield out(sums, counts)
                sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            for j in np.unique(best):
                mine = best == j
                sums[j] += x[mine].sum(0)
                counts[j] += mine.sum()
        yield out(sums, counts)

    parts = state.select("x", "cluster").mapInArrow(run, "cluster int, n long, total array<long>")
    totals = parts.select("cluster", "n", F.posexplode("total").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in totals.collect():  # k * dims rows
        found.setdefault(r.cluster, (r.n, [0] * dims))[1][r.i] = int(r.v)
    return found


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, x, cluster, upper, lower) for each kept vector, final centroids).

    Vectors have exactly `dims` components, none null or non-finite, and are
    taken as integers floor(scale * component). The k starting centroids are
    the vectors with the smallest hashes of their ids. Each round assigns
    every vector to the nearest centroid (ties: smaller number) and moves
    every non-empty centroid to the exact floor of its vectors' mean; at the
    end vectors are assigned once more.

    Equal rows count as often as they come and share a cluster; a null id is
    kept; fewer vectors than k give as many centroids; an empty table gives
    an empty state. Vectors with a component beyond 2**27 raise an error:
    their distances don't fit 64 bits.
    """
    vectors = stored(integer_vectors(rows, dims, scale, id, vector), "vectors")
    big = vectors.select(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    if big is not None and big > MOST:
        raise ValueError(f"components beyond {MOST} / {scale} have no 64-bit squared distance")
    c = starting_centroids(vectors, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(c):
        return rows.sparkSession.createDataFrame([], STATE.format(kind=kind)), np.zeros((0, dims), np.int64)
    group = group_centroids(c)
    state, moved = vectors, None
    for r in range(rounds + 1):
        now = stored(_assign(state, c, group, moved), "assigned")
        discard(state)
        state = now
        if r < rounds:
            new = c.copy()
            for j, (n, total) in cluster_sums(state, len(c), dims).items():
                new[j] = [v // n for v in total]
            moved, c = np.sqrt(squared(new, c).astype(float)) * (1 + SLACK), new
    return state, c


def with_inertia(state: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared, exact), the distances' sums over the cluster and over all, and the digest of the centroid."""
    spark = state.sparkSession
    digests = [(j, [int(v) for v in row], hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for j, row in enumerate(c)]
    centroids = F.broadcast(spark.createDataFrame(digests, "cluster int, centroid array<long>, centroid_sha256 string"))  # k rows
    gap = F.zip_with("x", "centroid", lambda a, b: (a - b) * (a - b))
    distance: Column = F.aggregate(gap, F.lit(0).cast("long"), lambda s, d: s + d)
    found = state.join(centroids, "cluster").select("vec_id", "cluster", distance.alias("distance"), "centroid_sha256")
    wide = F.col("distance").cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.sum(wide).alias("s"))
    sums = sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("all")))).select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"))
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
