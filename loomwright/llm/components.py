"""Connected components of an edge table: union-find inside partitions, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find with path halving; the smaller root wins. Returns node -> smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        up = parent.setdefault(x, x)
        while up != x:
            parent[x] = parent[up]
            x = parent[x]
            up = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as one edge from each node to its local root; a partition is bounded by Spark's split size."""

    def pairs():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    found = [(x, r) for x, r in forest(pairs()).items() if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges u > v: large links all larger neighbours of a node to its smallest
    neighbour, small links a node and its smaller neighbours to the smallest of them."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges, component being the smallest node that it reaches.

    Edges with a null end and loops are ignored. Each round halves the
    depth at least, so rounds grow with the logarithm of a component's
    size; a component of any size is spread over all tasks.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(pairs.mapInArrow(_contract, "u long, v long"), "edges")
    before = None
    for _ in range(rounds):
        # a node's own value is fixed when every node has one edge, to a root that has none
        loose = now.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        roots = loose.select("v").distinct()
        odd = loose.where("n > 1").select("u").union(loose.select("u").join(roots, loose["u"] == roots["v"], "left_semi")).limit(1).count()
        if not odd:
            break
        nxt = stored(_star(stored_step := stored(_star(now, True), "edges"), False), "edges")
        discard(stored_step)
        if before is not None:
            discard(before)
        before, now = now, nxt
    else:
        raise RuntimeError("components did not settle")
    if before is not None:
        discard(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
