"""Exact vector search for a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors (as doubles) in one block of rows or queries; a pair of blocks is what a task holds at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of queries up to which each executor gets all of them; more are dealt out by a shuffle.
MOST_BROADCAST = 64 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v) -> blocks (d, ids, flat) of vectors of one length."""
    for batch in batches:
        sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            rows, step = np.flatnonzero(sizes == d), max(1, BLOCK_BYTES // (8 * int(d)))
            for at in range(0, len(rows), step):
                part = batch.take(pa.array(rows[at : at + step]))
                ids, flat = part.column("id"), part.column("v").flatten().cast(pa.float64())
                pack = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pack(ids), pack(flat)], ["d", "ids", "flat"])


def _best(k: int, metric: str):
    """Pairs of a block of rows and a block of queries -> the k best rows of that block for each query."""

    def matrix(batch: pa.RecordBatch, name: str, at: int, d: int) -> np.ndarray:
        return batch.column(name)[at].values.to_numpy(zero_copy_only=False).reshape(-1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                d = batch.column("d")[at].as_py()
                x, queries = matrix(batch, "flat", at, d), matrix(batch, "asked_flat", at, d)
                rows, ids = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("ids", "asked"))
                if metric == "cosine":
                    score = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
                elif metric == "inner":
                    score = queries @ x.T
                else:
                    score = -np.sqrt(np.maximum(((queries**2).sum(1)[:, None] - 2 * queries @ x.T) + (x**2).sum(1), 0))
                score = np.round(score, 6)
                score[ids[:, None] == rows] = -np.inf
                top = np.lexsort((np.broadcast_to(rows, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, top, 1)
                good = np.isfinite(best).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])[good]), pa.array(rows[top].ravel()[good]), pa.array(best.ravel()[good])], ["query", "id", "score"])

    return run


def top_k(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "cosine") -> DataFrame:
    """The k best rows of another id for each query: query, id, score (6 decimals) and rank; equal scores by id.

    Rows and queries are packed into blocks, and each pair of blocks sends
    the k best of each query. Neither passes through the driver unless all
    queries fit MOST_BROADCAST bytes. Vectors of different lengths don't
    meet; null and empty vectors, those with a null or non-finite
    component, rows with a null id and, for cosine, zero vectors match
    nothing and, as queries, get no row. No queries give an empty table.
    """

    def blocks(table: DataFrame) -> DataFrame:
        rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        if metric == "cosine":
            fine = fine & F.exists("v", lambda x: x != 0)
        return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & fine).mapInArrow(_packed, "d int, ids array<long>, flat array<double>")

    rows, asked = blocks(df), blocks(queries).withColumnsRenamed({"ids": "asked", "flat": "asked_flat"})
    size = queries.agg(F.sum(8 * F.size(vector_col).cast("long")).alias("bytes")).first().bytes or 0
    if size <= MOST_BROADCAST:
        pairs = rows.join(F.broadcast(asked), "d")
    else:  # a block of rows goes to one deal, a block of queries to all: rows are shuffled once
        deals = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        deal = F.pmod(F.xxhash64("ids"), F.lit(deals)).cast("int")
        pairs = rows.withColumn("deal", deal).join(asked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))), ["d", "deal"])
    out = pairs.select("d", "ids", "flat", "asked", "asked_flat").mapInArrow(_best(k, metric), "query long, id long, score double")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)
