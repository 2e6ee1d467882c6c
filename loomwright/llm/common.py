"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.sources.scratch import discard as discard
from loomwright.sources.scratch import shared_dir as shared_dir
from loomwright.sources.scratch import stored as stored

#: Bytes of text that one vectorised step inside a task works on.
CHUNK_BYTES = 1 << 20


def others(columns: list[str], *results: str) -> list[str]:
    """The named columns without those that a result replaces (names are compared as Spark does, without case)."""
    gone = {r.lower() for r in results}
    return [c for c in dict.fromkeys(columns) if c.lower() not in gone]


def fields(df: DataFrame, columns: list[str]) -> str:
    """The columns' part of a schema string, ready for more fields behind it."""
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*columns).schema.fields}
    return "".join(f"`{name}` {kind}, " for name, kind in kinds.items())


def as_text(column: str) -> F.Column:
    """The column as a string; null stays null."""
    return F.col(column).cast("string")


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column back to back, and where each row starts (one more offset ends the last)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose text has about `most` bytes; a longer row comes alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
