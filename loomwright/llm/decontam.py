"""Benchmark decontamination by winnowing.

Winnowing (Schleimer, Wilkerson, Aiken 2003) keeps of every w consecutive
k-gram hashes the smallest one, so two texts that share k + w - 1 words in
a row share a kept fingerprint inside that span. Spans are `window` words
of a benchmark item; items with fewer words are one span of their own
length, for which every gram of that length is kept (k = length, w = 1).
Documents that share a fingerprint are extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_buffers
from .grams import LETTERS_DIGITS, Words, grams, mix

_U = np.uint64
#: Words in a fingerprinted gram where the span has `window` words.
GRAM = 7
#: Fingerprints (8 bytes each) that every task may hold; a larger benchmark goes through a shuffled join.
MOST_BROADCAST = 250_000
#: Items that one row of a document has beside it, about.
BLOCK = 64


def plan_for(length: int, window: int) -> tuple[int, int]:
    """(k, w) whose guarantee is a span of `length` words: k + w - 1 = length."""
    k = min(GRAM, window) if length >= window else length
    return k, (window if length >= window else length) - k + 1


def winnow(values: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept values: the smallest of each w in a row, the rightmost of equals."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n) + w - 1
    least = values[at]
    for j in range(w - 2, -1, -1):
        new = values[j : j + n]
        less = new < least
        least = np.where(less, new, least)
        at = np.where(less, np.arange(n) + j, at)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprints(words: Words, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, text) of all the texts for spans of `length` words."""
    k, w = plan_for(length, window)
    every = mix(grams(words.hash, k) + _U(length))
    # grams over the border of two texts are more than those of the texts; they only add fingerprints
    at = winnow(every, w)
    return every[at], words.text[at]


def _spans(words: Words, t: int, window: int) -> int:
    return min(int(words.count[t]), window)


def _item_prints(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column("text")), LETTERS_DIGITS)
            ids, prints, lengths = batch.column("item").to_pylist(), [], []
            for t in range(words.texts):
                if length := _spans(words, t, window):
                    k, w = plan_for(length, window)
                    own = mix(grams(words.hash[words.first[t] : words.first[t + 1]], k) + _U(length))
                    found = np.unique(own[winnow(own, w)]).view(np.int64)
                    prints += [(int(x), ids[t], length) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in prints], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32()))], ["print", "item", "length"])

    return run


def _matched(prints: np.ndarray | None, lengths: list[int], window: int):
    """Documents with their word counts and fingerprints, those in `prints` only unless it is None; the text stays with rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column("text")), LETTERS_DIGITS)
            found = [np.zeros((2, 0), np.int64)]
            for length in lengths:
                value, text = fingerprints(words, length, window)
                if prints is not None:
                    near = np.minimum(np.searchsorted(prints, value), len(prints) - 1)
                    hit = prints[near] == value
                    value, text = value[hit], text[hit]
                found.append(np.stack([text, value.view(np.int64)]))
            text, value = np.unique(np.concatenate(found, axis=1), axis=1)
            ends = np.searchsorted(text, np.arange(words.texts + 1)).astype(np.int32)
            kept = batch.column("text").take(pa.array(np.arange(words.texts), mask=ends[1:] == ends[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), kept, pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(ends, value)], ["id", "key", "text", "n_words", "prints"])

    return run


def _packed(words: Words) -> tuple[bytes, np.ndarray]:
    """All words, one blank behind each, and where each starts (and the last ends): equal windows are equal slices."""
    size = words.ends - words.starts
    ends = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out[ends[word] + place] = words.low[words.starts[word] + place]
    return out.tobytes(), ends


def _extend(window: int):
    """Which words of a document lie in windows of a block of items, as runs, and the items that have such windows.

    Equal windows of an item are looked for once, and each place is one comparison of bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, tuple[Words, bytes, np.ndarray]] = {}
        for batch in slices(batches, "text"):
            docs = Words(*text_buffers(batch.column("text")), LETTERS_DIGITS)
            packed, at = _packed(docs)
            groups = batch.column("items").to_pylist()
            rows = []
            for t in range(docs.texts):
                first = int(docs.first[t])
                own = docs.hash[first : docs.first[t + 1]]
                hit, names = np.zeros(len(own) + 1, np.int64), []
                sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for item in groups[t]:
                    if len(read) > 5000:
                        read.clear()
                    if (known := read.get(item["text"])) is None:
                        other = Words(*text_buffers(pa.array([item["text"]])), LETTERS_DIGITS)
                        known = read[item["text"]] = other, *_packed(other)
                    other, said, their = known
                    length = _spans(other, 0, window)
                    if length not in sorted_by:
                        every = grams(own, length)
                        order = np.argsort(every, kind="stable")
                        sorted_by[length] = every[order], order
                    every, order = sorted_by[length]
                    wanted, where = np.unique(grams(other.hash, length), return_index=True)
                    low, high = np.searchsorted(every, wanted, "left"), np.searchsorted(every, wanted, "right")
                    found = False
                    for j in np.flatnonzero(high > low):
                        w = said[their[where[j]] : their[where[j] + length]]
                        places = order[low[j] : high[j]]
                        good = [i for i, a, b in zip(places, at[first + places].tolist(), at[first + places + length].tolist(), strict=True) if packed[a:b] == w]
                        np.add.at(hit, good, 1)
                        np.add.at(hit, np.array(good, np.int64) + length, -1)
                        found = found or bool(good)
                    if found:
                        names.append(item["item"])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]))))
                rows.append(([{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], names))
            runs = pa.array([r[0] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), runs, pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["key", "runs", "items"])

    return run


def _covered(runs: F.Column) -> F.Column:
    """How many numbers lie in a sorted array of runs (start, stop) that may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def take(acc: F.Column, r: F.Column) -> F.Column:
        return F.struct(F.greatest(acc["upto"], r["stop"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), r["stop"] - F.greatest(acc["upto"], r["start"]))).alias("n"))

    return F.aggregate(runs, zero, take, lambda acc: acc["n"])


def row_key(row_id: F.Column, text: F.Column) -> F.Column:
    """What tells rows of contamination() apart: a 128-bit key of a row's id and text."""
    both = (row_id.cast("string"), text.cast("string"))
    return F.concat_ws("-", F.xxhash64(*both).cast("string"), F.xxhash64(F.lit(7), *both).cast("string"))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted ids as strings) and contaminated.

    Texts are lower-cased (A-Z) and cut into runs of letters, digits and
    non-ASCII characters. Each `window` consecutive words of an item, or
    a shorter item's whole, is a window; a document word inside any
    occurrence of one is hit; a document is contaminated if it has hits
    and 20 * n_hit >= n_words.

    Null and empty texts have no words, no hits and are clean; an item
    without words or without an id matches nothing. Rows that repeat an
    id are judged each by its own text. Items that repeat an id count
    once. Other columns are ignored. No documents give no rows; without
    items all documents are clean.
    """
    spark = df.sparkSession
    # rows are told apart by id and text, so that repeated ids keep their own results
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", row_key(F.col("id"), F.col("text")))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    prints = stored(items.mapInArrow(_item_prints(window), "print long, item string, length int"), "item-prints")
    lengths = sorted(r[0] for r in prints.select("length").distinct().collect())  # at most `window` values
    # fingerprints are the smallest rank of what is compared: a set of checked size goes to each task
    few = prints.select("print").distinct().limit(MOST_BROADCAST + 1).toArrow().column(0).to_numpy().view(np.uint64)
    known = np.sort(few) if len(few) <= MOST_BROADCAST else None
    if not len(few):
        known, lengths = np.zeros(1, np.uint64), []
    counted = stored(docs.mapInArrow(_matched(known, lengths, window), f"id {df.schema[id_col].dataType.simpleString()}, key string, text string, n_words long, prints array<long>"), "doc-prints")
    pairs = counted.where(F.size("prints") > 0).select("key", F.explode("prints").alias("print")).join(prints.select("print", "item").distinct(), "print").select("key", "item").distinct()
    # a document meets its items in blocks, so that no row holds the texts of all of them
    pairs = stored(pairs, "pairs")
    blocks = pairs.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")))
    listed = dealt.join(items.distinct(), "item").groupBy("key", "block").agg(F.collect_list(F.struct("item", "text")).alias("items"))
    texts = counted.where("text is not null").select("key", "text").join(listed, "key")
    met = texts.select("key", "text", "items").mapInArrow(_extend(window), "key string, runs array<struct<start: long, stop: long>>, items array<string>")
    met = met.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = stored(met.select("key", _covered(F.col("runs")).alias("n_hit"), "items"), "hits")
    out = counted.select("id", "key", "n_words").join(hits, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
