"""A stored positional index of texts: phrases, all or any of some terms, ranked, without scanning the texts.

    path/postings/segment=3/bucket=17   term, key, size (of the text), positions
    path/gone/segment=3                 keys whose earlier rows end with this segment
    path/manifest/segment=3             one row; a segment without it doesn't exist

A write adds a segment and, last, its manifest row, so readers see all of
it or nothing. Texts that come again replace their former rows, which stay
in the older segments until merge() rewrites them. Terms are dealt to
buckets by their CRC-32, so a search reads the folders of its terms only;
inside a bucket rows are sorted by term, so most of a file is skipped. A
frequent term's bucket is split into several files by its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.measures import tokens

#: BM25's usual constants.
K1, B = 1.2, 0.75


def _postings(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("tokens")
            size = np.diff(said.offsets.to_numpy()).astype(np.int64)
            coded = said.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((place, code, row))
            row, code, place = row[order], code[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
            ends = pa.array(np.concatenate((first, [len(row)])), pa.int32())
            columns = [coded.dictionary.take(pa.array(code[first])), batch.column(key).take(pa.array(row[first])), pa.array(size[row[first]].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "key", "size", "positions"])

    return run


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass
class Index:
    """An index at `path`; its size and segments are those of the moment it was opened."""

    spark: SparkSession
    path: str
    buckets: int
    segments: list[int]
    texts: int
    words: int
    n_gone: int
    key_type: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.parquet(f"{path}/manifest").collect()  # a row for each segment
        base = max(r.segment for r in rows if r.whole)
        live = [r for r in rows if r.segment >= base]
        return cls(spark, path, live[0].buckets, sorted(r.segment for r in live), sum(r.texts for r in live), sum(r.words for r in live), sum(r.gone for r in live), live[0].key_type)

    # ---- writing

    @classmethod
    def create(cls, df: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> Index:
        """A new index of the rows; rows with a null key are left out, null texts have no words, of a repeated key one row is taken (the greatest text)."""
        kind = df.schema[key].dataType.simpleString()
        empty = cls(df.sparkSession, path, buckets, [], 0, 0, 0, kind)
        return empty._add(df, key, text, True)

    def upsert(self, df: DataFrame, key: str, text: str) -> Index:
        """Adds texts; those of known keys replace the former ones."""
        return self._add(df, key, text, False)

    def _add(self, df: DataFrame, key: str, text: str, whole: bool) -> Index:
        number = max(self.segments, default=0) + 1
        rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(text).alias("text"))
        said = rows.select("key", tokens(F.col("text")).alias("tokens")).mapInArrow(_postings("key"), f"term string, key {self.key_type}, size int, positions array<int>")
        self._write(said, number)
        new = self._raw([number]).select("key", "size").distinct()
        added = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        removed, gone = (0, 0), 0
        if not whole:
            keys = rows.select("key")
            self._keys(keys, number)
            gone_keys = self._gone_at(number)
            former = self._live(self._raw(self.segments)).select("key", "size").distinct().join(gone_keys.select("key"), "key", "left_semi")
            row = former.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
            removed, gone = (row.n, row.words), gone_keys.count()
        return self._commit(number, added.n - removed[0], added.words - removed[1], gone, whole)

    def remove(self, keys: DataFrame, key: str) -> Index:
        """Takes texts out by their keys."""
        number = max(self.segments) + 1
        self._keys(keys.select(F.col(key).alias("key")).where("key is not null").distinct(), number)
        former = self._live(self._raw(self.segments)).select("key", "size").distinct().join(self._gone_at(number).select("key"), "key", "left_semi")
        row = former.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        return self._commit(number, -row.n, -row.words, self._gone_at(number).count(), False)

    def merge(self) -> Index:
        """One segment of what is live now; the older folders can be deleted once no reader is open on them."""
        number = max(self.segments) + 1
        self._write(self._live(self._raw(self.segments)).drop("bucket", "segment"), number)
        return self._commit(number, self.texts, self.words, 0, True)

    def _write(self, postings: DataFrame, number: int) -> None:
        dealt = postings.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int"))
        # rebalance cuts a bucket that is too large for one task into several
        dealt = dealt.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "key")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")

    def _keys(self, keys: DataFrame, number: int) -> None:
        keys.write.mode("overwrite").parquet(f"{self.path}/gone/segment={number}")

    def _gone_at(self, number: int) -> DataFrame:
        return self.spark.read.schema(f"key {self.key_type}, segment int").parquet(f"{self.path}/gone").where(F.col("segment") == number)

    def _commit(self, number: int, texts: int, words: int, gone: int, whole: bool) -> Index:
        row = [(texts, words, gone, self.buckets, self.key_type, whole)]
        self.spark.createDataFrame(row, "texts long, words long, gone long, buckets int, key_type string, whole boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/segment={number}")
        return Index.open(self.spark, self.path)

    # ---- reading

    def _raw(self, segments: list[int]) -> DataFrame:
        schema = f"term string, key {self.key_type}, size int, positions array<int>, segment int, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("segment").isin(segments))

    def _live(self, postings: DataFrame) -> DataFrame:
        if not self.n_gone:
            return postings
        gone = self.spark.read.schema(f"key {self.key_type}, segment int").parquet(f"{self.path}/gone").where(F.col("segment").isin(self.segments)).groupBy("key").agg(F.max("segment").alias("last"))
        return postings.join(gone, "key", "left").where("last is null or segment >= last").drop("last")

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, key, size, positions) of the live texts that have one of the terms; only the terms' buckets are read."""
        buckets = sorted({bucket_of(t, self.buckets) for t in terms})
        rows = self._raw(self.segments).where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
        return self._live(rows).select("term", "key", "size", "positions")

    def terms_of(self, query: str) -> list[str]:
        """A query's words, cut as the texts were."""
        return self.spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t

    def _weight(self, tf: Column, df: Column) -> Column:
        mean = self.words / max(self.texts, 1)
        idf = F.ln(1 + (self.texts - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / (mean or 1)))

    def match(self, all_of: list[str] | None = None, any_of: list[str] | None = None, none_of: list[str] | None = None) -> DataFrame:
        """(key, score): texts with all of some terms, one at least of others, and none of others, by the BM25 score of the first two kinds.

        Terms are words as the index has them; no term finds nothing.
        """
        must, may, never = (list(dict.fromkeys(x or [])) for x in (all_of, any_of, none_of))
        wanted = list(dict.fromkeys(must + may))
        if not wanted:
            return self.spark.createDataFrame([], f"key {self.key_type}, score double")
        rows = self.postings(wanted)
        often = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
        scored = rows.join(F.broadcast(often), "term").select("key", "term", self._weight(F.size("positions"), F.col("df")).alias("part"))
        found = scored.groupBy("key").agg(F.sum("part").alias("score"), F.count_if(F.col("term").isin(must)).alias("must"), F.count_if(F.col("term").isin(may)).alias("may"))
        found = found.where((F.col("must") == len(must)) & ((F.col("may") > 0) if may else F.lit(True))).select("key", "score")
        return found.join(self.postings(never), "key", "left_anti") if never else found

    def phrase(self, words: list[str]) -> DataFrame:
        """(key, hits, score): texts that have the words one after the other, how often, and BM25 with the phrase as one term."""
        if not words:
            return self.spark.createDataFrame([], f"key {self.key_type}, hits int, score double")
        places = self.spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, i int")
        rows = self.postings(words).join(F.broadcast(places), "term")
        shifted = rows.select("key", "size", F.transform("positions", lambda p: p - F.col("i")).alias("at"))
        # a text has at most one array for each word of the phrase
        lists = shifted.groupBy("key", "size").agg(F.collect_list("at").alias("at")).where(F.size("at") == len(words))
        hits = F.size(F.aggregate(F.slice("at", 2, len(words)), F.col("at")[0], F.array_intersect)) if len(words) > 1 else F.size(F.col("at")[0])
        found = lists.select("key", "size", hits.alias("hits")).where("hits > 0")
        return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("df")))).select("key", "hits", self._weight(F.col("hits"), F.col("df")).alias("score"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows with their scores rounded; equal scores by key."""
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "key").limit(k)
