"""Readers and writers of annotation stores: JSON lines, CSV, Parquet, partitioned stores, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An annotation with its segments, actions, objects and question pairs, as a DDL schema.
ANNOTATION = """id string, video_id string, source string, model_version string, quality_score double, created_at string,
tags array<string>, segments array<struct<start_time: double, end_time: double, caption: string,
actions: array<struct<verb: string, noun: string, hand: string, confidence: double>>,
objects: array<struct<name: string, confidence: double>>,
qa_pairs: array<struct<question: string, answer: string, question_type: string>>>>,
metadata struct<fps: double, duration: double, total_frames: long>"""


def read_json(spark: SparkSession, path: str, schema: str = ANNOTATION, pretty: bool = False) -> DataFrame:
    """JSON lines, or a document for each file if pretty, below path at any depth; documents that don't parse are dropped."""
    return spark.read.schema(schema).options(recursiveFileLookup=True, mode="DROPMALFORMED", multiLine=pretty).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, mode="PERMISSIVE").csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files; unreadable ones are skipped."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def find(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the predicate reaches the scan."""
    return df.where(F.col(key) == value)


def duration(segments: Column) -> Column:
    return F.aggregate(F.coalesce(segments, F.array().cast("array<struct<start_time: double, end_time: double>>")), F.lit(0.0), lambda a, s: a + s["end_time"] - s["start_time"])


def flatten(df: DataFrame) -> DataFrame:
    """The index row of each annotation: flat columns, number and length of its segments, and the whole document as JSON."""
    return df.select(
        "id", "video_id", F.coalesce("source", F.lit("model")).alias("source"), F.coalesce("model_version", F.lit("unknown")).alias("model_version"), "quality_score", "created_at",
        F.coalesce(F.size("segments"), F.lit(0)).alias("num_segments"), F.round(duration(F.transform("segments", lambda s: F.struct(s["start_time"].alias("start_time"), s["end_time"].alias("end_time")))), 6).alias("total_duration"),
        F.to_json("tags").alias("tags"), F.to_json(F.struct(*df.columns)).alias("json_data"))


def verbs(df: DataFrame) -> DataFrame:
    """Verbs of all actions with their counts."""
    return df.select(F.explode(F.flatten(F.transform("segments", lambda s: F.coalesce(F.transform(s["actions"], lambda a: a["verb"]), F.array().cast("array<string>"))))).alias("verb")).groupBy("verb").agg(F.count("*").alias("n"))


def write_store(df: DataFrame, path: str, partition: list[str], mode: str = "append") -> None:
    """The rows in a folder per partition value; a null or empty value of a string column goes to `unknown`."""
    texts = [c for c in partition if dict(df.dtypes)[c] == "string"]
    df = df.withColumns({c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c)) for c in texts})
    df.write.mode(mode).partitionBy(*partition).option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str, record: Column | None = None) -> None:
    """A JSON document for each row: the whole row, or the given record."""
    df.select(F.to_json(F.struct(*df.columns) if record is None else record).alias("value")).write.mode("errorifexists").text(path)


def compact(spark: SparkSession, path: str, to: str, partition: list[str], files: int = 1) -> None:
    """The store rewritten with at most `files` files a partition, into a new folder; the old one stays until the caller drops it."""
    salt = F.pmod(F.xxhash64(*spark.read.parquet(path).columns), F.lit(files)) if files > 1 else F.lit(0)
    rows = spark.read.parquet(path).withColumn("__salt", salt)
    rows.repartition(*partition, "__salt").drop("__salt").write.mode("errorifexists").partitionBy(*partition).option("compression", "zstd").parquet(to)


def llava(df: DataFrame) -> DataFrame:
    """A record for each annotation: id, video and a human and a gpt turn for each segment."""
    names = lambda s: F.array_join(F.slice(F.transform(F.coalesce(s["objects"], F.array().cast("array<struct<name: string, confidence: double>>")), lambda o: o["name"]), 1, 5), ", ")
    turns = F.flatten(F.transform("segments", lambda s, i: F.array(
        F.struct(F.lit("human").alias("from"), F.concat(F.lit("Describe segment "), (i + 1).cast("string"), F.lit(". Objects: "), names(s)).alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.coalesce(s["caption"], F.lit("")).alias("value")))))
    return df.select("id", F.col("video_id").alias("video"), turns.alias("conversations"))


def episodes(df: DataFrame) -> DataFrame:
    """A row for each segment as a step: its place, first and last flags, discount, and the next segment's caption."""
    n = F.size("segments")
    steps = F.transform("segments", lambda s, i: F.struct(
        i.alias("step"), s["caption"].alias("observation"), F.try_element_at(F.col("segments"), i + 2)["caption"].alias("next_observation"),
        (i == 0).alias("is_first"), (i == n - 1).alias("is_last"), F.when(i == n - 1, 0.0).otherwise(1.0).alias("discount")))
    return df.select("id", F.inline(steps))
