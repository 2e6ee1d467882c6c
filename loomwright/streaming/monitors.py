"""Streaming monitors over event tables: windowed metrics, rates, sessions, alerts and an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed(events: DataFrame, ts: str, group: list[str], value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """n, mean, min and max of each group and window; state is dropped once the watermark has passed a window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        events.withWatermark(ts, late)
        .groupBy(window.alias("w"), *group)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group, "n", "mean", "low", "high")
    )


def error_rate(events: DataFrame, ts: str, group: list[str], kind: str, bad: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Share of rows of the bad kind by window."""
    hits = F.avg((F.col(kind) == bad).cast("double")).alias("rate")
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *group).agg(F.count("*").alias("n"), hits).select(F.col("w.start").alias("start"), *group, "n", "rate")


def session_counts(events: DataFrame, ts: str, user: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user, closed by a gap without rows."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


def deduplicated(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, as far as the watermark reaches back; in a batch, once."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def alerts(metrics: DataFrame, value: str, warn: float, critical: float) -> DataFrame:
    """Rows at or beyond a threshold, with their severity."""
    return metrics.where(F.col(value) >= warn).withColumn("severity", F.when(F.col(value) >= critical, "critical").otherwise("warning"))


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there and stops. Each batch overwrites its own folder, so a batch that is run again leaves no second copy."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
