"""Differences between tables: versions, regressions, orphans and exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, before, after) of keys whose value differs: added, removed or changed."""
    rows = old.select(key, F.col(value).alias("before"), F.lit(1).alias("o")).join(new.select(key, F.col(value).alias("after"), F.lit(1).alias("n")), key, "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return rows.select(key, change.alias("change"), "before", "after").where("change is not null")


def regressions(current: DataFrame, baseline: DataFrame, key: str, value: str, threshold: float, critical: float) -> DataFrame:
    """Metrics that fell by more than a share of their baseline; a missing value is 0, a baseline of 0 is skipped."""
    rows = current.select(key, F.col(value).alias("now")).join(baseline.select(key, F.col(value).alias("base")), key, "full").na.fill(0.0, ["now", "base"]).where("base <> 0")
    change = F.round((F.col("now") - F.col("base")) / F.abs("base"), 6)
    return rows.withColumn("change", change).where(F.col("change") < -threshold).select(key, "change", F.when(F.col("change") < -critical, "critical").otherwise("warning").alias("severity"))


def orphans(files: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows of files that the index lacks."""
    return files.join(index.select(key), key, "left_anti")


def exact_duplicates(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(digest, kept, copies, removed) of contents that occur more than once; the smallest key is kept. Only digests are shuffled."""
    digest = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content)), 256)
    return df.select(digest.alias("digest"), key).groupBy("digest").agg(F.min(key).alias("kept"), F.count("*").alias("copies")).where("copies > 1").withColumn("removed", F.col("copies") - 1)
