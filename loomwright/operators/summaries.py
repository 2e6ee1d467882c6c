"""Grouped summaries of metric, cost, review and audit records: totals, rates, windows, agreement, versions.

Every function is one or two grouped aggregations with partial sums before
the shuffle; nothing depends on the clock, moments are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(c: Column | str) -> Column:
    return F.round(c, 6)


def totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum, mean, least and most of a value by keys, and the sum's share of all. Null values aren't counted."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    every = df.agg(F.sum(value).alias("every"))
    return out.join(F.broadcast(every)).select(*keys, "n", *(rounded(c).alias(c) for c in ("sum", "mean", "least", "most")), rounded(F.col("sum") / F.nullif("every", F.lit(0))).alias("share"))


def rates(df: DataFrame, keys: list[Column], hit: Column) -> DataFrame:
    """Rows, hits and their quotient by keys; a null hit is none."""
    hits = F.count_if(F.coalesce(hit, F.lit(False)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), hits.alias("hits"), rounded(hits / F.count("*")).alias("rate"))


def within(df: DataFrame, ts: str, until: str, seconds: int) -> DataFrame:
    """Rows of the `seconds` up to and with a moment."""
    end = F.lit(until).cast(df.schema[ts].dataType)
    return df.where((F.col(ts) <= end) & (F.col(ts) > end - F.make_dt_interval(secs=F.lit(seconds))))


def throughput(df: DataFrame, keys: list[str], ts: str, value: str, until: str, seconds: int) -> DataFrame:
    """Rows, rows a second and mean value of a window."""
    return within(df, ts, until, seconds).groupBy(*keys).agg(F.count("*").alias("n"), rounded(F.count("*") / seconds).alias("per_second"), rounded(F.avg(value)).alias("mean"))


def degradation(df: DataFrame, keys: list[str], ts: str, value: str, until: str, recent: int, baseline: int, drop: float) -> DataFrame:
    """Means of the last `recent` seconds and of the `baseline` seconds before them; degraded if the first is lower by more than `drop`."""
    end = F.lit(until).cast(df.schema[ts].dataType)
    new = F.col(ts) > end - F.make_dt_interval(secs=F.lit(recent))
    rows = within(df, ts, until, recent + baseline).groupBy(*keys).agg(F.avg(F.when(new, F.col(value))).alias("a"), F.avg(F.when(~new, F.col(value))).alias("b"))
    return rows.where("a is not null and b is not null").select(*keys, rounded("a").alias("recent"), rounded("b").alias("baseline"), rounded(F.col("a") - F.col("b")).alias("change"), (F.col("b") - F.col("a") > drop).alias("degraded"))


def growth(df: DataFrame, keys: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """First and last value by time, then tie, and the change a second."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.struct(at.alias("at"), F.col(tie).alias("tie"), F.col(value).alias("v"))
    rows = df.groupBy(*keys).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return rows.select(*keys, F.col("a.v").alias("first"), F.col("b.v").alias("last"), rounded(F.coalesce((F.col("b.v") - F.col("a.v")) * 1e6 / F.nullif(F.col("b.at") - F.col("a.at"), F.lit(0)), F.lit(0.0))).alias("per_second"))


def latest_anomalies(df: DataFrame, key: str, order: list[str], value: str, limit: float) -> DataFrame:
    """Keys whose latest value is over `limit` population deviations from their mean."""
    rows = df.groupBy(key).agg(F.max(F.struct(*order, F.col(value).alias("v"))).alias("last"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = F.abs(F.col("last.v") - F.col("m")) / F.nullif("s", F.lit(0.0))
    return rows.where(z > limit).select(key, F.col("last.v").alias("latest"), rounded("m").alias("mean"), rounded(z).alias("z"))


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Rows of each (truth, said), both known."""
    return df.where(F.col(truth).isNotNull() & F.col(said).isNotNull()).groupBy(truth, said).agg(F.count("*").alias("n"))


def class_agreement(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Of the rows of each true class, the share that was said so."""
    return df.where(F.col(truth).isNotNull() & F.col(said).isNotNull()).groupBy(truth).agg(F.count("*").alias("n"), rounded(F.avg((F.col(truth) == F.col(said)).cast("int"))).alias("agreement"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows with both, share of equal ones, Pearson's correlation."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), rounded(F.avg((F.col(a) == F.col(b)).cast("int"))).alias("equal"), rounded(F.corr(a, b)).alias("pearson"))


def rollup_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and mean by keys, by each shorter list of them and over all; level says how many keys are summed up."""
    grouped = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(grouped.alias("level"), F.count(value).alias("n"), rounded(F.avg(value)).alias("mean"))


def pivot_counts(df: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Rows by key with a count column for each kind named."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col(kind) == k).alias(f"n_{k.lower()}") for k in kinds))


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by order, which tells all rows of a key apart."""
    rows = df.groupBy(key).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("row"), F.count("*").alias("versions"))
    return rows.select(key, "versions", *(F.col(f"row.{c}").alias(c) for c in columns))


def versions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows numbered from 1 within their key."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def upsert(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The table after an upsert: updates replace rows of their key and add those of new keys. Keys are unique in both; rows with a null key stay and are added as they are."""
    names = df.columns
    return df.join(updates.select(key), key, "left_anti").select(names).unionByName(updates.select(names))


def pareto_area(frontier: DataFrame, cost: str, quality: str) -> DataFrame:
    """Area under a frontier by trapezoids, in one row; a frontier has few points."""
    after = Window.orderBy(cost, quality)
    rows = frontier.select(cost, quality, F.lead(cost).over(after).alias("c2"), F.lead(quality).over(after).alias("q2"))
    return rows.agg(rounded(F.coalesce(F.sum((F.col("c2") - F.col(cost)) * (F.col("q2") + F.col(quality)) / 2), F.lit(0.0))).alias("area"))


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals as a share of their hull; 0 for an empty hull."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.nullif(F.greatest(a1, b1) - F.least(a0, b0), F.lit(0.0)), F.lit(0.0))
