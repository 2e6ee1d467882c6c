"""Time and order: trends, running rates, percentiles, islands, sessions, as-of and interval relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def nearest_rank(df: DataFrame, group: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """sorted[floor(n * p)] of each group, the last value beyond. Equal values are counted before they are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    ranked = running(counts, group, value, ["n"])
    at = {name: F.least(F.floor(F.col("all_n") * p), F.col("all_n") - 1) for name, p in points.items()}
    return ranked.groupBy(*group).agg(F.max("all_n").alias("n"), *(F.min(F.when(F.col("upto_n") > i, F.col(value))).alias(name) for name, i in at.items()))


def trend(df: DataFrame, group: str, ts: str, value: str, width: int) -> DataFrame:
    """Buckets of `width` seconds counted from each group's first row: n, mean, min, max and the upper median."""
    start = df.groupBy(group).agg(F.min(ts).alias("start"))
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / (width * 1_000_000))
    rows = df.join(start, group).withColumn("bucket", at)
    plain = rows.groupBy(group, "bucket").agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return plain.join(nearest_rank(rows, [group, "bucket"], value, {"p50": 0.5}), [group, "bucket"])


def running_rate(df: DataFrame, group: str, order: list[str], hit: Column) -> DataFrame:
    """Share of hits among a group's rows so far."""
    by = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("rate", F.round(F.avg(hit.cast("double")).over(by), 6))


def last_slope(df: DataFrame, group: str, order: list[str], value: str, k: int) -> DataFrame:
    """Least-squares slope of each group's last k values against 0, 1, ..., and its direction at +-0.001."""
    last = df.withColumn("back", F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(c) for c in order)))).where(F.col("back") <= k)
    slope = last.groupBy(group).agg(F.count("*").alias("n"), F.round(F.regr_slope(value, -F.col("back")), 6).alias("slope"))
    return slope.withColumn("direction", F.when(F.col("slope") > 0.001, "improving").when(F.col("slope") < -0.001, "declining").otherwise("stable"))


def half_trend(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Means of the first n // 2 values and of the rest; a difference beyond 0.05 is a trend, from 3 values on."""
    by = Window.partitionBy(group)
    rows = df.withColumn("i", F.row_number().over(by.orderBy(*order))).withColumn("n", F.count("*").over(by))
    early = F.col("i") <= F.floor(F.col("n") / 2)
    out = rows.groupBy(group).agg(F.max("n").alias("n"), F.round(F.avg(F.when(early, F.col(value))), 6).alias("first_mean"), F.round(F.avg(F.when(~early, F.col(value))), 6).alias("second_mean"))
    gap = F.col("second_mean") - F.col("first_mean")
    return out.withColumn("direction", F.when(F.col("n") < 3, "stable").when(gap > 0.05, "improving").when(gap < -0.05, "declining").otherwise("stable"))


def islands(df: DataFrame, group: str, start: str, end: str, key: str) -> DataFrame:
    """A number for each set of overlapping intervals; one that starts at or after all ends so far opens a new set."""
    by = Window.partitionBy(group).orderBy(start, key)
    upto = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("new", (upto.isNull() | (F.col(start) >= upto)).cast("int")).withColumn("island", F.sum("new").over(by)).drop("new")


def sessions(df: DataFrame, group: str, at: str, key: str, gap: float) -> DataFrame:
    """Sessions of rows no more than `gap` apart, those of one row left out."""
    by = Window.partitionBy(group).orderBy(at, key)
    rows = df.withColumn("new", F.coalesce((F.col(at) - F.lag(at).over(by) > gap).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(by))
    return rows.groupBy(group, "session").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, default: str) -> DataFrame:
    """left with the value of the last right row at or before its time; one sort of both sides, no range join."""
    marks = right.select(by, at, F.col(value).alias("seen"), F.lit(0).alias("kind"))
    rows = left.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "kind", "seen").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", F.coalesce(F.last("seen", True).over(w), F.lit(default))).where("kind = 1").drop("kind", "seen")


def relations(df: DataFrame, group: list[str], key: str, start: str, end: str) -> DataFrame:
    """EQUALS, MEETS, OVERLAPS or BEFORE for pairs of a group's intervals in key order; other pairs give no row."""
    a, b = df.alias("a"), df.alias("b")
    on = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [F.col(f"a.{key}") < F.col(f"b.{key}")]
    s1, e1, s2, e2 = (F.col(x) for x in (f"a.{start}", f"a.{end}", f"b.{start}", f"b.{end}"))
    kind = F.when((s1 == s2) & (e1 == e2), "EQUALS").when(e1 == s2, "MEETS").when((s1 < s2) & (s2 < e1), "OVERLAPS").when(e1 < s2, "BEFORE")
    return a.join(b, on).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), kind.alias("relation")).where("relation is not null")


def transitions(df: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    """Counts and probabilities of a group's consecutive states."""
    by = Window.partitionBy(group).orderBy(*order)
    pairs = df.withColumn("before", F.lag(state).over(by)).where("before is not null").groupBy("before", F.col(state).alias("after")).agg(F.count("*").alias("n"))
    return pairs.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("before")), 6))


def pareto(df: DataFrame, group: str, cost: str, quality: str, key: str) -> DataFrame:
    """Rows whose quality is above that of every cheaper row of the group."""
    by = Window.partitionBy(group).orderBy(cost, F.desc(quality), key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("best", F.max(quality).over(by)).where(F.col("best").isNull() | (F.col(quality) > F.col("best"))).drop("best")
