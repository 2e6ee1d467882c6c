"""Reports on scores, drift, rollouts and costs, one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators import measures


def drift(df: DataFrame, group: str, value: str, is_current: Column, least: int = 30, psi_limit: float = 0.25) -> DataFrame:
    """Both samples' sizes, means and deviations, KS distance and PSI, and whether either shows drift.

    KS shows drift above its asymptotic 5 % level, 1.3581 * sqrt((n + m) / (n m));
    a current sample below `least` rows shows none.
    """
    side = {"reference": ~is_current, "current": is_current}
    aggs = [f(F.when(c, F.col(value))).alias(f"{kind}_{name}") for name, c in side.items() for f, kind in ((F.count, "n"), (F.avg, "mean"), (F.stddev_pop, "sd"))]
    rows = df.where(F.col(value).isNotNull())
    facts = rows.groupBy(group).agg(*aggs)
    both = facts.join(measures.ks(rows, group, value, is_current), group, "left").join(measures.psi(measures.binned(rows, group, value, is_current, joint=False), group), group, "left")
    n, m = F.col("n_reference"), F.col("n_current")
    enough = (m >= least) & (n > 0)
    limit = 1.3581 * F.sqrt((n + m) / (n * m))
    out = both.withColumn("ks_drift", F.coalesce(enough & (F.col("ks") > limit), F.lit(False))).withColumn("psi_drift", F.coalesce(enough & (F.col("psi") > psi_limit), F.lit(False)))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_reference", "sd_reference", "mean_current", "sd_current")})


def last_window(df: DataFrame, key: str, order: list[str], value: str, k: int, passing: float) -> DataFrame:
    """Mean, least, most and share of passing values over the last k rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    rows = df.where(F.col(value).isNotNull()).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.count_if(F.col(value) >= passing) / F.count("*"), 6).alias("pass_rate"))


def thinned(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each key: where there are more, every (n div most)-th from the first on."""
    part = Window.partitionBy(key)
    rows = df.withColumn("_place", F.row_number().over(part.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(part))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return rows.where((F.col("_place") % step == 0) & (F.floor(F.col("_place") / step) < most)).withColumn("point", F.floor(F.col("_place") / step).cast("int")).drop("_place", "_n")


def _mean(value: str) -> Column:
    """The mean by sums that no order of the rows changes: whole parts and twice 31 bits of the fraction, as integers.

    So neither a threshold nor a tie is decided by what was added first.
    Where a group has a value of 2^31 or more or no number, its plain mean.
    """
    v, unit = F.col(value).cast("double"), float(1 << 31)
    fine = F.abs(v) < unit
    whole = F.floor(v)
    high = F.floor((v - whole) * unit)
    low = F.floor(((v - whole) * unit - high) * unit)
    total = lambda part: F.sum(F.when(fine, part)).cast("decimal(38,20)")
    size = F.lit(1 << 31)
    return F.when(F.count_if(~fine) > 0, F.avg(v)).otherwise(((total(whole) + (total(high) + total(low) / size) / size) / F.count(v)).cast("double"))


def rollback(df: DataFrame, key: str, quality: str, failed: Column, latency: str, least: int, min_quality: float, max_failures: float, max_latency: float) -> DataFrame:
    """The first threshold that a version with enough requests breaks: quality, errors, latency; null for none. Six decimals, rounded in binary as the SQL does."""
    rows = df.groupBy(key).agg(F.count("*").alias("n"), _mean(quality).alias("quality"), (F.count_if(failed) / F.count("*")).alias("failures"), _mean(latency).alias("latency"))
    why = F.when(F.col("n") < least, None).when(F.col("quality") < min_quality, "quality").when(F.col("failures") > max_failures, "errors").when(F.col("latency") > max_latency, "latency")
    return rows.select(key, "n", *((F.round(F.col(c) * 1e6, 0) / 1e6).alias(c) for c in ("quality", "failures", "latency")), why.alias("reason"))


def best_and_worst(df: DataFrame, keys: list[str], value: str, row: str) -> DataFrame:
    """Mean of a value and the rows with its largest and smallest (ties: the smallest row)."""
    rows = df.where(F.col(value).isNotNull())
    best, worst = F.min_by(row, F.struct(-F.col(value), F.col(row))), F.min_by(row, F.struct(value, row))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), best.alias("best"), worst.alias("worst"))


def savings(df: DataFrame, key: str, old: Column, new: Column) -> DataFrame:
    """Mean cost of both, what a sample saves, in percent too, and for a thousand samples."""
    rows = df.groupBy(key).agg(F.avg(old).alias("a"), F.avg(new).alias("b"))
    gap = F.col("a") - F.col("b")
    return rows.select(key, F.round("a", 4).alias("old"), F.round("b", 4).alias("new"), F.round(gap, 4).alias("saved"), F.round(F.try_divide(100 * gap, F.col("a")), 4).alias("percent"), F.round(gap * 1000, 1).alias("per_thousand"))


def state_sequence(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(key, place, state): the states in order behind an `initial` one at place 0."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = df.select(key).distinct().select(key, F.lit(0).alias("place"), F.lit("initial").alias("state"))
    return first.unionByName(df.select(key, place.alias("place"), F.col(state).alias("state")))


def exposition(df: DataFrame, name: str, label: str, value: str, bounds: list[float]) -> DataFrame:
    """A histogram's lines in the text format of metrics: (label, place, line), counts per bound, all, and the sum."""
    rows = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(*(F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)), F.count("*").alias("_n"))
    tag = lambda more: F.concat(F.lit(f'{name}_bucket{{{label}="'), F.col(label), F.lit(f'",le="{more}"}} '))
    lines = [F.concat(tag(b), F.col(f"_{i}").cast("string")) for i, b in enumerate(bounds)] + [F.concat(tag("+Inf"), F.col("_n").cast("string"))]
    lines.append(F.concat(F.lit(f'{name}_count{{{label}="'), F.col(label), F.lit('"} '), F.col("_n").cast("string")))
    return counts.select(label, F.posexplode(F.array(*lines)).alias("place", "line"))
