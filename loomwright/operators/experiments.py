"""Comparisons of two samples with p-values: A/B tests and drift of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import tails
from loomwright.operators.ranges import running


def ab_test(df: DataFrame, group: list[str], in_b: Column, value: str, share: float = 0.95, least: int = 2) -> DataFrame:
    """Student's t-test of two variants for each group of rows.

    n, mean and population deviation of both; t (with pooled variance) and
    its two-sided p; effect, the difference of means over the root of the
    mean of both variances; an interval of the difference that holds
    `share`; winner: the variant with the greater mean if p < 1 - share.
    Nulls are left out; groups with fewer than `least` rows of a variant
    have no test. Sums are made in one pass, so a group of any size is
    combined before it is shuffled.
    """
    side = F.when(in_b, "b").otherwise("a")
    one = lambda f, s: f(F.when(side == s, F.col(value)))
    sums = df.where(F.col(value).isNotNull()).groupBy(*group).agg(*[c.alias(f"{n}_{s}") for s in "ab" for n, c in (("n", one(F.count, s)), ("mean", one(F.avg, s)), ("std", one(F.stddev_pop, s)))])
    n_a, n_b, v_a, v_b = F.col("n_a"), F.col("n_b"), F.col("std_a") ** 2, F.col("std_b") ** 2
    gap, freedom = F.col("mean_b") - F.col("mean_a"), n_a + n_b - 2
    pooled = (n_a * v_a + n_b * v_b) / F.nullif(freedom, F.lit(0))
    even = F.sqrt((v_a + v_b) / 2)
    error = F.sqrt(1 / n_a + 1 / n_b)
    rows = sums.where((n_a >= least) & (n_b >= least)).withColumns({"t": -gap / F.nullif(F.sqrt(pooled) * error, F.lit(0.0)), "effect": gap / (even + 1e-10), "freedom": freedom, "half": even * error})
    rows = rows.withColumns({"p": tails.t_p_value(F.col("t"), F.col("freedom")), "bound": tails.t_bound(F.lit(share), F.col("freedom"))})
    winner = F.when(F.col("p") < 1 - share, F.when(F.col("effect") > 0, "b").otherwise("a"))
    width = F.col("bound") * F.col("half")
    return rows.select(*group, *[f"{n}_{s}" for s in "ab" for n in ("n", "mean", "std")], "t", "p", "effect", (gap - width).alias("low"), (gap + width).alias("high"), winner.alias("winner"))


def ks_drift(df: DataFrame, group: list[str], value: str, is_current: Column, level: float = 0.05, least: int = 30) -> DataFrame:
    """Kolmogorov-Smirnov test of current against reference values for each group.

    n, mean and population deviation of both, the largest difference of
    their distribution functions, its asymptotic p and whether p < level.
    Groups with fewer than `least` current values, or none of reference,
    are left out; so are nulls. Equal values are counted before they are
    ordered, and running sums are dealt over cells of a group's range.
    """
    old, new = (~is_current).cast("int"), is_current.cast("int")
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*group, value).agg(F.sum(old).alias("a"), F.sum(new).alias("b"))
    gap = F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))
    far = running(counts, group, value, ["a", "b"]).select(*group, gap.alias("gap")).groupBy(*group).agg(F.max("gap").alias("ks"))
    one = lambda f, c: f(F.when(c, F.col(value)))
    facts = rows.groupBy(*group).agg(*[c.alias(n) for s, w in (("reference", ~is_current), ("current", is_current)) for n, c in ((f"n_{s}", one(F.count, w)), (f"mean_{s}", one(F.avg, w)), (f"std_{s}", one(F.stddev_pop, w)))])
    facts = facts.where((F.col("n_current") >= least) & (F.col("n_reference") > 0))
    p = tails.ks_p_value(F.col("ks"), F.col("n_reference"), F.col("n_current"))
    tested = far.join(facts, group).withColumn("p", p)
    return tested.select(*group, "n_reference", "n_current", "mean_reference", "mean_current", "std_reference", "std_current", "ks", "p", (F.col("p") < level).alias("drift"))
