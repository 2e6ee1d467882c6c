"""Paths, forces, contacts and poses of things that move: rows of a key in order of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import rotations


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two points; null if a coordinate is."""
    return F.sqrt(reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]))


def path_length(df: DataFrame, key: str, order: list[str], coords: list[str]) -> DataFrame:
    """Sum of the distances of neighbouring points and the direct way from first to last; null coordinates are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.dropna(subset=coords)
    steps = rows.withColumn("_step", distance([F.col(c) for c in coords], [F.lag(c).over(w) for c in coords]))
    ends = [f(F.struct(*coords), F.struct(*order)) for f in (F.min_by, F.max_by)]
    out = steps.groupBy(key).agg(F.count("*").alias("points"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), *(e.alias(n) for e, n in zip(ends, ("_a", "_b"), strict=True)))
    direct = distance([F.col(f"_a.{c}") for c in coords], [F.col(f"_b.{c}") for c in coords])
    return out.select(key, "points", F.round("length", 4).alias("length"), F.round(direct, 4).alias("direct"))


def points_at(df: DataFrame, key: str, at: str, tie: str, value: str, times: list[float]) -> DataFrame:
    """The value at each of the times, by a line between the points around it; before the first and after the last point, theirs.

    One aggregation without a sort: only the points beside each time are kept.
    """
    rows = df.dropna(subset=[at, value])
    point = F.struct(at, tie, value)
    aggs = [f(F.when(cond, point)).alias(f"_{n}{i}") for i, x in enumerate(times) for n, f, cond in (("a", F.max, F.col(at) <= x), ("b", F.min, F.col(at) > x))]
    near = rows.groupBy(key).agg(*aggs)
    one = lambda i, x: F.struct(F.lit(float(x)).alias("at"), F.col(f"_a{i}").alias("a"), F.col(f"_b{i}").alias("b"))
    each = near.select(key, F.explode(F.array(*(one(i, x) for i, x in enumerate(times)))).alias("p")).select(key, "p.*")
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    share = (F.col("at") - F.col(f"a.{at}")) / (F.col(f"b.{at}") - F.col(f"a.{at}"))
    return each.select(key, "at", F.round(F.coalesce(a + (b - a) * share, a, b), 6).alias("value"))


def poses_at(df: DataFrame, key: str, at: str, tie: str, coords: list[str], orientation: str, times: list[float]) -> DataFrame:
    """Coordinates (by a line) and orientation (by the shortest rotation) at each of the times, between the rows around it; outside, the nearest row's.

    Orientations are quaternions (x, y, z, w), made unit; null ones are no
    rotation. Rows without a time or a coordinate are left out. As in
    points_at, one aggregation keeps the rows beside each time only.
    """
    rows = df.dropna(subset=[at, *coords])
    pose = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.array(*(F.col(c).cast("double") for c in coords)).alias("p"), rotations.unit(F.col(orientation)).alias("q"))
    aggs = [f(F.when(cond, pose)).alias(f"_{n}{i}") for i, x in enumerate(times) for n, f, cond in (("a", F.max, F.col(at) <= x), ("b", F.min, F.col(at) > x))]
    near = rows.groupBy(F.col(key).alias("_key")).agg(*aggs)
    one = [F.struct(F.lit(float(x)).alias("at"), F.col(f"_a{i}").alias("a"), F.col(f"_b{i}").alias("b")) for i, x in enumerate(times)]
    each = near.select("_key", F.explode(F.array(*one)).alias("p")).select("_key", "p.*")
    share = (F.col("at") - F.col("a.at")) / (F.col("b.at") - F.col("a.at"))
    place = F.coalesce(F.zip_with("a.p", "b.p", lambda x, y: x + (y - x) * share), F.col("a.p"), F.col("b.p"))
    turned = F.when(share.isNotNull(), rotations.between(F.col("a.q"), F.col("b.q"), share)).otherwise(F.coalesce("a.q", "b.q"))
    return each.select(F.col("_key").alias(key), "at", place.alias("position"), turned.alias("orientation"))


def displacement(df: DataFrame, key: str, order: list[str], real: list[str], said: list[str]) -> DataFrame:
    """Average and final distance of foretold from real points, their squared errors' mean and its root; rows without either are left out."""
    rows = df.dropna(subset=real + said)
    gap = distance([F.col(c) for c in real], [F.col(c) for c in said])
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(gap).alias("ade"), F.max_by(gap, F.struct(*order)).alias("fde"), F.avg(gap * gap).alias("mse"))
    return out.select(key, "n", *(F.round(c, 4).alias(c) for c in ("ade", "fde", "mse")), F.round(F.sqrt("mse"), 4).alias("rmse"))


def forces(df: DataFrame, key: str, parts: list[str], seconds: str) -> DataFrame:
    """Impulse (force times time, summed as vectors), largest force and time in contact; null times count as no contact."""
    size = F.sqrt(reduce(lambda x, y: x + y, [F.col(c) * F.col(c) for c in parts]))
    sums = [F.round(F.coalesce(F.sum(F.col(c) * F.col(seconds)), F.lit(0.0)), 7).alias(f"impulse_{i}") for i, c in enumerate(parts)]
    return df.groupBy(key).agg(*sums, F.round(F.max(size), 6).alias("peak"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 7).alias("contact"))


def contact_scores(truth: DataFrame, said: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """Precision, recall and F1 of events: one counts as hit if the other side has one of its keys within the tolerance, which is above 0.

    Times meet in bins of the tolerance's width, each row of the other
    side in its own bin and both neighbours, reduced to the first and
    last time of a bin, so hot bins cost a row each.
    """
    where = F.floor(F.col(at) / tolerance)

    def hits(rows: DataFrame, other: DataFrame) -> DataFrame:
        edges = other.groupBy(*keys, where.alias("_bin")).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
        own = rows.withColumn("_bin", where)
        for name, step in (("_before", 1), ("_same", 0), ("_after", -1)):
            side = edges.select(*keys, (F.col("_bin") + step).alias("_bin"), F.struct("_low", "_high").alias(name))
            own = own.join(side, [*keys, "_bin"], "left")
        near = F.col("_same").isNotNull() | (F.col(at) - F.col("_before._high") <= tolerance) | (F.col("_after._low") - F.col(at) <= tolerance)
        return own.agg(F.count("*").alias("n"), F.count_if(F.coalesce(near, F.lit(False))).alias("hit"))

    a = hits(said, truth).select(F.col("n").alias("said"), F.col("hit").alias("right"))
    b = hits(truth, said).select(F.col("n").alias("real"), F.col("hit").alias("found"))
    both = a.join(b)  # one row each
    p, r = F.coalesce(F.try_divide("right", "said"), F.lit(0.0)), F.coalesce(F.try_divide("found", "real"), F.lit(0.0))
    return both.select("said", "right", "real", "found", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def boundaries(df: DataFrame, key: str, order: list[str], value: str, most: int) -> DataFrame:
    """Local maxima of a moving average over three rows, the `most` highest of each key (ties: the earlier)."""
    w = Window.partitionBy(key).orderBy(*order)
    smooth = df.withColumn("_s", F.round(F.avg(value).over(w.rowsBetween(-1, 1)), 6))
    peak = (F.col("_s") > F.lag("_s").over(w)) & (F.col("_s") > F.lead("_s").over(w))
    peaks = smooth.withColumn("_peak", peak).where("_peak")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s"), *order))
    return peaks.withColumn("place", place).where(F.col("place") <= most).withColumnRenamed("_s", "smooth").drop("_peak")
