"""Choosing samples, thresholds and temperatures for a model, routing to versions, and agreement of many raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators import measures


def uncertainty(confidence: Column, entropy: bool = True) -> Column:
    """Binary entropy in bits of a confidence held in [0.001, 0.999], or 1 - confidence; null counts as 0.5."""
    c = F.coalesce(confidence, F.lit(0.5))
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), c))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p)) if entropy else 1 - c


def expected_change(confidence: Column, text: Column) -> Column:
    """(1 - confidence) * ln(1 + words); a null confidence counts as 0.5, a null text has no words."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f]+"))
    return (1 - F.coalesce(confidence, F.lit(0.5))) * F.log1p(words)


def vote_entropy(df: DataFrame, key: str, vote: str) -> DataFrame:
    """Entropy in bits of the votes on each key; votes are counted before they are compared."""
    counts = df.groupBy(key, vote).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return counts.select(key, (-share * F.log2(share)).alias("h")).groupBy(key).agg(F.round(F.sum("h"), 6).alias("score"))


def best(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the highest score, ties by key."""
    return df.orderBy(F.desc("score"), key).limit(n)


def thresholds(df: DataFrame, confidence: Column, right: Column, low: float = 0.1, high: float = 0.95, steps: int = 50) -> DataFrame:
    """Accuracy, coverage and their product at each of `steps` thresholds of confidence; those that no row reaches give none.

    Rows are counted by the last threshold that they reach, so what is spread over thresholds is at most `steps` rows.
    """
    level = F.least(F.floor((confidence - low) / ((high - low) / (steps - 1)) + 1e-9), F.lit(steps - 1))
    reached = df.select(level.alias("level"), right.cast("long").alias("r")).groupBy("level").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    total = reached.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    each = total.where("level >= 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("level"))).alias("step"), "n", "r", "total")
    sums = each.groupBy("step").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.max("total").alias("total"))
    return sums.select(
        "step", F.round(low + F.col("step") * ((high - low) / (steps - 1)), 6).alias("threshold"), F.round(F.col("r") / F.col("n"), 6).alias("accuracy"),
        F.round(F.col("n") / F.col("total"), 6).alias("coverage"), F.round(F.col("r") / F.col("total"), 6).alias("expected_accuracy"))


def threshold_for(levels: DataFrame, accuracy: float = 0.0, fallback: float = 1.0) -> DataFrame:
    """Of the rows of thresholds(), the one with the best expected accuracy that is accurate enough and leaves at most a share `fallback` out; the best of all if none is.

    Ties: the lowest threshold. One row, with `met`; none if no threshold was reached.
    """
    met = (F.col("accuracy") >= accuracy) & (F.round(1 - F.col("coverage"), 6) <= fallback)
    return levels.withColumn("met", met).orderBy(F.desc("met"), F.desc("expected_accuracy"), "step").limit(1)


def merged_answers(df: DataFrame, item: str, answer: str, confidence: str, order: str, sure: float = 0.9, close: float = 0.2) -> DataFrame:
    """One answer for each item: the surest, with the next one beside it if neither is above `sure` and they are less than `close` apart.

    Ties go to the lower `order`; null confidences come last, and count as
    apart from all others. Only two rows of an item are kept in each
    partition before the shuffle, so large items don't meet in one task.
    """
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.desc_nulls_last(confidence), order, answer))
    two = df.select(item, answer, confidence, order).withColumn("_place", place).where("_place <= 2")
    at = lambda c, i: F.max(F.when(F.col("_place") == i, F.col(c)))
    rows = two.groupBy(item).agg(at(answer, 1).alias("_a"), at(answer, 2).alias("_b"), at(confidence, 1).alias("_c"), at(confidence, 2).alias("_d"))
    both = F.coalesce((F.col("_c") <= sure) & (F.col("_c") - F.col("_d") < close), F.lit(False))
    text = F.when(both, F.concat(F.coalesce("_a", F.lit("")), F.lit("\n\n[Additional perspective]: "), F.coalesce("_b", F.lit("")))).otherwise(F.col("_a"))
    return rows.select(item, both.alias("merged"), F.col("_c").alias("confidence"), text.alias("answer"))


def scaled(confidence: Column, temperature: Column) -> Column:
    """The confidence, held in [0.01, 0.99], with its logit divided by the temperature."""
    c = F.greatest(F.lit(0.01), F.least(F.lit(0.99), confidence))
    return 1 / (1 + F.exp(-F.ln(c / (1 - c)) / temperature))


def temperatures(df: DataFrame, confidence: Column, right: Column, low: float = 0.5, high: float = 2.0, steps: int = 50, bins: int = 10) -> DataFrame:
    """Expected calibration error at each temperature. Equal confidences are counted before temperatures spread them."""
    rows = df.select(confidence.alias("c"), right.cast("long").alias("r")).where("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    put = each.withColumn("s", scaled(F.col("c"), low + F.col("step") * ((high - low) / (steps - 1))))
    cells = put.groupBy("step", F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("bin")).agg(F.sum("n").alias("n"), F.abs(F.sum(F.col("s") * F.col("n")) - F.sum("r")).alias("gap"))
    return cells.groupBy("step").agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece")).withColumn("temperature", F.round(low + F.col("step") * ((high - low) / (steps - 1)), 6))


def route(request: Column, weights: dict[str, float]) -> Column:
    """The version that a request goes to, by its md5 and the weights in order; the last one takes what is left."""
    at, upto, out = measures.hash_bucket(request) / 1000, 0.0, None
    for version, weight in weights.items():
        upto = round(upto + weight, 9)
        out = F.when(at <= upto, version) if out is None else out.when(at <= upto, version)
    return out.otherwise(list(weights)[-1])


def meteor(df: DataFrame, key: str, reference: str, hypothesis: str, alpha: float = 0.9) -> DataFrame:
    """Precision and recall of distinct tokens, combined with weight alpha and a penalty for the share that has no match."""
    rows = df.select(key, F.array_distinct(measures.tokens(F.col(reference))).alias("r"), F.array_distinct(measures.tokens(F.col(hypothesis))).alias("h"))
    m, nr, nh = F.size(F.array_intersect("r", "h")), F.size("r"), F.size("h")
    p, r = m / nh, m / nr
    score = p * r / (alpha * p + (1 - alpha) * r) * (1 - 0.5 * (1 - m / F.greatest(nr, nh)))
    return rows.select(key, F.round(F.when(m == 0, 0.0).otherwise(score), 6).alias("meteor"))


def fleiss_kappa(df: DataFrame, item: str, category: str, raters: int) -> DataFrame:
    """Fleiss' kappa, clipped to [-1, 1], in one row; 0 where chance agreement is 1. Items with another number of ratings are left out."""
    cells = df.where(F.col(category).isNotNull()).groupBy(item, F.col(category).alias("c")).agg(F.count("*").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where(F.col("t") == raters)
    shares = cells.join(items.select(item), item, "left_semi").groupBy("c").agg(F.sum("n").alias("n"))
    agreed = items.agg(F.count("*").alias("items"), F.sum("same").alias("same"))
    chance = shares.agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    one = agreed.unionByName(chance, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("items", "same", "squares")))
    p, pe = F.col("same") / (F.col("items") * raters * (raters - 1)), F.col("squares") / F.pow(F.col("items") * F.lit(raters), F.lit(2))
    return one.select(F.round(F.when(pe >= 1, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p - pe) / (1 - pe)))), 6).alias("kappa"))
