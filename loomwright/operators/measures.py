"""Statistics: drift, agreement, calibration, outliers, experiments, entropy and token metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def binned(df: DataFrame, group: str, value: str, is_current: Column, joint: bool, bins: int = 10) -> DataFrame:
    """Shares p (reference) and q (current) of equal-width bins over the reference's or the joint range, a row per group and bin."""
    rows = df.select(group, F.col(value).alias("v"), is_current.alias("now")).where("v is not null")
    inside = F.lit(True) if joint else ~F.col("now")
    span = rows.groupBy(group).agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.sum((~F.col("now")).cast("int")).alias("n0"), F.sum(F.col("now").cast("int")).alias("n1"))
    at = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    counted = rows.join(span, group).where("high > low and v between low and high").groupBy(group, at.alias("bin")).agg(
        (F.sum((~F.col("now")).cast("int")) / F.max("n0")).alias("p"), (F.sum(F.col("now").cast("int")) / F.max("n1")).alias("q"))
    frame = span.where("high > low").select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return frame.join(counted, [group, "bin"], "left").na.fill(0.0, ["p", "q"])


def psi(bins: DataFrame, group: str, eps: float = 1e-10) -> DataFrame:
    p, q = F.greatest("p", F.lit(eps)), F.greatest("q", F.lit(eps))
    return bins.groupBy(group).agg(F.round(F.sum((q - p) * F.ln(q / p)), 6).alias("psi"))


def hellinger(bins: DataFrame, group: str) -> DataFrame:
    return bins.groupBy(group).agg(F.round(F.sqrt(F.sum(F.pow(F.sqrt("p") - F.sqrt("q"), 2)) / 2), 6).alias("hellinger"))


def ks(df: DataFrame, group: str, value: str, is_current: Column) -> DataFrame:
    """Largest distance of the two distribution functions; equal values are counted before they are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum((~is_current).cast("int")).alias("a"), F.sum(is_current.cast("int")).alias("b"))
    gap = F.abs(F.col("upto_a") / F.col("all_a") - F.col("upto_b") / F.col("all_b"))
    return running(counts, [group], value, ["a", "b"]).select(group, gap.alias("gap")).groupBy(group).agg(F.round(F.max("gap"), 6).alias("ks"))


def cohen_kappa(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, clipped to [-1, 1]; 0 where chance agreement is 1."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.groupBy(group).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one = cells.groupBy(group, F.col("a").alias("k")).agg(F.sum("n").alias("x"))
    two = cells.groupBy(group, F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    chance = one.join(two, [group, "k"]).groupBy(group).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("t"), F.coalesce(F.col("xy"), F.lit(0)) / F.col("t") / F.col("t")
    return total.join(chance, group, "left").select(group, F.round(F.when(pe >= 1, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (po - pe) / (1 - pe)))), 6).alias("kappa"))


def spearman(df: DataFrame, group: str, a: str, b: str, key: str) -> DataFrame:
    """Correlation of the ranks within a group; ties are ranked by key, not averaged."""
    by = Window.partitionBy(group)
    ranked = df.select(group, F.row_number().over(by.orderBy(a, key)).alias("ra"), F.row_number().over(by.orderBy(b, key)).alias("rb"))
    return ranked.groupBy(group).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def calibration_error(df: DataFrame, group: str, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of confidence."""
    rows = df.select(group, confidence.alias("c"), right.cast("double").alias("r"))
    cells = rows.groupBy(group, F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("c") - F.avg("r")).alias("gap"))
    return cells.groupBy(group).agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def calibration_report(df: DataFrame, group: str, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """Expected and largest calibration error over equal bins, log loss (confidence held off 0 and 1 by 1e-10) and Brier score; null confidences are left out."""
    rows = df.select(group, confidence.alias("c"), right.cast("double").alias("r")).where("c is not null and r is not null")
    c = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), F.col("c")))
    loss, square = -(F.col("r") * F.ln(c) + (1 - F.col("r")) * F.ln(1 - c)), (F.col("c") - F.col("r")) * (F.col("c") - F.col("r"))
    cells = rows.groupBy(group, F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("c") - F.avg("r")).alias("gap"), F.sum(loss).alias("loss"), F.sum(square).alias("square"))
    mean = lambda x: F.round(F.sum(x) / F.sum("n"), 6)
    return cells.groupBy(group).agg(F.sum("n").alias("rows"), mean(F.col("n") * F.col("gap")).alias("ece"), F.round(F.max("gap"), 6).alias("mce"), mean("loss").alias("nll"), mean("square").alias("brier"))


def reliability(df: DataFrame, group: str, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """Rows, mean confidence and accuracy of each group's bins; an empty bin has its middle and 0."""
    rows = df.select(group, confidence.alias("c"), right.cast("double").alias("r")).where("c is not null and r is not null")
    cells = rows.groupBy(group, F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("r").alias("r"))
    every = cells.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "c", "r")))).alias("_m"))  # at most `bins` of them
    each = every.select(group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_m").select(group, "bin", F.try_element_at("_m", F.col("bin")).alias("_b"))
    middle = (F.col("bin") + 0.5) / bins
    return each.select(group, "bin", F.coalesce("_b.n", F.lit(0)).alias("rows"), F.round(F.coalesce("_b.c", middle), 6).alias("confidence"), F.round(F.coalesce("_b.r", F.lit(0.0)), 6).alias("accuracy"))


def outliers(df: DataFrame, group: str, value: str, threshold: float = 2.5) -> DataFrame:
    """Rows whose population z-score within the group is beyond the threshold; groups without variance have none."""
    stats = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return df.join(stats, group).withColumn("z", F.round((F.col(value) - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)), 6)).where(F.abs("z") > threshold).drop("mean", "sd")


def hash_bucket(text: Column, modulus: int = 1000) -> Column:
    """md5 of a text as an integer modulo `modulus`, folded eight hex digits at a time."""
    digest, out = F.md5(text), F.lit(0).cast("long")
    for i in (1, 9, 17, 25):
        out = (out * F.lit((1 << 32) % modulus) + F.conv(F.substring(digest, i, 8), 16, 10).cast("long") % modulus) % modulus
    return out


def ab_compare(df: DataFrame, variant: Column, value: str) -> DataFrame:
    """Mean, variance and Welch's t of two variants, in one row."""
    rows = df.select(variant.alias("b"), F.col(value).alias("v"))
    pick = lambda b: F.when(F.col("b") == b, F.col("v"))
    out = rows.agg(*(f(pick(b)).alias(f"{n}{i}") for i, b in enumerate((False, True)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    t = (F.col("mean1") - F.col("mean0")) / F.sqrt(F.col("var0") / F.col("n0") + F.col("var1") / F.col("n1"))
    return out.select("n0", "n1", *(F.round(c, 6).alias(c) for c in ("mean0", "mean1", "var0", "var1")), F.round(t, 6).alias("t"))


def entropy_balance(df: DataFrame, group: str, kind: str) -> DataFrame:
    """min(H / ln(k + 1), 1) of the distribution of k kinds within a group."""
    counts = df.groupBy(group, kind).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    h = counts.select(group, (-share * F.ln(share)).alias("h")).groupBy(group).agg(F.sum("h").alias("h"), F.count("*").alias("k"))
    return h.select(group, "k", F.round(F.least(F.col("h") / F.ln(F.col("k") + 1), F.lit(1.0)), 6).alias("balance"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def vocabulary(df: DataFrame, group: str, text: str) -> DataFrame:
    """Total and distinct tokens, and their quotient. Tokens are counted before distinct ones are, so no set is held."""
    words = df.select(group, F.explode(tokens(F.col(text))).alias("w")).groupBy(group, "w").agg(F.count("*").alias("n"))
    return words.groupBy(group).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_words")).withColumn("diversity", F.round(F.col("distinct_words") / F.col("total"), 6))


def bleu(df: DataFrame, key: str, reference: str, hypothesis: str, n: int) -> DataFrame:
    """Clipped n-gram matches divided by the hypothesis's tokens, times the brevity penalty; 0 if the hypothesis has fewer than n tokens."""
    grams = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    rows = df.select(key, tokens(F.col(reference)).alias("r"), tokens(F.col(hypothesis)).alias("h"))
    count = lambda side: rows.select(key, F.explode(grams(F.col(side))).alias("g")).groupBy(key, "g").agg(F.count("*").alias(side))
    hits = count("r").join(count("h"), [key, "g"]).groupBy(key).agg(F.sum(F.least("r", "h")).alias("hits"))
    nr, nh = F.size("r"), F.size("h")
    penalty = F.when(nh >= nr, 1.0).otherwise(F.exp(1 - nr / F.nullif(nh, F.lit(0))))
    return rows.join(hits, key, "left").select(key, F.round(F.when(nh < n, 0.0).otherwise(penalty * F.coalesce("hits", F.lit(0)) / nh), 6).alias(f"bleu_{n}"))
