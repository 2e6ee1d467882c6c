"""Quality dimensions of annotated items: facts named in captions, grounded objects and actions, uses for robots, confidence, time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import objects


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def factuality(df: DataFrame, item: str, caption: str, verb: str, thing: str) -> DataFrame:
    """Shares of an item's captions that name one of its verbs or things, the number of issues and a score.

    A row is a segment with a caption, a verb and a thing; null or empty
    ones aren't there. Issues: no verbs, no things, no captions, and under
    half of the captions naming a verb or a thing of those that exist.
    """
    rows = df.select(item, F.lower(F.coalesce(caption, F.lit(""))).alias("_text"), F.nullif(F.lower(verb), F.lit("")).alias("_verb"), F.nullif(F.lower(thing), F.lit("")).alias("_thing"))
    sets = rows.groupBy(item).agg(F.collect_set("_verb").alias("_verbs"), F.collect_set("_thing").alias("_things"))
    named = lambda names: F.exists(names, lambda x: F.contains(F.col("_text"), x)).cast("int")
    facts = rows.join(sets, item).groupBy(item).agg(F.avg(named("_verbs")).alias("verbs"), F.avg(named("_things")).alias("things"), F.max(F.size("_verbs") > 0).alias("_v"), F.max(F.size("_things") > 0).alias("_t"), F.max(F.trim("_text") != "").alias("_c"))
    problems = [~F.col("_v"), ~F.col("_t"), ~F.col("_c"), F.col("_v") & (F.col("verbs") < 0.5), F.col("_t") & (F.col("things") < 0.5)]
    issues = sum((p.cast("int") for p in problems[1:]), problems[0].cast("int"))
    base = 0.5 + F.when(F.col("_v") & F.col("_t"), 0.2).otherwise(0.0) + F.when(F.col("verbs") > 0.7, 0.15).otherwise(0.0) + F.when(F.col("things") > 0.7, 0.15).otherwise(0.0)
    return facts.select(item, F.round("verbs", 6).alias("verbs"), F.round("things", 6).alias("things"), issues.alias("issues"), F.round(F.greatest(F.lit(0.0), base - issues * 0.1), 6).alias("score"))


def object_grounding(df: DataFrame, item: str, thing: str, box: str, confidence: str) -> DataFrame:
    """Shares of an item's objects with a box, with a confidence and with one above 0.7, and a score; 0.3 without objects."""
    here = F.col(thing).isNotNull()
    counts = {"objects": here, "_boxed": here & F.col(box).isNotNull(), "_sure": here & F.col(confidence).isNotNull(), "_high": here & (F.col(confidence) > 0.7)}
    rows = df.groupBy(item).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    boxed, sure, high = (_share(F.col(c), F.col("objects")) for c in ("_boxed", "_sure", "_high"))
    score = F.when(F.col("objects") == 0, 0.3).otherwise(F.least(F.lit(1.0), 0.4 + boxed * 0.3 + sure * 0.15 + high * 0.15))
    return rows.select(item, "objects", F.round(boxed, 6).alias("boxed"), F.round(sure, 6).alias("sure"), F.round(high, 6).alias("high"), F.round(score, 6).alias("score"))


def action_grounding(df: DataFrame, item: str, action: str, start: str, end: str) -> DataFrame:
    """Share of an item's actions with both times, their mean length where positive, and a score; 0.3 without actions."""
    here = F.col(action).isNotNull()
    lasts = F.when(here, F.col(end) - F.col(start))
    rows = df.groupBy(item).agg(F.count_if(here).alias("actions"), F.count(lasts).alias("_timed"), F.avg(F.when(lasts > 0, lasts)).alias("mean"))
    timed = _share(F.col("_timed"), F.col("actions"))
    score = F.when(F.col("actions") == 0, 0.3).otherwise(F.least(F.lit(1.0), 0.5 + timed * 0.3 + F.when(F.col("mean").isNotNull(), 0.2).otherwise(0.0)))
    pace = F.when(F.col("mean") < 0.5, "too short").when(F.col("mean") > 30, "too long")
    return rows.select(item, "actions", F.round(timed, 6).alias("timed"), F.round("mean", 6).alias("mean"), pace.alias("pace"), F.round(score, 6).alias("score"))


def time_features(df: DataFrame, item: str, order: list[str], start: str, end: str) -> DataFrame:
    """Number, mean and deviation of an item's segment lengths, and mean and largest gap between neighbours (overlaps count as no gap)."""
    before = F.lag(end).over(Window.partitionBy(item).orderBy(*order))
    rows = df.withColumn("_lasts", F.col(end) - F.col(start)).withColumn("_gap", F.when(before.isNotNull(), F.greatest(F.lit(0.0), F.col(start) - before)))
    return rows.groupBy(item).agg(F.count("*").alias("segments"), F.round(F.avg("_lasts"), 4).alias("mean"), F.round(F.stddev_pop("_lasts"), 4).alias("sd"), F.round(F.coalesce(F.avg("_gap"), F.lit(0.0)), 4).alias("mean_gap"), F.round(F.coalesce(F.max("_gap"), F.lit(0.0)), 4).alias("largest_gap"))


def affordance(df: DataFrame, item: str, verb: str, noun: str, physical: str) -> DataFrame:
    """Shares of an item's actions with physical properties and with a noun that fits the verb, and a score; 0.5 without actions.

    A row is an action; a row with a null verb is none, so that items without actions can be given too.
    """
    here = F.col(verb).isNotNull()
    rows = df.groupBy(item).agg(F.count_if(here).alias("actions"), F.count_if(here & F.col(physical).isNotNull()).alias("_p"), F.count_if(here & objects.fits(F.col(verb), F.col(noun))).alias("_f"))
    physical_, fitting = (_share(F.col(c), F.col("actions")) for c in ("_p", "_f"))
    score = F.when(F.col("actions") == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.4 + physical_ * 0.3 + fitting * 0.3))
    return rows.select(item, "actions", F.round(physical_, 6).alias("physical"), F.round(fitting, 6).alias("fitting"), F.round(score, 6).alias("score"))


def robotic_usefulness(df: DataFrame, item: str, verb: str, physical: str, embodiment: str, gripper: str) -> DataFrame:
    """Shares of an item's actions that handle things, with an embodiment, with its gripper's state and with physical properties, and a score; 0.3 without actions.

    A row is an action; a row with a null verb is none. A gripper's state
    counts only with an embodiment, and not if it is empty.
    """
    here = F.col(verb).isNotNull()
    body = here & F.col(embodiment).isNotNull()
    counts = {"handling": here & F.lower(verb).isin(*objects.MANIPULATION), "embodied": body, "gripping": body & (F.length(gripper) > 0), "physical": here & F.col(physical).isNotNull()}
    rows = df.groupBy(item).agg(F.count_if(here).alias("actions"), *(F.count_if(c).alias(f"_{n}") for n, c in counts.items()))
    shares = {n: _share(F.col(f"_{n}"), F.col("actions")) for n in counts}
    score = 0.2 + shares["handling"] * 0.3 + shares["embodied"] * 0.2 + shares["gripping"] * 0.15 + shares["physical"] * 0.15
    return rows.select(item, "actions", *(F.round(c, 6).alias(n) for n, c in shares.items()), F.round(F.when(F.col("actions") == 0, 0.3).otherwise(F.least(F.lit(1.0), score)), 6).alias("score"))


def confidences(df: DataFrame, item: str, segment: str, actions: str, things: str, extras: str, quality: str, metrics: str) -> DataFrame:
    """Confidence in an item's parsing, and in what a reviewer would say of it, estimated from how full it is.

    A row is a segment with its numbers of actions, things and extra fields
    (null: 0), and its item's quality and map of metrics (null or empty:
    none); a row with a null segment stands for an item without segments.
    Parsing: the metric parse_confidence (0.5 in other metrics), else the
    quality, else 0.5; at least the mean share of segments with actions and
    with things; at most 1. Reviewer: 0.2 for each of segments, an action
    a segment, a thing a segment, extra fields and a quality.
    """
    here, n = F.col(segment).isNotNull(), lambda c: F.coalesce(F.col(c), F.lit(0))
    parse = F.when(F.size(metrics) > 0, F.coalesce(F.try_element_at(F.col(metrics), F.lit("parse_confidence")), F.lit(0.5)))
    sums = {f"_{c}": F.coalesce(F.sum(F.when(here, n(x))), F.lit(0)) for c, x in (("a", actions), ("t", things), ("x", extras))}
    some = {f"_{c}s": F.count_if(here & (n(x) > 0)) for c, x in (("a", actions), ("t", things))}
    rows = df.groupBy(item).agg(F.count_if(here).alias("segments"), F.max(quality).alias("_q"), F.max(parse).alias("_p"), *(v.alias(k) for k, v in (sums | some).items()))
    full = (_share(F.col("_as"), F.col("segments")) + _share(F.col("_ts"), F.col("segments"))) / 2
    parsing = F.least(F.lit(1.0), F.greatest(F.coalesce("_p", "_q", F.lit(0.5)), full))
    one = F.greatest(F.col("segments"), F.lit(1))
    points = [F.col("segments") > 0, F.col("_a") >= one, F.col("_t") >= one, F.col("_x") > 0, F.col("_q").isNotNull()]
    reviewer = sum((p.cast("int") for p in points[1:]), points[0].cast("int")) / 5
    return rows.select(item, "segments", F.round(parsing, 6).alias("parsing"), F.round(reviewer, 6).alias("reviewer"))
