"""Quality of datasets and of timelines, diverse choice, combined scores and comparison of periods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dataset_quality(df: DataFrame, item: str, caption: str, verb: str) -> DataFrame:
    """One row on a table of segments: items, segments an item, caption length, vocabulary, verb diversity and balance, missing fields.

    Null captions count as empty and missing. balance is the entropy of
    the verbs over ln(verbs + 1), 1 at most. An empty table gives zeros.
    """
    segments = df.select(F.col(item).alias("i"), F.coalesce(caption, F.lit("")).alias("c"), F.col(verb).alias("v"))
    missing = F.col("c").eqNullSafe("").cast("int") + F.coalesce(F.col("v") == "", F.lit(True)).cast("int")
    plain = segments.agg(F.count_distinct("i").alias("items"), F.count("*").alias("segments"), F.avg(F.length("c")).alias("length"), F.sum(missing).alias("missing"))
    words = segments.select(F.explode(F.regexp_extract_all(F.lower("c"), F.lit(r"\S+"), F.lit(0))).alias("w")).agg(F.count_distinct("w").alias("words"))
    verbs = segments.where("v <> ''").groupBy("v").agg(F.count("*").alias("n"))
    spread = verbs.agg(F.count("*").alias("verbs"), F.sum("n").alias("said"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (plain, words, spread))
    one = parts.agg(*(F.max(c).alias(c) for c in ("items", "segments", "length", "missing", "words", "verbs", "said", "nln")))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    entropy = F.ln("said") - F.col("nln") / F.col("said")
    balance = F.when(F.col("verbs") > 0, F.least(entropy / F.ln(F.col("verbs") + 1), F.lit(1.0))).otherwise(0.0)
    return one.select("items", share(F.col("segments"), F.col("items")).alias("segments_per_item"), F.round(F.coalesce("length", F.lit(0.0)), 6).alias("caption_length"), F.col("words").alias("vocabulary"),
        share(F.col("verbs"), F.col("said")).alias("verb_diversity"), F.round(balance, 6).alias("balance"), share(F.col("missing"), F.col("segments") * 2 + F.col("items")).alias("missing_rate"))


def vocabulary(df: DataFrame, verb: str, noun: str, top: int = 10) -> DataFrame:
    """One row: distinct and all words, distinct verbs and nouns, diversity, and the most frequent verbs and nouns (word:n, ties by word). Nulls are no words."""
    words = df.select(F.explode(F.array(F.struct(F.lit("v").alias("kind"), F.col(verb).alias("w")), F.struct(F.lit("n").alias("kind"), F.col(noun).alias("w")))).alias("x")).select("x.*").where("w is not null")
    counts = words.groupBy("kind", "w").agg(F.count("*").alias("n"))
    both = counts.groupBy("w").agg(F.sum("n").alias("n"), F.max((F.col("kind") == "v").cast("int")).alias("v"), F.max((F.col("kind") == "n").cast("int")).alias("o"))
    totals = both.agg(F.count("*").alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.coalesce(F.sum("v"), F.lit(0)).alias("unique_verbs"), F.coalesce(F.sum("o"), F.lit(0)).alias("unique_nouns"))
    first = lambda kind, name: counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "w").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "w"))), lambda x: F.concat_ws(":", x["w"], -x["m"])), ",").alias(name))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (totals, first("v", "top_verbs"), first("n", "top_nouns")))
    names = ["unique_words", "total_words", "unique_verbs", "unique_nouns", "top_verbs", "top_nouns"]
    one = parts.agg(*(F.max(c).alias(c) for c in names))
    return one.withColumn("diversity", F.round(F.coalesce(F.try_divide("unique_words", "total_words"), F.lit(0.0)), 6))


def temporal_consistency(df: DataFrame, item: str, key: str, start: str, end: str, action: str) -> DataFrame:
    """Overlaps with the next segment, gaps of over 5 s, kinds of action of uneven length, and the score of each item; 0.7 for one segment.

    A kind of action is uneven if it has at least 3 segments and its
    lengths' deviation is over half their mean. The score starts at 1 and
    loses 0.05 an overlap, 0.03 a gap, 0.05 an uneven kind, and 0.1 for each
    of: overlaps over half the segments, gaps over 0.3 of them, over 2
    uneven kinds; it ends at 0.
    """
    after = F.lead(start).over(Window.partitionBy(item).orderBy(start, key))
    rows = df.select(item, action, F.col(start).alias("__a"), F.col(end).alias("__b"), after.alias("__next"))
    length = F.col("__b") - F.col("__a")
    # rows are grouped by item and action first, so one item's window is its only pass over single rows
    kinds = rows.groupBy(item, action).agg(F.count("*").alias("__n"), F.sum((F.col("__b") > F.col("__next")).cast("int")).alias("__o"), F.sum((F.col("__next") - F.col("__b") > 5.0).cast("int")).alias("__g"), F.stddev_samp(length).alias("__s"), F.avg(length).alias("__m"))
    uneven = F.coalesce((F.col("__n") >= 3) & (F.col("__m") > 0) & (F.col("__s") / F.col("__m") > 0.5), F.lit(False)) & F.col(action).isNotNull()
    out = kinds.groupBy(item).agg(F.sum("__n").alias("segments"), F.coalesce(F.sum("__o"), F.lit(0)).alias("overlaps"), F.coalesce(F.sum("__g"), F.lit(0)).alias("large_gaps"), F.sum(uneven.cast("int")).alias("uneven_actions"))
    issues = (F.col("overlaps") > F.col("segments") * 0.5).cast("int") + (F.col("large_gaps") > F.col("segments") * 0.3).cast("int") + (F.col("uneven_actions") > 2).cast("int")
    score = F.greatest(F.lit(0.0), 1 - F.col("overlaps") * 0.05 - F.col("large_gaps") * 0.03 - F.col("uneven_actions") * 0.05 - issues * 0.1)
    return out.withColumn("score", F.round(F.when(F.col("segments") < 2, 0.7).otherwise(score), 6))


def token_iou(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs and the mean overlap of their sets of words (split at white space, any case); two empty texts have 0."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\S+"), F.lit(0)))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(share), F.lit(0.0)), 6).alias("score"))


def _farthest(picks: np.ndarray, most: int):
    """(id, v) -> the `most` best rows of a batch as (id, s, u): s is the least distance to the picks, the length where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm = np.sqrt((v * v).sum(1))
            u = v / (norm + 1e-8)[:, None]
            score = norm if not len(picks) else np.full(len(u), np.inf)
            for p in picks:
                score = np.minimum(score, np.sqrt(((u - p) ** 2).sum(1)))
            score = np.round(score, 9)
            top = np.lexsort((ids, -score))[:most]
            ends = pa.array(np.arange(len(top) + 1) * u.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids[top]), pa.array(score[top]), pa.ListArray.from_arrays(ends, pa.array(u[top].ravel()))], ["id", "s", "u"])

    return run


def k_center(df: DataFrame, id_col: str, vector_col: str, k: int, candidates: int = 256) -> DataFrame:
    """k rows chosen greedily so that each is farthest from those before it, on normalised vectors: rank, id and distance.

    The first is the longest vector; ties (9 decimals) go to the smallest
    id. Null vectors are left out; vectors are of one length, and fewer
    than k rows give all of them.

    A round brings the `candidates` best rows of the table to the driver.
    Distances only fall with further picks, so as long as the best
    candidate is farther than the last of them was, no other row can be:
    a round makes many picks, each exact, from one pass over the table.
    """
    raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    picked, units = [], []
    while len(picked) < k:
        found = raw.mapInArrow(_farthest(np.array(units), candidates), "id long, s double, u array<double>")
        chosen = [p[1] for p in picked]
        rows = found.where(~F.col("id").isin(chosen)) if chosen else found
        # a batch sends enough for all that are chosen already
        best = rows.orderBy(F.desc("s"), "id").limit(candidates).collect()
        if not best:
            break
        ids, score, u = np.array([r.id for r in best]), np.array([r.s for r in best]), np.array([r.u for r in best])
        bound = score[-1] if len(best) == candidates else -1.0
        first = True
        while len(picked) < k and len(ids):
            at = np.lexsort((ids, -score))[0]
            if not first and score[at] <= bound:
                break
            picked.append((len(picked) + 1, int(ids[at]), round(float(score[at]), 6)))
            units.append(u[at])
            gap = np.round(np.sqrt(((u - u[at]) ** 2).sum(1)), 9)
            score = gap if len(picked) == 1 else np.minimum(score, gap)
            keep = np.arange(len(ids)) != at
            ids, score, u = ids[keep], score[keep], u[keep]
            if len(picked) == 1:
                break  # the first is chosen by another measure
            first = False
    return df.sparkSession.createDataFrame(picked, "rank long, id long, score double").withColumnRenamed("id", id_col)


def combined(scores: dict[str, DataFrame], key: str, weights: dict[str, float]) -> DataFrame:
    """The weighted sum of several (key, score) tables for every key in any of them; a score that lacks counts 0. One shuffle for all tables."""
    parts = [table.select(F.col(key), (F.coalesce("score", F.lit(0.0)) * weights[name]).alias("part")) for name, table in scores.items()]
    return reduce(DataFrame.union, parts).groupBy(key).agg(F.round(F.sum("part"), 6).alias("overall"))


def against_earlier(df: DataFrame, day: str, values: list[str], back: int = 1) -> DataFrame:
    """Each day's values less those of the day `back` days before; `compared` is false where that day has no row."""
    earlier = df.select(F.date_add(day, back).alias(day), F.lit(True).alias("there"), *(F.col(v).alias(f"before_{v}") for v in values))
    rows = df.join(earlier, day, "left")
    return rows.select(day, F.coalesce("there", F.lit(False)).alias("compared"), *(F.round(F.col(v) - F.col(f"before_{v}"), 6).alias(f"{v}_change") for v in values))


def narration(start: Column, end: Column, text: Column, actions: Column) -> Column:
    """A narrated segment: its times and middle, text, actions, unknown scene, unseen hands, and an interaction for each action with a noun."""
    hand = F.struct(F.lit(False).alias("visible"))
    touched = F.transform(F.filter(actions, lambda a: F.coalesce(a["noun"], F.lit("")) != ""), lambda a: F.struct(a["verb"].alias("action"), a["noun"].alias("object")))
    return F.struct(start.alias("start_time"), end.alias("end_time"), ((start + end) / 2).alias("timestamp"), text.alias("narration_text"), actions.alias("actions"),
        F.struct(F.lit("unknown").alias("scene_type"), F.lit("unknown").alias("lighting")).alias("scene_context"), F.struct(hand.alias("left_hand"), hand.alias("right_hand")).alias("hand_tracking"), touched.alias("object_interactions"))
