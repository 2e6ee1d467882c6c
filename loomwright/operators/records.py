"""Nested records: filters over arrays of structs, differences by position, votes, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_kind(items: Column, field: str, kinds: list[str]) -> Column:
    """The array's items whose field is one of the kinds; a null array gives an empty one."""
    return F.filter(F.coalesce(items, F.array()), lambda x: F.coalesce(x[field].isin(kinds), F.lit(False)))


def inner(items: Column, field: str) -> Column:
    """All items of an array field of the array's items, in order; nulls are left out."""
    return F.flatten(F.filter(F.transform(items, lambda x: x[field]), lambda x: x.isNotNull()))


def largest(items: Column, field: str) -> Column:
    """The first of the items with the largest field, null if there is none."""
    best = F.array_max(F.transform(items, lambda x: x[field]))
    return F.get(F.filter(items, lambda x: x[field] == best), F.lit(0))


def by_position(old: DataFrame, new: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Counts of added, removed, modified and unchanged positions of each key."""
    a = old.select(key, position, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(key, position, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, [key, position], "full")
    same = F.col("_a").eqNullSafe(F.col("_b"))
    met = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    kinds = {"added": F.col("_in_a").isNull(), "removed": F.col("_in_b").isNull(), "modified": met & ~same, "unchanged": met & same}
    return both.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))


def integrity(store: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest in the index differs from the store's, or that only one side has."""
    a, b = store.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_in_a")), index.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, key, "full")
    problem = F.when(F.col("_in_b").isNull(), "not indexed").when(F.col("_in_a").isNull(), "not stored").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def majority(df: DataFrame, key: str, order: str, vote: str, weight: str) -> DataFrame:
    """The most frequent vote of each key (ties: the earliest, then the smallest), its share, and the vote with the largest summed weight."""
    votes = df.dropna(subset=[vote]).groupBy(key, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.round(F.coalesce(F.sum(weight), F.lit(0.0)), 6).alias("w"))
    best = lambda c: F.min_by(vote, F.struct(-F.col(c), F.col("first"), F.col(vote)))
    return votes.groupBy(key).agg(F.sum("n").alias("votes"), best("n").alias("winner"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), best("w").alias("weighted"))


def elsewhere(df: DataFrame, digest: str, owner: str, mine: str) -> DataFrame:
    """Rows of other owners whose digest one of my rows has."""
    own = df.where(F.col(owner) == mine).select(digest).distinct()
    return df.where(F.col(owner) != mine).join(own, digest, "left_semi")
