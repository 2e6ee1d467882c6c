"""Filters, pages, ranking and policy rules over any table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """A conjunction: equal values, lower bounds (null fails), upper bounds (null fails unless keep_null) and substrings."""

    equal: dict = field(default_factory=dict)
    at_least: dict = field(default_factory=dict)
    at_most: dict = field(default_factory=dict)
    contains: dict = field(default_factory=dict)
    keep_null: bool = False

    def column(self) -> Column:
        parts = [F.col(c) == v for c, v in self.equal.items()] + [F.col(c) >= v for c, v in self.at_least.items()]
        parts += [(F.col(c) <= v) | F.col(c).isNull() if self.keep_null else F.col(c) <= v for c, v in self.at_most.items()]
        parts += [F.col(c).contains(v) for c, v in self.contains.items()]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def page(df: DataFrame, rows: Filter, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of the filtered rows; `order` ends with a unique key, so pages neither overlap nor miss rows."""
    return df.where(rows.column()).orderBy(*order).offset(offset).limit(limit)


def leaderboard(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rank (row number) within each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def policy(rule: str, name: str, value) -> Column:
    """A policy operator on a column; null is false for all but 'missing'."""
    c = F.col(name)
    test = {"eq": c == value, "ne": c != value, "gt": c > value, "ge": c >= value, "lt": c < value, "le": c <= value, "in": c.isin(value if isinstance(value, list) else [value]), "exists": c.isNotNull(), "missing": c.isNull()}[rule]
    return F.coalesce(test, F.lit(False))


def levels(score: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first bound that the score reaches."""
    out = F
    for low, name in bounds:
        out = out.when(score >= low, name)
    return out.otherwise(otherwise)


def ordered_pairs(df: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """(group, winner, loser) of each group's rows by falling score; groups are small by nature, such as the candidates for one prompt."""
    a, b = df.alias("a"), df.alias("b")
    first = (F.col(f"a.{score}") > F.col(f"b.{score}")) | ((F.col(f"a.{score}") == F.col(f"b.{score}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    return a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & first).select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("winner"), F.col(f"b.{key}").alias("loser"))
