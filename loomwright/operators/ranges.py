"""Running sums in order of a value without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group's range of values is cut into.
CELLS = 64


def _beside(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """left with right's further columns, joined on the named ones, null being equal to null."""
    marked = right.withColumnsRenamed({c: f"__{c}" for c in names})
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
    return left.join(marked, on).drop(*(f"__{c}" for c in names))


def running(counts: DataFrame, group: list[str], value: str, sums: list[str]) -> DataFrame:
    """counts (one row per group and value) with upto_x, the sum of x over values up to the row's, and all_x, for each x of sums.

    Approximate quantiles cut each group's values into CELLS cells of
    about equal size; sums run within a cell and over the cells' totals, so
    a group of any size is spread over CELLS tasks. Cells only deal the
    work out: results are exact whatever the cuts.
    """
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [i / CELLS for i in range(1, CELLS)], F.lit(1000)).alias("__cuts"))
    cell = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    dealt = _beside(counts, cuts, group).withColumn("__cell", cell).drop("__cuts")
    by, inside = Window.partitionBy(*group), Window.partitionBy(*group, "__cell")
    before = by.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(*group, "__cell").agg(*(F.sum(x).alias(f"__{x}") for x in sums))
    per = per.select(*group, "__cell", *(F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"upto_{x}") for x in sums), *(F.sum(f"__{x}").over(by).alias(f"all_{x}") for x in sums))
    here = inside.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({f"__here_{x}": F.sum(x).over(here) for x in sums})
    out = _beside(rows, per, [*group, "__cell"])
    return out.withColumns({f"upto_{x}": F.col(f"upto_{x}") + F.col(f"__here_{x}") for x in sums}).drop("__cell", *(f"__here_{x}" for x in sums))
