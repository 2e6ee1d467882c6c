"""Rollbacks at thresholds and ties, whatever the order of the rows."""

import math
from functools import reduce
from operator import add

import duckdb
from pyspark.sql import functions as F

from loomwright.operators import reports


def _found(spark, rows):
    df = spark.createDataFrame(rows, "k string, q double, bad boolean, ms double").coalesce(1)
    out = reports.rollback(df, "k", "q", F.col("bad"), "ms", 5, 0.1, 0.35, 26.0)
    return {r.k: (r.n, r.quality, r.failures, r.latency, r.reason) for r in out.collect()}


def test_a_mean_at_the_threshold_is_not_below_it(spark):
    # ten times 0.1, added one by one, are 0.9999999999999999
    assert reduce(add, [0.1] * 10) / 10 < 0.1
    rows = [("at", 0.1, False, 26.0)] * 10 + [("below", 0.1, False, 0.0)] * 9 + [("below", 0.0999, False, 0.0)]
    assert _found(spark, rows) == {"at": (10, 0.1, 0.0, 26.0, None), "below": (10, 0.09999, 0.0, 0.0, "quality")}


def test_large_and_small_values_in_any_order(spark):
    values = [1e9, 0.3, -1e9, 2.0**-40, 0.1, -0.7]
    want = math.fsum(values) / 6
    for turn in range(6):
        (row,) = _found(spark, [("a", v, False, v) for v in values[turn:] + values[:turn]]).values()
        assert row[1] == row[3] == round(want, 6)


def test_ties_are_rounded_as_the_sql_rounds_them(spark):
    rows = [("a", 0.5, i < 323, 1.0) for i in range(640)] + [("b", 0.5, i < 201, 1.0) for i in range(640)]
    want = duckdb.execute("SELECT round(323 / 640, 6), round(201 / 640, 6)").fetchone()
    found = _found(spark, rows)
    assert (found["a"][2], found["b"][2]) == want


def test_groups_without_numbers_or_with_more_than_numbers(spark):
    rows = [("null", None, None, None)] * 5 + [("some", None, False, 1.0)] * 4 + [("some", 0.25, False, None)] + [("inf", math.inf, False, 1e300)] * 5 + [("nan", math.nan, False, 1.0)] * 5 + [("few", 0.0, True, 99.0)] * 4
    found = _found(spark, rows)
    assert found["null"] == (5, None, 0.0, None, None)
    assert found["some"] == (5, 0.25, 0.0, 1.0, None)
    assert found["inf"][1] == math.inf and found["inf"][3] == 1e300 and found["inf"][4] == "latency"
    assert math.isnan(found["nan"][1])
    assert found["few"] == (4, 0.0, 1.0, 99.0, None)
