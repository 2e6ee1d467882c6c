"""Differences of texts against a plain table of subsequences and the standard library's ratio."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import diffs


def _length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = list(row)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_scripts_are_shortest_and_give_both_texts():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a, b = (["abcde"[i] for i in rng.integers(0, rng.integers(1, 6), rng.integers(0, 40))] for _ in range(2))
        steps = diffs.script(a, b)
        assert [x for o, x in steps if o != "+"] == a and [x for o, x in steps if o != "-"] == b
        assert sum(o == " " for o, _ in steps) == _length(a, b)


def test_ratio_is_that_of_longest_matches():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = ("".join("abcd"[i] for i in rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[: len(a) // 2] + b + a[len(a) // 2 :]
        assert diffs.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_long_texts():
    a = [f"line {i % 700}" for i in range(6000)]
    b = [x for i, x in enumerate(a) if i % 5] + ["new"]
    steps = diffs.script(a, b)
    assert sum(o == " " for o, _ in steps) == 4800 and [x for o, x in steps if o != "-"] == b


def test_in_a_table(spark):
    rows = [(1, "a\nb\nc\n", "a\nc\nd\n"), (2, None, "x"), (3, "", None), (4, "é\n", "é\n"), (5, "a\n\nb", "a\n\n")]
    df = spark.createDataFrame(rows, "id long, o string, n string")
    found = {r.id: r.d for r in df.select("id", diffs.compared(F.col("o"), F.col("n")).alias("d")).collect()}
    assert (list(found[1].added), list(found[1].removed), list(found[1].kept)) == (["d"], ["b"], ["a", "c"])
    assert [tuple(s) for s in found[1].script] == [(" ", "a"), ("-", "b"), (" ", "c"), ("+", "d")]
    assert list(found[2].added) == ["x"] and found[3].ratio == 1.0 and found[4].ratio == 1.0 and list(found[5].removed) == ["b"]
    assert df.limit(0).select(diffs.compared(F.col("o"), F.col("n")).alias("d")).collect() == []
    assert df.select(diffs.compared(F.col("o"), F.col("n"), with_ratio=False).alias("d")).where("d.ratio is not null").count() == 0
