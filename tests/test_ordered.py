"""Ordered folds and lasting alerts against plain loops."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from loomwright.operators import folds
from loomwright.streaming import alerts


def _rows(n, seed):
    rng = random.Random(seed)
    # one key holds most rows, others few; some keys and values are null
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, 0.0, rng.random() * 100])) for i in range(n)]


def _average(values, alpha=0.1):
    x, out = 0.0, []
    for v in values:
        x = x if v is None else (1 - alpha) * x + alpha * v
        out.append(x)
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_averages_of_a_hot_key(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = _rows(3000, 1)
        random.Random(2).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, i long, v double")
        out = folds.running(df, ["k"], ["i"], {"m": folds.average(F.col("v")), "s": folds.total(F.col("v"))})
        got = {(r.k, r.i): (r.m, r.s) for r in out.collect()}
        last = {r.k: (r.n, r.m) for r in folds.final(df, ["k"], ["i"], {"m": folds.average(F.col("v"))}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in ("hot", "a", "b", None):
        mine = sorted((i, v) for kk, i, v in rows if kk == k)
        want, total = _average([v for _, v in mine]), 0.0
        for (i, v), m in zip(mine, want, strict=True):
            total += v or 0.0
            assert got[k, i] == (pytest.approx(m), pytest.approx(total))
        assert last[k] == (len(mine), pytest.approx(want[-1]))


def test_a_hot_key_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = []
        plain = folds.stored
        folds.stored = lambda df, label: parts.append(plain(df, label)) or parts[-1]
        folds.running(spark.range(4000).selectExpr("'x' as k", "id as i"), ["k"], ["i"], {"n": folds.total(F.lit(1))})
    finally:
        folds.stored = plain
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts[0].select("__part").distinct().count() > 1


def test_thresholds_by_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.random() < 0.3 + 0.3 * (i > 300), rng.random() < 0.75) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, f boolean, s boolean")
    got = {r.i: (r.n, r.threshold) for r in folds.adaptive_threshold(df, ["k"], ["i"], F.col("f"), F.col("s"), 0.5, 0.3, 0.7, 0.1).collect()}
    for k in "ab":
        x, seen = 0.5, []
        for _, i, f, s in (r for r in rows if r[0] == k):
            seen.append((f, s))
            if len(seen) >= 20:
                part = seen[-50:]
                fall, good = sum(p[0] for p in part) / len(part), sum(p[1] for p in part) / len(part)
                x = min(1.0, x + 0.1) if fall > 0.3 else max(0.0, x - 0.1) if fall < 0.3 * 0.8 else x
                x = min(1.0, x + 0.1) if good < 0.7 else x
            assert got[i] == (len(seen), pytest.approx(x))


def test_folds_of_nothing(spark):
    df = spark.createDataFrame([], "k string, i long, v double")
    assert folds.running(df, ["k"], ["i"], {"m": folds.average(F.col("v"))}).collect() == []


RULES = [
    alerts.Rule("now", ">", 50, "critical", 0, 300, {"kind": "x"}),
    alerts.Rule("long", ">=", 30, "warning", 200, 0, {"kind": "x", "place": 1}),
    alerts.Rule("any", "<", 5),
]
ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def _loop(rows):
    out = []
    for rule in RULES:
        since = last = None
        on = False
        for at, seq, kind, place, value in sorted(rows):
            if value is None or any({"kind": kind, "place": place}[k] != v for k, v in rule.labels.items()):
                continue
            hit = {">": value > rule.threshold, ">=": value >= rule.threshold, "<": value < rule.threshold}[rule.op]
            if hit:
                since = at if since is None else since
                if at - since >= rule.lasts and (last is None or at - last >= rule.limit):
                    last, on = at, True
                    out.append((rule.name, "alert", seq))
            else:
                if on:
                    out.append((rule.name, "recovered", seq))
                since, on = None, False
    return sorted(out)


def test_alerts_over_batches_and_restarts(spark, tmp_path):
    """Rows a little out of order, in four runs of two files each, each run from the checkpoint of the one before."""
    rng = random.Random(9)
    rows = [(i * 20 + rng.randrange(60), i, rng.choice("xy"), rng.randrange(2), rng.choice([None, rng.random() * 100])) for i in range(400)]
    schema = "ts timestamp, event_id long, kind string, place long, value double"
    frame = lambda part: spark.createDataFrame([(ZERO + datetime.timedelta(seconds=r[0]), *r[1:]) for r in part], schema)
    source, n = str(tmp_path / "in"), 50
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for run in range(4):
        for half in range(2):
            at = (2 * run + half) * n
            frame(rows[at : at + n]).coalesce(1).write.mode("append").parquet(source)
            time.sleep(1.1)  # files are taken by their time
        alerts.watch_to(stream, RULES, str(tmp_path / "out"), str(tmp_path / "state"), "5 minutes")
    for _ in range(2):
        alerts.closing(frame(rows), "ts", "value").coalesce(1).write.mode("append").parquet(source)
        alerts.watch_to(stream, RULES, str(tmp_path / "out"), str(tmp_path / "state"), "5 minutes")
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.rule, r.kind, r.seq) for r in found) == _loop(rows)
    at = {seq: ts for ts, seq, *_ in rows}
    assert all(r.at.replace(tzinfo=datetime.timezone.utc) == ZERO + datetime.timedelta(seconds=at[r.seq]) for r in found)


def test_rules_need_names(spark):
    with pytest.raises(ValueError):
        alerts.watch(spark.range(1), [RULES[0], RULES[0]])
