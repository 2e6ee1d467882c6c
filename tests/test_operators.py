"""Small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import changes, measures, ranges, select, series, vectors
from loomwright.sources import tables


def test_islands_tie_with_the_running_end_opens_a_new_set(spark):
    rows = spark.createDataFrame([("g", 1, 0.0, 5.0), ("g", 2, 1.0, 2.0), ("g", 3, 4.0, 6.0), ("g", 4, 6.0, 7.0), ("g", 5, 6.5, 9.0), ("g", 6, 9.0, 9.0)], "g string, id int, a double, b double")
    assert {r.id: r.island for r in series.islands(rows, "g", "a", "b", "id").collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}


def test_as_of(spark):
    marks = spark.createDataFrame([("o1", 1.0, "b"), ("o1", 3.0, "c")], "o string, ts double, state_ string")
    asked = spark.createDataFrame([("o1", x) for x in (0.5, 1.0, 2.9, 3.0)], "o string, ts double")
    assert {r.ts: r.state for r in series.as_of(asked, marks, "o", "ts", "state_", "unknown").collect()} == {0.5: "unknown", 1.0: "b", 2.9: "b", 3.0: "c"}


def test_nearest_rank(spark):
    rows = spark.range(1, 11).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    found = series.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert (found.p50, found.p95, found.p99) == (6, 10, 10)


def test_pareto(spark):
    rows = spark.createDataFrame([("g", c, q) for c, q in ((1, 0.5), (2, 0.5), (3, 0.7), (4, 0.6), (5, 0.9))], "g string, cost int, quality double")
    assert {r.cost for r in series.pareto(rows, "g", "cost", "quality", "cost").collect()} == {1, 3, 5}


def test_relations(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 2.0, 3.0), (1, 3, 0.0, 2.0), (1, 4, 1.0, 4.0)], "g int, id int, a double, b double")
    found = {(r.a, r.b): r.relation for r in series.relations(rows, ["g"], "id", "a", "b").collect()}
    assert found == {(1, 2): "MEETS", (1, 3): "EQUALS", (1, 4): "OVERLAPS", (3, 4): "OVERLAPS"}


def test_bleu_uses_token_counts(spark):
    import math

    rows = spark.createDataFrame([(1, "a b c d", "a b")], "k int, r string, h string")
    assert measures.bleu(rows, "k", "r", "h", 1).first().bleu_1 == round(math.exp(-1), 6)
    assert measures.bleu(rows, "k", "r", "h", 2).first().bleu_2 == round(math.exp(-1) / 2, 6)


def test_null_bounds_and_policies(spark):
    rows = spark.createDataFrame([(None,), (0.2,), (0.8,)], "q double")
    assert rows.where(select.Filter(at_least={"q": 0.5}).column()).count() == 1
    assert rows.where(select.Filter(at_most={"q": 0.5}).column()).count() == 1
    assert rows.where(select.Filter(at_most={"q": 0.5}, keep_null=True).column()).count() == 2
    assert rows.where(select.policy("ne", "q", 1.0)).count() == 2


def test_redact(spark):
    assert spark.range(1).select(text.redact(F.lit("mail a.b@c.com now")).alias("x")).first().x == "mail [REDACTED] now"


def test_hash_bucket_is_md5_modulo(spark):
    import hashlib

    for word in ("exp1:7", "x", ""):
        got = spark.range(1).select(measures.hash_bucket(F.lit(word)).alias("b")).first().b
        assert got == int(hashlib.md5(word.encode()).hexdigest(), 16) % 1000


def test_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: r.change for r in changes.diff(old, new, "k", "v").collect()} == {1: "removed", 2: "changed", 4: "added"}


def test_relations_of_all_days(spark, tmp_path):
    from datetime import datetime

    from loomwright.plans import catalog, registry  # noqa: F401

    stamps = [(1, datetime(2024, 1, 1, 23, 55), 7, 1.0), (2, datetime(2024, 1, 2, 0, 1), 7, 1.0), (3, datetime(2024, 1, 3, 12), 7, 1.0), (4, datetime(2024, 1, 2, 0, 1), 8, 1.0)]
    spark.createDataFrame(stamps, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["interval_relations_all"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.relation for r in found} == {(1, 2): "OVERLAPS", (1, 3): "BEFORE", (2, 3): "BEFORE"}


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("metric", ["cosine", "inner", "l2"])
def test_top_k_on_odd_vectors(spark, monkeypatch, metric, shuffled):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1000)
    if shuffled:
        monkeypatch.setattr(vectors, "MOST_BROADCAST", 0)
    draw = np.random.default_rng(1)
    rows = [(i, draw.integers(-3, 4, 5 if i % 7 else 3).astype(float).tolist()) for i in range(120)]
    rows += [(None, [1.0] * 5), (400, None), (401, []), (402, [0.0] * 5), (403, [float("nan")] * 5), (404, [None] * 5), (7, [1.0] * 5)]
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v) and (metric != "cosine" or any(v))]
    score = {"cosine": lambda q, v: q @ v / np.linalg.norm(q) / np.linalg.norm(v), "inner": lambda q, v: q @ v, "l2": lambda q, v: -np.linalg.norm(q - v)}[metric]
    want = {}
    for i, q in fine:
        if i % 50 == 0:
            others = sorted((-round(float(score(q, v)), 6), j) for j, v in fine if j != i and len(v) == len(q))
            want |= {(i, rank): (j, -s + 0.0) for rank, (s, j) in enumerate(others[:5], 1)}
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = vectors.top_k(df, df.where("id % 50 = 0"), "id", "v", 5, metric).collect()
    assert {(r.query, r["rank"]): (r.id, r.score + 0.0) for r in found} == want
    assert vectors.top_k(df, df.where("false"), "id", "v", 5, metric).count() == 0


def test_running_sums_of_one_large_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").alias("g"), (F.col("id") * 7919 % 5000).cast("double").alias("v"), (F.col("id") % 5).alias("n"))
    found = ranges.running(rows, ["g"], "v", ["n"]).collect()
    for g in ("hot", None):
        upto = 0
        for r in sorted((r for r in found if r.g == g), key=lambda r: r.v):
            upto += r.n
            assert r.upto_n == upto
        assert {r.all_n for r in found if r.g == g} == {upto}
    assert len(found) == 5000


def test_null_partition_is_unknown(spark, tmp_path):
    tables.write_store(spark.createDataFrame([(1, None), (2, ""), (3, "a")], "id int, source string"), str(tmp_path / "s"), ["source"])
    assert {(r.id, r.source) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(1, "unknown"), (2, "unknown"), (3, "a")}
