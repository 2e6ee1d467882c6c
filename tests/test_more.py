"""Operators of the further queries by brute force, and on odd rows."""

import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomwright.operators import graphs, quality, summaries, textmetrics
from loomwright.plans import more, registry


def _words(text):
    return re.findall(r"\w+", (text or "").lower())


def _longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l_by_brute_force(spark):
    rows = [(1, "a b c d e", "b x d a e"), (2, "", "a"), (3, None, None), (4, "a a b a", "a b b a a"), (5, "same same", "same same")]
    want = {k: round(2 * _longest(_words(r), _words(h)) / max(1, len(_words(r)) + len(_words(h))), 6) for k, r, h in rows}
    found = textmetrics.rouge_l(spark.createDataFrame(rows, "k int, r string, h string"), "k", "r", "h")
    assert {r.k: r.rouge_l for r in found.collect()} == want


def test_jaccard_pairs_by_brute_force(spark):
    texts = ["a b c d e", "e d c b a", "a b c d f", "a b c d", "x", "x", "", None, "a b c d e g", "y z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {}
    for i, x in enumerate(texts):
        if _words(x):
            sets.setdefault(frozenset(_words(x)), []).append(i)
    want = set()
    for a in sets:
        for b in sets:
            if sets[a][0] < sets[b][0] and 100 * len(a & b) >= 60 * len(a | b):
                want.add((sets[a][0], sets[b][0], len(sets[a]), len(sets[b]), round(len(a & b) / len(a | b), 6)))
    assert {tuple(r) for r in textmetrics.jaccard_pairs(rows, "id", "text", 60).collect()} == want
    assert textmetrics.jaccard_pairs(rows.limit(0), "id", "text", 60).count() == 0


def test_walks_end_on_cycles_and_take_the_least_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4), (1, 4), (5, 6), (None, 1), (6, None), (7, 7)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (5,), (1,), (None,), (9,)], "start long")
    found = {(r.start, r.node): r.depth for r in graphs.walk(edges, starts).collect()}
    assert found == {(1, 1): 0, (1, 2): 1, (1, 4): 1, (1, 3): 2, (5, 5): 0, (5, 6): 1, (9, 9): 0}
    assert {r.node for r in graphs.on_cycles(edges).collect()} == {1, 2, 3, 7}
    assert graphs.walk(edges.limit(0), starts.limit(0)).count() == 0


def test_upsert_and_totals_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "c", 3.0)], "k long, g string, v double")
    new = spark.createDataFrame([(2, "b", 5.0), (4, "d", 0.0)], "k long, g string, v double")
    assert {tuple(r) for r in summaries.upsert(rows, new, "k").collect()} == {(1, "a", 1.0), (2, "b", 5.0), (None, "c", 3.0), (4, "d", 0.0)}
    found = {r.g: (r.n, r.sum, r.share) for r in summaries.totals(rows, ["g"], "v").collect()}
    assert found == {"a": (1, 1.0, 0.25), "b": (0, None, None), "c": (1, 3.0, 0.75)}
    assert summaries.totals(rows.limit(0), ["g"], "v").count() == 0


def test_area_of_a_known_frontier(spark):
    points = spark.createDataFrame([(1.0, 0.5), (3.0, 0.7), (5.0, 0.9)], "c double, q double")
    assert summaries.pareto_area(points, "c", "q").first().area == 2.8
    assert summaries.overlap_share(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(4.0)) is not None


@pytest.mark.parametrize("name", sorted(n for n, plan in registry.queries().items() if plan.__module__ == more.__name__))
def test_further_queries_are_their_sql(name, same):
    same(name)


def test_temporal_consistency_by_hand(spark):
    rows = [("one", 1, 0.0, 1.0, "a")] + [("odd", i, s, e, a) for i, (s, e, a) in enumerate([(0, 10, "x"), (5, 6, "x"), (20, 90, "x"), (30, 31, None), (100, 101, "y")])]
    found = quality.temporal_consistency(spark.createDataFrame([(g, i, float(s), float(e), a) for g, i, s, e, a in rows], "g string, i int, s double, e double, a string"), "g", "i", "s", "e", "a")
    assert {(r.g, r.segments, r.overlaps, r.large_gaps, r.uneven_actions, r.score) for r in found.collect()} == {("one", 1, 0, 0, 0, 0.7), ("odd", 5, 2, 2, 1, 0.69)}


def test_quality_on_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], "g string, t string, v string")
    assert [tuple(r) for r in quality.dataset_quality(empty, "g", "t", "v").collect()] == [(0, 0.0, 0.0, 0, 0.0, 0.0, 0.0)]
    assert quality.vocabulary(empty, "t", "v").first().total_words == 0
    rows = spark.createDataFrame([("a", None, None), ("a", "x y", "cut"), ("b", "", "cut")], "g string, t string, v string")
    assert tuple(quality.dataset_quality(rows, "g", "t", "v").first()) == (2, 1.5, 1.0, 2, 0.5, 0.0, 0.375)
    assert quality.token_iou(rows, "t", "v").first().score == 0.0


def test_k_center_by_brute_force(spark):
    rows = [(i, [float((i * 37) % 11 - 5), float((i * 53) % 13 - 6), float(i % 3)]) for i in range(40)] + [(99, None)]
    unit = {i: np.array(v) / (np.linalg.norm(v) + 1e-8) for i, v in rows if v}
    chosen = [max(unit, key=lambda i: (round(float(np.linalg.norm(rows[i][1])), 9), -i))]
    while len(chosen) < 6:
        far = {i: round(min(float(np.linalg.norm(unit[i] - unit[c])) for c in chosen), 9) for i in unit if i not in chosen}
        chosen.append(max(far, key=lambda i: (far[i], -i)))
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [r.id for r in quality.k_center(df, "id", "v", 6).orderBy("rank").collect()] == chosen
    assert quality.k_center(df.where("id < 2"), "id", "v", 6).count() == 2
    assert quality.k_center(df.where("false"), "id", "v", 6).count() == 0


def test_k_center_takes_few_rounds(spark, monkeypatch):
    """Many picks a pass, whatever the number of candidates; the same picks each time."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 5)))]
    rows += [(1000 + i, v) for i, v in rows[:50]] + [(2000, None), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    passes, plain = [], quality._farthest
    monkeypatch.setattr(quality, "_farthest", lambda *a: passes.append(1) or plain(*a))
    found = {}
    for candidates in (1, 20, 256):
        passes.clear()
        found[candidates] = [tuple(r) for r in quality.k_center(df, "id", "v", 30, candidates).orderBy("rank").collect()]
        assert len(passes) <= {1: 30, 20: 25, 256: 5}[candidates]
    assert found[1] == found[20] == found[256] and len(found[1]) == 30


def test_common_subsequences():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (["abcd"[i] for i in rng.integers(0, 4, rng.integers(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = list(row)
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        assert textmetrics.common_length(a, b) == row[-1]
