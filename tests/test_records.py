"""Paths, contacts, nested records, parsed outputs and reports on rows made by hand and against plain Python."""

import hashlib
import itertools
import json
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from loomwright.functions import geometry, hashes, parsing
from loomwright.operators import dimensions, motion, records, reports


def test_path_and_points(spark):
    rows = spark.createDataFrame([("a", 0.0, 1, 0.0), ("a", 10.0, 2, 3.0), ("a", 20.0, 3, 1.0), ("b", 5.0, 4, 7.0), ("b", 6.0, 5, None)], "k string, at double, id int, x double")
    found = {r.k: (r.points, r.length, r.direct) for r in motion.path_length(rows, "k", ["at", "id"], ["x"]).collect()}
    assert found == {"a": (3, 5.0, 1.0), "b": (1, 0.0, 0.0)}
    found = {(r.k, r["at"]): r.value for r in motion.points_at(rows, "k", "at", "id", "x", [-1.0, 5.0, 10.0, 15.0, 99.0]).collect()}
    assert [found["a", x] for x in (-1.0, 5.0, 10.0, 15.0, 99.0)] == [0.0, 1.5, 3.0, 2.0, 1.0] and found["b", 99.0] == 7.0


def test_contact_scores_by_brute_force(spark):
    draw = random.Random(0)
    made = [(draw.choice("xy"), round(draw.uniform(0, 60), 2)) for _ in range(300)] + [("x", 2.0 * i) for i in range(20)]
    truth, said = made[::2], made[1::2] + [("z", 1.0)]
    near = lambda a, rows: any(a[0] == b[0] and abs(a[1] - b[1]) <= 0.25 for b in rows)
    right, found = sum(near(a, truth) for a in said), sum(near(a, said) for a in truth)
    got = motion.contact_scores(*(spark.createDataFrame(x, "k string, at double") for x in (truth, said)), ["k"], "at", 0.25).first()
    assert (got.said, got.right, got.real, got.found) == (len(said), right, len(truth), found)
    none = motion.contact_scores(*(spark.createDataFrame([], "k string, at double") for _ in "ab"), ["k"], "at", 0.25).first()
    assert (none.said, none.precision, none.recall, none.f1) == (0, 0.0, 0.0, 0.0)


def test_nested(spark):
    rows = spark.sql("SELECT 1 AS id, array(named_struct('k', 'a', 'n', 2, 'more', array(1, 2)), named_struct('k', 'b', 'n', 5, 'more', null), named_struct('k', null, 'n', 5, 'more', array(3))) AS x UNION ALL SELECT 2, null UNION ALL SELECT 3, array()")
    got = rows.select("id", F.size(records.of_kind(F.col("x"), "k", ["a", "b"])).alias("n"), records.inner(F.col("x"), "more").alias("m"), records.largest(F.col("x"), "n")["k"].alias("k")).orderBy("id").collect()
    assert [(r.n, r.m, r.k) for r in got] == [(2, [1, 2, 3], "b"), (0, None, None), (0, [], None)]


def test_positions_integrity_votes(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c")], "k int, p int, v string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "d"), (2, 0, "e")], "k int, p int, v string")
    got = {r.k: r[1:] for r in records.by_position(old, new, "k", "p", "v").collect()}
    assert got == {1: (1, 1, 1, 1), 2: (1, 0, 0, 0)}
    store, index = (spark.createDataFrame(x, "id int, d string") for x in ([(1, "a"), (2, "b"), (3, None)], [(1, "a"), (2, "x"), (4, "y")]))
    assert {r.id: r.problem for r in records.integrity(store, index, "id", "d").collect()} == {2: "differs", 3: "not indexed", 4: "not stored"}
    votes = spark.createDataFrame([(1, 0, "x", 0.1), (1, 1, "y", 0.9), (1, 2, None, 0.9), (2, 0, None, 1.0)], "k int, i int, v string, w double")
    assert [tuple(r) for r in records.majority(votes, "k", "i", "v", "w").collect()] == [(1, 2, "x", 0.5, "y")]


def test_parsed_outputs(spark):
    many = json.dumps({"description": "d", "objects": [f"o{i}" for i in range(30)], "steps": [{"action": "a"}] * 9, "qa_pairs": [{"question": "q"}], "hand_actions": [{"action": "lift it", "target": "cup"}]})
    made = ["", None, "  ", "plain words", '{"caption": "c"}', many, "[1, 2]", "x {broken", "Description: a room\n with light\nActions:\n1. open door\n- wait\nObjects: cup, , - pan", "see scene: "]
    got = [r.p for r in spark.createDataFrame(list(enumerate(made)), "id int, text string").select("id", parsing.parsed(F.col("text")).alias("p")).orderBy("id").collect()]
    assert [p.method for p in got] == ["empty_input"] * 3 + ["plain_text", "json_block", "json_block", "plain_text", "plain_text", "structured_text", "structured_text"]
    assert (got[4].description, got[4].confidence) == ("c", 0.3)
    assert (len(got[5].objects), got[5].n_qa, got[5].actions, got[5].confidence) == (20, 6, ["lift cup"], 1.0)
    assert (got[8].description, got[8].actions, got[8].objects, got[8].confidence) == ("a room\n with light", ["open door", "wait"], ["cup", "pan"], 0.5)
    assert got[9].confidence == 0.3


def test_trigrams_and_digests(spark):
    texts = ["Abcabcab", "ab", None, "日本語のテキスト"]
    got = hashes.trigram_features(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    for i, text in enumerate(texts):
        low = (text or "").lower()
        counts = Counter(int(hashlib.md5(low[j : j + 3].encode()).hexdigest(), 16) % 64 for j in range(len(low) - 2))
        size = math.sqrt(sum(n * n for n in counts.values()))
        assert {r.dim: round(r.value, 9) for r in got if r.id == i} == {d: round(n / size, 9) for d, n in counts.items()}
    rows = spark.createDataFrame([("00ff", "00fe"), ("ab", "abc")], "a string, b string")
    got = rows.select(hashes.bits_apart(F.col("a"), F.col("b")).alias("bits"), hashes.digits_apart(F.col("a"), F.col("b")).alias("digits")).collect()
    assert (got[0].bits, got[0].digits, got[1].digits) == (1, 1, None)
    assert spark.range(1).select(hashes.token(F.lit("v"), "s").alias("t")).first().t == hashlib.sha256(b"s:v").hexdigest()[:16]


def test_reports(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(25)] + [("b", 0, None)], "k string, i int, v double")
    assert [r.i for r in reports.thinned(rows.where("k = 'a'"), "k", ["i"], 10).orderBy("i").collect()] == list(range(0, 20, 2))
    assert [tuple(r) for r in reports.last_window(rows, "k", ["i"], "v", 4, 23.0).collect()] == [("a", 4, 22.5, 21.0, 24.0, 0.5)]
    steps = reports.state_sequence(rows.where("k = 'b'").withColumn("s", F.lit("x")), "k", ["i"], "s").orderBy("place").collect()
    assert [(r.place, r.state) for r in steps] == [(0, "initial"), (1, "x")]
    moved = spark.createDataFrame([("m", late, float(i + 100 * late)) for i, late in itertools.product(range(50), (False, True))] + [("few", False, 1.0), ("few", True, 9.0)], "k string, late boolean, v double")
    got = {r.k: (r.n_current, r.ks_drift, r.psi_drift) for r in reports.drift(moved, "k", "v", F.col("late")).collect()}
    assert got == {"m": (50, True, True), "few": (1, False, False)}


def test_dimensions_and_geometry(spark):
    rows = spark.createDataFrame([(1, "Cut the apple", "cut", "apple"), (1, "then rest", None, None), (2, None, None, None)], "id int, c string, v string, o string")
    got = {r.id: (r.verbs, r.things, r.issues, r.score) for r in dimensions.factuality(rows, "id", "c", "v", "o").collect()}
    assert got == {1: (0.5, 0.5, 0, 0.7), 2: (0.0, 0.0, 3, 0.2)}
    d = spark.range(1).select(geometry.direction([F.lit(0.0), F.lit(0.0), F.lit(0.0)]).alias("up"), geometry.direction([F.lit(3.0), F.lit(0.0), F.lit(4.0)]).alias("d")).first()
    assert d.up == [0.0, 0.0, 1.0] and d.d == [0.6, 0.0, 0.8]
