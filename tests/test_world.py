"""Scenes, names, confidence, calibration, merged answers and poses: hand-made cases, nulls, ties, repeats, empty tables."""

import math
import random

from pyspark.sql import functions as F

from loomwright.functions import objects
from loomwright.operators import dimensions, measures, motion, selection, world

ACTS = "scene string, at int, verb string, noun string, tool string"
THINGS = "scene string, name string, place int, state string"


def test_names(spark):
    rows = spark.createDataFrame([("Wooden Spoon",), ("glass pot",), ("door knob",), ("stone",), ("",), (None,)], "n string")
    got = rows.select(objects.mass(F.col("n")), objects.friction(F.col("n")), objects.affordances(F.col("n"))).collect()
    assert [tuple(r)[:2] for r in got] == [(0.05, 0.3), (0.3, 0.1), (0.5, 0.3), (0.5, 0.3), (0.5, 0.3), (0.5, 0.3)]
    assert got[0][2] == ["graspable", "pushable"]
    assert got[1][2] == ["container", "graspable", "liftable"]
    assert got[2][2] == ["closeable", "openable", "pushable", "rotatable"]
    assert got[3][2] == got[4][2] == got[5][2] == []


def test_alternatives_and_fits(spark):
    rows = spark.createDataFrame([("open", "Fridge Door"), ("pull", "door"), ("Cut", "bread knife"), ("look", "door"), (None, None)], "v string, n string")
    got = rows.select(objects.alternatives(F.col("v")), objects.outcome(F.col("v")), objects.fits(F.col("v"), F.col("n"))).collect()
    assert [r[0] for r in got] == [["close", "push", "pull"], ["push"], ["push", "pull"], ["push", "pull"], ["push", "pull"]]
    assert [r[1] for r in got] == ["reveals contents", "moves toward", "changes state", "changes state", "changes state"]
    assert [r[2] for r in got] == [True, False, True, False, False]


def brute_states(acts, things):
    """Plain loops over a scene's rows."""
    here = {}
    for s, name, place, state in things:
        if name:
            key = (place, state is not None, state or "")
            if (s, name) not in here or key < here[s, name][0]:
                here[s, name] = (key, state)
    out = {k: [v[1] or "unknown", v[1] or "unknown", 0, (0.0, 0.0, 0.0)] for k, v in here.items()}
    for s, _, verb, noun, _ in sorted(acts, key=lambda a: a[1]):
        named = sorted((here[k][0][0], k[1]) for k in here if k[0] == s and noun and k[1] in noun)
        if not named:
            continue
        row = out[s, named[0][1]]
        row[2] += 1
        row[1] = objects.STATES.get((verb or "").lower(), row[1])
        row[3] = objects.MOVES.get((verb or "").lower(), row[3])
    return sorted((*k, *v) for k, v in out.items())


def test_states_after(spark):
    dice = random.Random(5)
    verbs, names = [*objects.STATES, *objects.MOVES, "look", "OPEN", None], ["cup", "door", "up", "glass", "a", "glass cup", "", None]
    nouns = ["glass cup", "door", "cupboard", "stone", "a glass door", "", None]
    things = [(f"s{dice.randrange(6)}", dice.choice(names), dice.randrange(4), dice.choice(["open", "full", None])) for _ in range(60)]
    acts = [(f"s{dice.randrange(7)}", i, dice.choice(verbs), dice.choice(nouns), None) for i in range(120)]
    a, b = spark.createDataFrame(acts, ACTS), spark.createDataFrame(things, THINGS)
    got = world.states_after(a, b, "scene", ["at"], "verb", "noun", "name", "place", "state").collect()
    assert sorted((r["scene"], r["name"], r["before"], r["after"], r["actions"], tuple(r["velocity"])) for r in got) == brute_states(acts, things)
    assert all(r["changed"] == (r["before"] != r["after"]) for r in got)
    assert world.states_after(a.limit(0), b, "scene", ["at"], "verb", "noun", "name", "place", "state").where("changed or actions > 0").count() == 0
    assert world.states_after(a, b.limit(0), "scene", ["at"], "verb", "noun", "name", "place", "state").count() == 0


def test_a_scene_is_reduced_before_it_is_joined(spark):
    """A hot scene: 20,000 actions on one thing cost one row in the join with its names."""
    acts = spark.range(20000).select(F.lit("s").alias("scene"), F.col("id").cast("int").alias("at"), F.when(F.col("id") % 2 == 0, "open").otherwise("close").alias("verb"), F.lit("old door").alias("noun"), F.lit("").alias("tool"))
    things = spark.createDataFrame([("s", "door", 0, None)], THINGS)
    got = world.states_after(acts, things, "scene", ["at"], "verb", "noun", "name", "place", "state").collect()
    assert [(r["before"], r["after"], r["actions"]) for r in got] == [("unknown", "closed", 20000)]
    caused = world.causes(acts, things, "scene", "verb", "noun", "tool", "name").collect()
    assert sorted((r["cause"], r["effect"], r["kind"], r["actions"]) for r in caused) == [("close old door", "door state change", "action_effect", 10000), ("open old door", "door state change", "action_effect", 10000)]


def test_relations(spark):
    things = [("s", "table", 0, None), ("s", "soup bowl", 1, None), ("s", "spoon", 2, None), ("s", "spoon", 5, None), ("s", "lamp", 2, None), ("s", None, 3, None), ("t", "spoon", 0, None), ("t", "cup", 1, None), ("u", "cup", 1, None), ("u", "liquid", 1, None)]
    got = world.relations(spark.createDataFrame(things, THINGS), "scene", "name", "place").collect()
    assert sorted(map(tuple, got)) == [("s", "lamp", "supported_by", "table"), ("s", "soup bowl", "supported_by", "table"), ("s", "spoon", "contained_by", "soup bowl"), ("s", "spoon", "supported_by", "table"), ("u", "liquid", "contained_by", "cup")]


def test_causes_and_counterfactuals(spark):
    acts = spark.createDataFrame([("s", 0, "cut", "bread", "knife"), ("s", 1, "cut", "bread", "knife"), ("s", 2, "cut", "bread", ""), ("s", 3, None, "bread", "knife"), ("s", 4, "cut", None, "saw"), ("t", 5, "open", "jar", None)], ACTS)
    things = spark.createDataFrame([("s", "bread", 0, None), ("s", "bread", 1, None), ("t", "bread", 0, None)], THINGS)
    got = world.causes(acts, things, "scene", "verb", "noun", "tool", "name").collect()
    assert sorted(map(tuple, got)) == [("s", "cut bread", "bread state change", "action_effect", 3), ("s", "grasp knife", "enable cut", "enablement", 2)]
    more = world.counterfactuals(acts.where("scene = 't'"), "verb", "noun", ["at"]).orderBy("place").collect()
    assert [tuple(r) for r in more] == [(5, 0, "close jar", "the jar covers contents", "open jar"), (5, 1, "push jar", "the jar moves away", "open jar"), (5, 2, "pull jar", "the jar moves toward", "open jar")]


def test_set_and_sequence_scores(spark):
    truth = spark.createDataFrame([(1, 0, "A"), (1, 1, " b"), (1, 2, "b"), (2, 0, "x"), (3, 0, None)], "k int, p int, v string")
    said = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (4, 0, "x"), (3, 0, None)], "k int, p int, v string")
    got = {r["k"]: tuple(r)[1:] for r in world.set_scores(truth, said, "k", "v").collect()}
    assert got == {1: (2, 2, 1, 0.5, 0.5, 0.5), 2: (1, 0, 0, 0.0, 0.0, 0.0), 3: (0, 0, 0, 0.0, 0.0, 0.0), 4: (0, 1, 0, 0.0, 0.0, 0.0)}
    assert tuple(world.sequence_scores(truth, said, "k", "p", "v").first()) == (4, 1, 3, 2, 0.25, 0.666667)
    assert tuple(world.sequence_scores(truth.limit(0), said.limit(0), "k", "p", "v").first()) == (0, 0, 0, 0, 0.0, 0.0)


def test_dimensions(spark):
    rows = spark.createDataFrame([("a", "cut", "knife", 1.0, "arm", "close"), ("a", "look", "sky", None, None, "close"), ("b", None, None, None, None, None)], "item string, v string, n string, p double, e string, g string")
    assert sorted(map(tuple, dimensions.affordance(rows, "item", "v", "n", "p").collect())) == [("a", 2, 0.5, 0.5, 0.7), ("b", 0, 0.0, 0.0, 0.5)]
    assert sorted(map(tuple, dimensions.robotic_usefulness(rows, "item", "v", "p", "e", "g").collect())) == [("a", 2, 0.5, 0.5, 0.5, 0.5, 0.6), ("b", 0, 0.0, 0.0, 0.0, 0.0, 0.3)]
    rows = [("a", 1, 2, 1, 1, 0.2, {}), ("a", 2, None, 0, None, 0.2, {}), ("b", None, 5, 5, 5, None, {"other": 1.0}), ("c", 1, 0, 0, 0, 0.9, {"parse_confidence": 1.5}), ("d", 1, 1, 1, 0, None, None)]
    rows = spark.createDataFrame(rows, "item string, s int, a int, t int, x int, q double, m map<string,double>")
    got = {r["item"]: tuple(r)[1:] for r in dimensions.confidences(rows, "item", "s", "a", "t", "x", "q", "m").collect()}
    assert got == {"a": (2, 0.5, 0.8), "b": (0, 0.5, 0.0), "c": (1, 1.0, 0.4), "d": (1, 1.0, 0.6)}


def test_calibration(spark):
    dice = random.Random(3)
    rows = [("g", dice.choice([0.0, 1.0, 0.95, 0.31, 0.39, 0.62]), dice.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("g", None, True)], "g string, c double, r boolean")
    cells = {}
    for _, c, r in rows:
        cells.setdefault(min(int(c * 10), 9), []).append((c, r))
    gaps = {b: (len(x), abs(sum(c for c, _ in x) - sum(r for _, r in x)) / len(x)) for b, x in cells.items()}
    held = [(min(max(c, 1e-10), 1 - 1e-10), c, r) for _, c, r in rows]
    want = (200, sum(n * g for n, g in gaps.values()) / 200, max(g for _, g in gaps.values()), -sum(math.log(k if r else 1 - k) for k, _, r in held) / 200, sum((c - r) ** 2 for _, c, r in held) / 200)
    got = measures.calibration_report(df, "g", F.col("c"), F.col("r")).first()
    assert all(abs(a - b) < 2e-6 for a, b in zip(tuple(got)[1:], want, strict=True))
    bins = {r["bin"]: r for r in measures.reliability(df, "g", F.col("c"), F.col("r")).collect()}
    assert sorted(bins) == list(range(10)) and {b: r["rows"] for b, r in bins.items() if r["rows"]} == {b: n for b, (n, _) in gaps.items()}
    assert (bins[4]["confidence"], bins[4]["accuracy"]) == (0.45, 0.0)
    assert measures.reliability(df.limit(0), "g", F.col("c"), F.col("r")).count() == 0


def test_merged_answers(spark):
    rows = [("a", "x", 0.95, 0), ("a", "y", 0.94, 1), ("b", "x", 0.8, 1), ("b", "y", 0.8, 0), ("c", "x", 0.8, 0), ("c", "y", 0.5, 1), ("d", "x", None, 0), ("d", "y", 0.1, 1), ("e", None, None, None)]
    got = {r["item"]: (r["merged"], r["answer"]) for r in selection.merged_answers(spark.createDataFrame(rows, "item string, v string, c double, o int"), "item", "v", "c", "o").collect()}
    assert got == {"a": (False, "x"), "b": (True, "y\n\n[Additional perspective]: x"), "c": (False, "x"), "d": (False, "y"), "e": (False, None)}


def test_threshold_for(spark):
    levels = spark.createDataFrame([(0, 0.1, 0.6, 1.0, 0.6), (1, 0.2, 0.8, 0.7, 0.56), (2, 0.3, 0.8, 0.7, 0.56), (3, 0.4, 0.9, 0.2, 0.18)], "step int, threshold double, accuracy double, coverage double, expected_accuracy double")
    pick = lambda **k: [(r["step"], r["met"]) for r in selection.threshold_for(levels, **k).collect()]
    assert pick() == [(0, True)]
    assert pick(accuracy=0.7) == pick(accuracy=0.8, fallback=0.3) == [(1, True)]
    assert pick(accuracy=0.85) == [(3, True)]
    assert pick(accuracy=0.85, fallback=0.5) == [(0, False)]
    assert selection.threshold_for(levels.limit(0)).count() == 0


def test_poses(spark):
    half = math.sqrt(0.5)
    rows = [("a", 0.0, 0, 0.0, [0.0, 0.0, 0.0, 2.0]), ("a", 10.0, 1, 4.0, [0.0, 0.0, -half, -half]), ("a", None, 2, 4.0, None), ("b", 5.0, 0, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, s double, i int, x double, q array<double>")
    got = {(r["k"], r["at"]): (*r["position"], *r["orientation"]) for r in motion.poses_at(df, "k", "s", "i", ["x"], "q", [-1.0, 5.0, 10.0, 99.0]).collect()}
    close = lambda a, b: all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    assert close(got["a", -1.0], (0, 0, 0, 0, 1))
    assert close(got["a", 5.0], (2, 0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)))
    assert close(got["a", 10.0], (4, 0, 0, -half, -half)) and close(got["a", 99.0], got["a", 10.0])
    assert all(close(got["b", t], (1, 0, 0, 0, 1)) for t in (-1.0, 5.0, 10.0, 99.0))
