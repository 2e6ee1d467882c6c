"""Scenes with things and actions: which thing an action is done to, states left behind, relations, causes, alternatives.

An action is done to a thing if its noun holds the thing's name. Nouns and
names meet once for each distinct noun, not once for each action, and a
scene's things are found by name: no scene's actions and things are paired.
Null or empty names are no things, null nouns hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import objects


def names_within(nouns: DataFrame, noun: str, things: DataFrame, name: str) -> DataFrame:
    """Each distinct noun with each distinct name that is a part of it, letter by letter.

    A noun's parts are cut at the lengths that names have, so the rows
    between are (letters of distinct nouns) times (different lengths).
    """
    names = things.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct()
    lengths = names.agg(F.collect_set(F.length("_name")).alias("_lengths"))  # one row
    each = nouns.select(F.col(noun).alias("_noun")).where(F.length("_noun") > 0).distinct().join(lengths)
    cut = each.select("_noun", F.explode("_lengths").alias("_l")).where(F.col("_l") <= F.length("_noun"))
    parts = cut.select("_noun", "_l", F.explode(F.sequence(F.lit(1), F.length("_noun") - F.col("_l") + 1)).alias("_i")).select("_noun", F.substring(F.col("_noun"), F.col("_i"), F.col("_l")).alias("_name"))
    return parts.distinct().join(names, "_name").select("_noun", "_name")


def _scene_things(things: DataFrame, scene: str, name: str, place: str, state: str) -> DataFrame:
    rows = things.where(F.length(name) > 0).select(F.col(scene).alias("_scene"), F.col(name).alias("_name"), F.struct(F.col(place).alias("at"), F.col(state).alias("state")).alias("_row"))
    return rows.groupBy("_scene", "_name").agg(F.min("_row").alias("_row"))


def states_after(actions: DataFrame, things: DataFrame, scene: str, order: list[str], verb: str, noun: str, name: str, place: str, state: str) -> DataFrame:
    """Each thing of a scene with its state before and after all of the scene's actions, whether it changed, its actions and its last velocity.

    Of several things that a noun names, the one with the lowest place is
    meant (ties: by name). The last action, by `order`, that has an effect
    decides; of actions at the same place in order, the larger effect. A
    thing that is given several times has its first row's state; null is
    "unknown". Scenes are reduced to a row for each noun before they are
    joined, so a scene of many actions costs no more than its nouns.
    """
    at = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    put, moved = objects.state_of(F.col(verb)), objects.velocity_of(F.col(verb))
    last = lambda found: F.max(F.when(found.isNotNull(), F.struct(*at, found.alias("to"))))
    done = actions.groupBy(F.col(scene).alias("_scene"), F.col(noun).alias("_noun")).agg(F.count("*").alias("_n"), last(put).alias("_put"), last(moved).alias("_moved"))
    here = _scene_things(things, scene, name, place, state)
    found = done.join(names_within(actions, noun, things, name), "_noun").join(here, ["_scene", "_name"])
    meant = found.groupBy("_scene", "_noun").agg(F.min(F.struct(F.col("_row.at").alias("at"), F.col("_name").alias("name"))).alias("_t"), *(F.max(c).alias(c) for c in ("_n", "_put", "_moved")))
    hit = meant.groupBy("_scene", F.col("_t.name").alias("_name")).agg(F.sum("_n").alias("_n"), F.max("_put").alias("_put"), F.max("_moved").alias("_moved"))
    before = F.coalesce(F.col("_row.state"), F.lit("unknown"))
    after = F.coalesce(F.col("_put.to"), before)
    still = F.array(*map(F.lit, (0.0, 0.0, 0.0)))
    return here.join(hit, ["_scene", "_name"], "left").select(
        F.col("_scene").alias(scene), F.col("_name").alias(name), before.alias("before"), after.alias("after"), (before != after).alias("changed"),
        F.coalesce("_n", F.lit(0)).alias("actions"), F.coalesce(F.col("_moved.to"), still).alias("velocity"))


def relations(things: DataFrame, scene: str, name: str, place: str) -> DataFrame:
    """What is contained by or supported by what in a scene, by names: the holder comes first in order of place (ties: by name).

    Things are told apart by name, so a scene has at most its different
    names; only holders meet others, and each pair has one relation.
    """
    rows = things.where(F.length(name) > 0).groupBy(F.col(scene).alias("_scene"), F.col(name).alias("_name")).agg(F.min(place).alias("_at"))
    key = F.struct("_at", "_name")
    kinds = rows.select("_scene", key.alias("_k"), objects.has_any(F.col("_name"), objects.CONTAINERS).alias("_c"), objects.has_any(F.col("_name"), objects.SUPPORTS).alias("_s"), objects.has_any(F.col("_name"), objects.CONTENTS).alias("_in"))
    holders = kinds.where("_c or _s").select("_scene", F.col("_k").alias("_h"), "_c", "_s")
    held = kinds.select("_scene", "_k", "_in")
    kind = F.when(F.col("_c") & F.col("_in"), "contained_by").when(F.col("_s"), "supported_by")
    both = holders.join(held, "_scene").where(F.col("_h") < F.col("_k")).withColumn("relation", kind).where("relation is not null")
    return both.select(F.col("_scene").alias(scene), F.col("_k._name").alias("thing"), "relation", F.col("_h._name").alias("holder"))


def causes(actions: DataFrame, things: DataFrame, scene: str, verb: str, noun: str, instrument: str, name: str) -> DataFrame:
    """A scene's causes and effects, each once with its number of actions: actions that change things, tools that enable actions.

    An action without a verb or a noun causes nothing; a null or empty instrument enables nothing.
    """
    said = F.concat_ws(" ", verb, noun)
    acts = actions.where(F.col(verb).isNotNull() & F.col(noun).isNotNull()).select(F.col(scene).alias("_scene"), F.col(noun).alias("_noun"), F.col(verb).alias("_verb"), said.alias("_said"), F.nullif(F.col(instrument), F.lit("")).alias("_tool"))
    counted = acts.groupBy("_scene", "_noun", "_verb", "_said", "_tool").agg(F.count("*").alias("_n"))
    here = things.where(F.length(name) > 0).select(F.col(scene).alias("_scene"), F.col(name).alias("_name")).distinct()
    changed = counted.join(names_within(actions, noun, things, name), "_noun").join(here, ["_scene", "_name"])
    effect = changed.select("_scene", F.col("_said").alias("cause"), F.concat("_name", F.lit(" state change")).alias("effect"), F.lit("action_effect").alias("kind"), "_n")
    enabled = counted.where("_tool is not null").select("_scene", F.concat(F.lit("grasp "), "_tool").alias("cause"), F.concat(F.lit("enable "), "_verb").alias("effect"), F.lit("enablement").alias("kind"), "_n")
    return effect.unionByName(enabled).groupBy(F.col("_scene").alias(scene), "cause", "effect", "kind").agg(F.sum("_n").alias("actions"))


def counterfactuals(actions: DataFrame, verb: str, noun: str, keys: list[str], most: int = 3) -> DataFrame:
    """A row for each alternative to an action: its number, what if, what then, and instead of what; actions without verb or noun have none."""
    rows = actions.where(F.col(verb).isNotNull() & F.col(noun).isNotNull()).select(*keys, F.col(verb).alias("_verb"), F.col(noun).alias("_noun"))
    each = rows.select(*keys, "_verb", "_noun", F.posexplode(objects.alternatives(F.col("_verb"), most)).alias("place", "_other"))
    then = F.concat(F.lit("the "), "_noun", F.lit(" "), objects.outcome(F.col("_other")))
    return each.select(*keys, "place", F.concat_ws(" ", "_other", "_noun").alias("if"), then.alias("then"), F.concat_ws(" ", "_verb", "_noun").alias("instead_of"))


def set_scores(truth: DataFrame, said: DataFrame, case: str, value: str) -> DataFrame:
    """Precision, recall and F1 of each case's set of values (trimmed, small letters; nulls left out); 0 where a side is empty.

    Cases of either side count; repeated values count once.
    """
    clean = F.lower(F.trim(value)).alias("_value")
    sides = [d.select(case, clean, F.lit(int(d is said)).alias("_s")) for d in (truth, said)]
    seen = sides[0].unionByName(sides[1]).groupBy(case, "_value").agg(F.max(1 - F.col("_s")).alias("_t"), F.max("_s").alias("_p"))
    there = F.col("_value").isNotNull()
    n = seen.groupBy(case).agg(*(F.count_if(there & c).alias(k) for k, c in {"expected": F.col("_t") == 1, "given": F.col("_p") == 1, "hits": (F.col("_t") == 1) & (F.col("_p") == 1)}.items()))
    p, r = (F.coalesce(F.try_divide("hits", k), F.lit(0.0)) for k in ("given", "expected"))
    return n.select(case, "expected", "given", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def sequence_scores(truth: DataFrame, said: DataFrame, case: str, place: str, value: str) -> DataFrame:
    """One row: the share of cases whose sequences are equal, and of places that both have whose values are (trimmed, small letters).

    Sequences are equal if both have the same places with the same values
    as written. Places are unique within a case; nulls equal only nulls.
    """
    sides = [d.select(case, place, F.struct(F.col(value).alias("v")).alias(n)) for d, n in ((truth, "_t"), (said, "_p"))]
    both = sides[0].join(sides[1], [case, place], "full")
    shared = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    clean = lambda c: F.lower(F.trim(f"{c}.v"))
    rows = both.groupBy(case).agg(F.min((shared & F.col("_t.v").eqNullSafe(F.col("_p.v"))).cast("int")).alias("_equal"), F.count_if(shared).alias("_places"), F.count_if(shared & clean("_t").eqNullSafe(clean("_p"))).alias("_right"))
    out = rows.agg(F.count("*").alias("cases"), F.coalesce(F.sum("_equal"), F.lit(0)).alias("equal"), F.coalesce(F.sum("_places"), F.lit(0)).alias("places"), F.coalesce(F.sum("_right"), F.lit(0)).alias("right"))
    return out.select("*", F.round(F.coalesce(F.try_divide("equal", "cases"), F.lit(0.0)), 6).alias("sequence_accuracy"), F.round(F.coalesce(F.try_divide("right", "places"), F.lit(0.0)), 6).alias("action_accuracy"))
