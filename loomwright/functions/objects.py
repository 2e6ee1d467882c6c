"""What is known of a thing by its name, and of an action by its verb: tables of words, read as expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, estimates and names that results depend on.
AFFORDANCES = {
    ("cup", "mug", "glass", "bottle", "container"): ("graspable", "liftable", "container"),
    ("drawer", "door", "lid", "cap"): ("openable", "closeable"),
    ("spoon", "fork", "knife", "tool"): ("graspable", "pushable"),
    ("pot", "pan", "plate", "bowl"): ("graspable", "liftable"),
    ("button", "knob", "switch"): ("pushable", "rotatable"),
}
MASSES = {"spoon": 0.05, "fork": 0.05, "knife": 0.08, "cup": 0.3, "mug": 0.4, "glass": 0.3, "plate": 0.5, "bowl": 0.4, "bottle": 0.5, "pot": 1.0, "pan": 1.2, "book": 0.5, "phone": 0.2}
MASS = 0.5
FRICTIONS = {"glass": 0.1, "ceramic": 0.1, "smooth": 0.1, "wood": 0.3, "plastic": 0.3, "rubber": 0.7, "grip": 0.7, "fabric": 0.5, "cloth": 0.5}
FRICTION = 0.3
CONTAINERS, CONTENTS = ("cup", "bowl", "pot", "pan"), ("spoon", "fork", "liquid", "food")
SUPPORTS = ("table", "counter", "surface")
STATES = {
    "open": "open", "unlock": "open", "close": "closed", "lock": "closed", "shut": "closed", "fill": "full", "pour": "full", "empty": "empty", "drain": "empty", "clear": "empty",
    "turn_on": "on", "activate": "on", "start": "on", "turn_off": "off", "deactivate": "off", "stop": "off",
}
MOVES = {"push": (0.1, 0.0, 0.0), "move": (0.1, 0.0, 0.0), "slide": (0.1, 0.0, 0.0), "lift": (0.0, 0.1, 0.0), "pick_up": (0.0, 0.1, 0.0), "raise": (0.0, 0.1, 0.0)}
OPPOSITES = (("push", "pull"), ("lift", "lower"), ("open", "close"), ("fill", "empty"), ("turn_on", "turn_off"))
OUTCOMES = {
    "push": "moves away", "pull": "moves toward", "lift": "rises up", "place": "is set down", "open": "reveals contents", "close": "covers contents", "pour": "empties contents", "fill": "contains liquid",
}
OUTCOME = "changes state"
FITTING = {
    "cut": ("knife", "scissors", "blade"),
    "pour": ("cup", "glass", "bottle", "container"),
    "stir": ("spoon", "fork", "chopstick", "whisk"),
    "open": ("door", "fridge", "drawer", "cabinet", "container", "bottle"),
    "close": ("door", "fridge", "drawer", "cabinet", "container", "bottle"),
    "pick": ("object", "item", "fruit", "vegetable", "tool"),
    "place": ("table", "counter", "shelf", "surface"),
}
MANIPULATION = ("pick", "place", "grasp", "release", "push", "pull", "lift", "lower", "rotate", "turn", "open", "close", "pour", "stir", "cut", "wipe", "insert", "remove")


def has_any(name: Column, words: Iterable[str]) -> Column:
    """Whether the name, in small letters, holds one of the words anywhere; false for a null."""
    return F.coalesce(F.lower(name).rlike("|".join(words)), F.lit(False))


def first_known(name: Column, table: Mapping[str, float], otherwise: float) -> Column:
    """The value of the table's first word that the name holds, else `otherwise` (also for a null)."""
    known = [F.when(has_any(name, (word,)), F.lit(value)) for word, value in table.items()]
    return F.coalesce(*known, F.lit(otherwise))


def mass(name: Column) -> Column:
    """Kilograms by name."""
    return first_known(name, MASSES, MASS)


def friction(name: Column) -> Column:
    """Coefficient of friction by name."""
    return first_known(name, FRICTIONS, FRICTION)


def affordances(name: Column) -> Column:
    """What can be done with a thing, sorted and without repeats; empty for an unknown or null name."""
    none = F.array().cast("array<string>")
    found = [F.when(has_any(name, words), F.array(*map(F.lit, gives))).otherwise(none) for words, gives in AFFORDANCES.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def state_of(verb: Column) -> Column:
    """The state that an action leaves its target in; null if none."""
    return F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))[F.lower(verb)]


def velocity_of(verb: Column) -> Column:
    """The velocity (x, y, z) that an action gives its target; null if none."""
    return F.create_map(*(x for verb_, v in MOVES.items() for x in (F.lit(verb_), F.array(*map(F.lit, v)))))[F.lower(verb)]


def fits(verb: Column, noun: Column) -> Column:
    """Whether the noun is one that the verb is commonly done to or with; false for other verbs and nulls."""
    said = F.lower(verb)
    cases = [(said == v) & has_any(noun, words) for v, words in FITTING.items()]
    out = cases[0]
    for case in cases[1:]:
        out = out | case
    return F.coalesce(out, F.lit(False))


def alternatives(verb: Column, most: int = 3) -> Column:
    """Verbs that could have been done instead: the opposite, then push and pull for verbs that are neither; `most` at most.

    A verb's words are compared as they are written; a null verb has push and pull.
    """
    other = [F.when(verb == a, F.lit(b)) for pair in OPPOSITES for a, b in (pair, pair[::-1])]
    free = ~F.coalesce(verb.isin("push", "pull"), F.lit(False))
    return F.slice(F.array_compact(F.array(F.coalesce(*other), *(F.when(free, F.lit(v)) for v in ("push", "pull")))), 1, most)


def outcome(verb: Column) -> Column:
    """What a verb does to its noun, in words."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))[verb], F.lit(OUTCOME))
