"""Word stems by Porter's algorithm (1980), for distinct words in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Porter's suffixes and what replaces them, in the order in which they are tried.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_WORD = re.compile("[a-z]{3,}")
_RUNS = re.compile("v+c")


def _shape(word: str) -> str:
    """The word as v and c; a y behind a consonant is a vowel."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out[-1:] == "c" else "c"
    return out


def measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(_RUNS.findall(re.sub("c+", "c", _shape(word))))


def _vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double(word: str) -> bool:
    return word[-2:-1] == word[-1:] and _shape(word)[-1:] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words under three letters or with other characters stay."""
    if not _WORD.fullmatch(word):
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        end = _longest(word, ("ed", "ing"))
        if end and _vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _longest(word, table)
        if end and measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP4)
    if end and measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stemmed(words: Column) -> Column:
    """The stems of an array of words; each distinct word of a batch is worked out once."""

    def run(lists: pd.Series) -> pd.Series:
        known = {w: stem(w) for w in {w for ws in lists if ws is not None for w in ws}}
        return lists.map(lambda ws: None if ws is None else [known[w] for w in ws])

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(words)
