"""Personal data as spans: one sweep over a text in which each character belongs to one finding at most.

Kinds are looked for in a fixed order; what a kind has claimed is out of
reach for those behind it. All patterns stand between word borders, so
digits inside longer numbers don't count.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds in the order in which they claim, by their public formats.
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
KINDS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b",
    "ssn": r"\b[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}\b",
    "credit_card": r"\b[0-9](?:[ -]?[0-9]){12,15}\b",
    "ip_address": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b|\b[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}\b",
    "mac_address": r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b",
    "url": r"https?://[^\s\"<>{}|^`\[\]\\\x01]+",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
    "date_of_birth": rf"\b{_MONTH}[/-]{_DAY}[/-]{_YEAR}\b|\b{_YEAR}[/-]{_MONTH}[/-]{_DAY}\b",
}
# How sure a finding is; numbers also by their digits.
SURE = {"email": 0.95, "phone": 0.9, "ssn": 0.95, "credit_card": 0.9, "ip_address": 0.85}
UNSURE = {"phone": 0.6, "credit_card": 0.5}
#: Characters of context on each side.
CONTEXT = 20
#: Stands for a claimed character; no pattern has it.
CLAIMED = "\x01"
SPAN = "struct<kind: string, start: int, end: int, value: string, confidence: double, context: string>"
_COMPILED = {kind: re.compile(p, re.ASCII) for kind, p in KINDS.items()}
#: Every finding has one of these.
_HINT = re.compile(r"[0-9@]|https?://", re.ASCII)


def luhn(digits: str) -> bool:
    """The checksum of card numbers: from the right, every second digit doubled and its digits added."""
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v // 10 + v % 10 for v in values) % 10 == 0


def confidence(kind: str, value: str) -> float:
    digits = re.sub("[^0-9]", "", value)
    if kind == "credit_card" and not luhn(digits) or kind == "phone" and len(digits) < 10:
        return UNSURE[kind]
    return SURE.get(kind, 1.0)


def find(text: str | None, kinds: tuple[str, ...] = tuple(KINDS)) -> list[tuple]:
    """(kind, start, end, value, confidence, context) by start; positions count characters, end exclusive."""
    if not text or not _HINT.search(text):
        return []
    left, found = text, []
    for kind in (k for k in KINDS if k in kinds):
        spans = [m.span() for m in _COMPILED[kind].finditer(left)]
        if not spans:
            continue
        parts, at = [], 0
        for start, end in spans:
            parts += [left[at:start], CLAIMED * (end - start)]
            at = end
            found.append((kind, start, end, text[start:end], confidence(kind, text[start:end]), text[max(0, start - CONTEXT) : end + CONTEXT]))
        left = "".join([*parts, left[at:]])
    return sorted(found, key=lambda f: f[1])


def spans(text: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """The findings of each text; none for null and empty texts. A text that has CLAIMED in it is searched like others."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([find(t, kinds) for t in texts])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, f"array<{SPAN}>")(text)


def redacted(text: Column, found: Column, mark: Column | None = None, least: float = 0.0) -> Column:
    """The text with each span replaced by `mark` (default: its kind); spans below the confidence stay."""
    hits = F.filter(found, lambda s: s["confidence"] >= least)
    starts = F.concat(F.array(F.lit(0)), F.transform(hits, lambda s: s["end"]))
    ends = F.concat(F.transform(hits, lambda s: s["start"]), F.array(F.length(text)))
    between = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    marks = F.concat(F.transform(hits, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("_REDACTED]")) if mark is None else mark), F.array(F.lit("")))
    return F.when(F.size(hits) == 0, text).otherwise(F.array_join(F.zip_with(between, marks, lambda t, m: F.concat(t, m)), ""))
