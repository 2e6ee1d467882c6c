"""Signed marks of zero-width characters inside texts: written, read and verified by expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.nested import hmac_sha256

#: Two bits each.
ZERO_WIDTH = "​‌‍﻿"
#: Hex digits of the signature that a mark carries.
SIGNED = 16
_HEX = "0123456789ABCDEF"


def _hidden(message: Column) -> Column:
    """Bytes as zero-width characters, four for each."""
    digits = F.hex(message.cast("binary"))
    high = F.split(F.translate(digits, _HEX, "".join(ZERO_WIDTH[i // 4] for i in range(16))), "")
    low = F.split(F.translate(digits, _HEX, "".join(ZERO_WIDTH[i % 4] for i in range(16))), "")
    return F.array_join(F.zip_with(high, low, lambda a, b: F.concat(a, b)), "")


def _shown(marks: Column) -> Column:
    """The bytes that zero-width characters stand for."""
    fours = F.translate(marks, ZERO_WIDTH, "0123")
    pairs = F.filter(F.split(F.regexp_replace(fours, "(..)", "$1 "), " "), lambda p: F.length(p) == 2)
    return F.unhex(F.array_join(F.transform(pairs, lambda p: F.conv(p, 4, 16)), ""))


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")


def marked(text: Column, payload: Column, key: str) -> Column:
    """The text with the payload and its signature hidden in the middle.

    Zero-width characters that the text holds already go, so a second mark
    replaces the first. Null and empty texts stay as they are.
    """
    bare = without_marks(text)
    half = F.floor(F.length(bare) / 2).cast("int")
    mark = _hidden(F.concat(payload, F.lit(":"), F.substring(hmac_sha256(key, payload), 1, SIGNED)))
    whole = F.concat(F.substring(bare, F.lit(1), half), mark, F.substring(bare, half + 1, F.length(bare)))
    return F.when(F.length(text) > 0, whole).otherwise(text)


def read(text: Column, key: str) -> Column:
    """(payload, valid, confidence) of a text's mark, null if it holds none: valid if the signature is the payload's, else confidence is one half.

    A mark of which characters were lost has no valid signature.
    """

    def judged(said: Column) -> Column:
        size = F.length(said) - SIGNED - 1
        payload, signature = F.substring(said, F.lit(1), size), F.substring(said, size + 2, F.lit(SIGNED))
        valid = (F.substring(said, size + 1, F.lit(1)) == ":") & (signature == F.substring(hmac_sha256(key, payload), 1, SIGNED))
        return F.when(size >= 0, F.struct(payload.alias("payload"), valid.alias("valid"), F.when(valid, 1.0).otherwise(0.5).alias("confidence")))

    marks = F.array_join(F.regexp_extract_all(text, F.lit(f"[{ZERO_WIDTH}]+"), F.lit(0)), "")
    # one-element arrays bind what is read, so that it is read once
    said = F.transform(F.array(marks), lambda m: F.try_validate_utf8(_shown(m).cast("string")))
    return F.transform(said, judged)[0]
