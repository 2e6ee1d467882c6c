"""Text expressions: personal data, sanitising, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data; all run alike in Java's and RE2's regular expressions.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -][0-9]{3,4}",
}

# Further patterns of personal data, after their public formats.
MORE_PII = {
    "credit_card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "ipv6": r"[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){7}",
    "mac": r"[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}",
    "passport": r"[A-Z]{1,2}[0-9]{7,8}",
    "birth_date": r"(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])",
}


def count_of(text: Column, pattern: str) -> Column:
    """Leftmost matches of a pattern that don't overlap."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).cast("long")


def file_name(name: Column, most: int) -> Column:
    """A name of letters, digits, dots, dashes and underscores, of at most `most` characters, that begins and ends with neither dot nor underscore."""
    name = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "[.]{2,}", ".")
    return F.substring(F.trim(name, F.lit("._")), 1, most)


def pii_count(text: Column, kind: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PII[kind]), F.lit(0))).cast("long")


def redact(text: Column, mark: str = "[REDACTED]") -> Column:
    for pattern in PII.values():
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_typed(text: Column) -> Column:
    """Personal data replaced by its kind, one kind after the other."""
    for kind, pattern in PII.items():
        text = F.regexp_replace(text, pattern, f"[{kind.upper()}_REDACTED]")
    return text


def sanitize(text: Column) -> Column:
    """Trimmed, without control characters but line ends and tabs, and with HTML's special characters escaped."""
    text = F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", ""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
