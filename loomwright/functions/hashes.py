"""Digests as identities and as features: names for values, distances, hashed character trigrams, hidden characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zero-width characters that hide marks in a text.
HIDDEN = "[\\u200b\\u200c\\u200d\\ufeff]"


def token(value: Column, salt: str, size: int = 16) -> Column:
    """A name for a value: the first hexadecimal digits of its salted SHA-256."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256), 1, size)


def bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal digests of 15 digits at most."""
    return F.bit_count(F.conv(a, 16, 10).cast("long").bitwiseXOR(F.conv(b, 16, 10).cast("long")))


def digits_apart(a: Column, b: Column) -> Column:
    """Differing characters of two digests, null if their lengths differ."""
    both = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.when(F.length(a) == F.length(b), F.size(F.filter(both, lambda p: p["x"] != p["y"])))


def trigram_features(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, dim, value): lower-cased character trigrams counted by their MD5 modulo dims (16^6 at most, a power of two), scaled to length one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(low) > 2, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    rows = df.select(key, F.explode(F.transform(starts, lambda i: F.substring(low, i, F.lit(3)))).alias("g"))
    dim = F.pmod(F.conv(F.substring(F.md5("g"), 27, 6), 16, 10).cast("int"), F.lit(dims))
    counts = rows.groupBy(key, dim.alias("dim")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return counts.join(sizes, key).select(key, "dim", (F.col("n") / F.col("size")).alias("value"))


def without_hidden(text: Column) -> Column:
    return F.regexp_replace(text, HIDDEN, "")
