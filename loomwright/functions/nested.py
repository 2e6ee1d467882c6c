"""Rewrites of documents of any nesting by one expression that is built from the schema."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: What a rewrite gets: the leaf and its dotted path; None leaves it as it is.
Rewrite = Callable[[Column, str], Column | None]


def rewritten(value: Column, kind: DataType, rewrite: Rewrite, path: str = "") -> Column:
    """The value with rewrite(leaf, path) at each string leaf.

    Steps into arrays don't add to a path; values of maps have the path of
    the map and `*`, keys stay. Nulls on the way stay null, nulls at leaves
    are given to the rewrite.
    """
    if isinstance(kind, StructType):
        fields = [rewritten(value[f.name], f.dataType, rewrite, f"{path}.{f.name}".lstrip(".")).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, rewrite, path)) if _has_text(kind) else value
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: rewritten(v, kind.valueType, rewrite, f"{path}.*")) if _has_text(kind.valueType) else value
    if isinstance(kind, StringType):
        new = rewrite(value, path)
        return value if new is None else new
    return value


def _has_text(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _has_text(kind.elementType)
    return _has_text(kind.valueType) if isinstance(kind, MapType) else isinstance(kind, StringType)


def rewrite_all(df: DataFrame, rewrite: Rewrite) -> DataFrame:
    """Every string leaf of every column; other columns and leaves as they are."""
    return df.select(*[rewritten(F.col(f"`{f.name}`"), f.dataType, rewrite, f.name).alias(f.name) for f in df.schema.fields])


def leaves(value: Column, kind: DataType, path: str = "") -> Column | None:
    """All string leaves as an array of (path, text), in the order of the schema; nulls are left out."""
    pair = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("text"))
    if isinstance(kind, StringType):
        return F.array_compact(F.array(F.when(value.isNotNull(), pair(path, value))))
    none = F.array().cast("array<struct<path: string, text: string>>")
    if isinstance(kind, StructType):
        parts = [leaves(value[f.name], f.dataType, f"{path}.{f.name}".lstrip(".")) for f in kind.fields]
        parts = [F.coalesce(p, none) for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, ArrayType) and _has_text(kind):
        return F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: F.coalesce(leaves(x, kind.elementType, path), none)))
    if isinstance(kind, MapType) and _has_text(kind.valueType):
        return F.flatten(F.transform(F.map_values(F.coalesce(value, F.create_map().cast(kind))), lambda x: F.coalesce(leaves(x, kind.valueType, f"{path}.*"), none)))
    return None


def masked(paths: list[str], mask: str = "[MASKED]") -> Rewrite:
    """A rewrite that overwrites the leaves at the dotted paths; nulls too."""
    wanted = set(paths)
    return lambda leaf, path: F.lit(mask) if path in wanted else None


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 (RFC 2104) of a text or bytes as lower-case hex digits; null for null."""
    given = key.encode()
    padded = (hashlib.sha256(given).digest() if len(given) > 64 else given).ljust(64, b"\0")
    pad = lambda by: F.unhex(F.lit(bytes(b ^ by for b in padded).hex()))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def keyed_digest(value: Column, key: str, length: int = 16) -> Column:
    """The first hex digits of a text's keyed digest, as a name that can't be guessed from the text alone."""
    return F.substring(hmac_sha256(key, value), 1, length)
