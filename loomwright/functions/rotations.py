"""Rotations as unit quaternions: arrays of four doubles (x, y, z, w)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this cosine two rotations are mixed in a straight line, as their angle is too small to divide by.
NEAR = 0.9995
#: Cosines this close to 0 are 180 degrees.
TURN = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column) -> Column:
    """The quaternion of length one; no rotation for a null, a zero one or one with a null."""
    size = F.sqrt(dot(a, a))
    none = F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    return F.when(size > 0, scaled(a, 1 / size)).otherwise(none)


def between(a: Column, b: Column, share: Column) -> Column:
    """The rotation `share` of the shortest way from a to b (slerp); both are made unit first.

    b and -b are one rotation: the nearer is taken. Opposite rotations (180
    degrees apart) go by b as it is given.
    """

    def mixed(both: Column) -> Column:
        p, q, cosine = both["p"], both["q"], both["c"]
        angle = F.acos(F.least(F.lit(1.0), cosine))
        straight = F.zip_with(p, q, lambda x, y: x + share * (y - x))
        weight = lambda t: F.sin(t * angle) / F.sin(angle)
        curved = F.zip_with(scaled(p, weight(1 - share)), scaled(q, weight(share)), lambda x, y: x + y)
        return unit(F.when(cosine > NEAR, straight).otherwise(curved))

    def turned(pair: Column) -> Column:
        c = dot(pair["p"], pair["q"])
        return F.struct(pair["p"].alias("p"), F.when(c < -TURN, scaled(pair["q"], F.lit(-1.0))).otherwise(pair["q"]).alias("q"), F.abs(c).alias("c"))

    pair = F.array(F.struct(unit(a).alias("p"), unit(b).alias("q")))
    return F.transform(F.transform(pair, turned), mixed)[0]


def angle(a: Column, b: Column) -> Column:
    """The angle in radians between two rotations, at most pi."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(unit(a), unit(b)))))
