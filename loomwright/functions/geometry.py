"""Measures of boxes, vectors and motion, and estimates of cost and time, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def extent(low: list[Column], high: list[Column]) -> Column:
    """Area or volume of a box; a side that ends before it starts counts as 0."""
    return reduce(lambda a, b: a * b, [F.greatest(F.lit(0.0), h - x) for x, h in zip(low, high, strict=True)])


def magnitude(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def direction(parts: list[Column], least: float = 1e-6) -> Column:
    """The vector at length one; straight up, (0, ..., 0, 1), where it is shorter than `least`."""
    size = magnitude(parts)
    up = [0.0] * (len(parts) - 1) + [1.0]
    return F.array(*(F.when(size <= least, u).otherwise(p / size) for p, u in zip(parts, up, strict=True)))


def complexity(factors: list[tuple[Column, float]]) -> Column:
    """Mean of factors, each divided by what counts as full and at most 1."""
    shares = [F.least(F.lit(1.0), c / full) for c, full in factors]
    return reduce(lambda a, b: a + b, shares) / len(shares)
