"""Tail probabilities of the t and Kolmogorov distributions, in Arrow batches, and tests that use them.

Only a few numbers of each group come here: sums are made by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7, of the logarithm of the gamma function.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fraction; it has settled long before in the branch that is used.
STEPS = 300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0."""
    small = x < 0.5
    y = np.where(small, 1 - x, x) - 1
    base = y + 7.5
    total = LANCZOS[0] + sum(c / (y + i) for i, c in enumerate(LANCZOS[1:], 1))
    value = 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(base) - base + np.log(total)
    return np.where(small, np.log(np.pi / np.maximum(np.sin(np.pi * x), 1e-300)) - value, value)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz' method."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = out
        for part in (even, odd):
            d, c = 1 / safe(1 + part * d), safe(1 + part / c)
            out = out * d * c
        if np.all(np.abs(out - before) <= 1e-15 * np.abs(out)):
            break
    return out


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0))
    inside = (x > 0) & (x < 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(np.where(inside, x, 0.5)) + b * np.log1p(-np.where(inside, x, 0.5)))
    low = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(inside, np.where(low, x, 1 - x), 0.5)
    value = front * _fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, value, 1 - value)))


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The chance of a value beyond t on either side, with df degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(t), 0.0, beta_share(df / 2, 0.5, df / (df + t * t)))


def t_quantile(share: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The t that leaves 1 - share outside on both sides together, by bisection of t_tail."""
    share, df = np.broadcast_arrays(np.asarray(share, float), np.asarray(df, float))
    lo, hi = np.zeros(share.shape), np.full(share.shape, 1.0)
    while np.any(grow := t_tail(hi, df) > 1 - share):
        hi = np.where(grow, hi * 2, hi)
        if hi.max(initial=0) > 1e12:
            break
    for _ in range(100):
        mid = (lo + hi) / 2
        out = t_tail(mid, df) > 1 - share
        lo, hi = np.where(out, mid, lo), np.where(out, hi, mid)
    return (lo + hi) / 2


def kolmogorov_tail(x: np.ndarray) -> np.ndarray:
    """The chance that the limit of sqrt(n) times the largest difference is beyond x.

    Two series, each where it converges in a few terms.
    """
    x = np.asarray(x, float)
    k = np.arange(1, 101)[:, None]
    flat = np.where(x > 0, x, 1.0).ravel()[None]
    far = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * flat * flat), 0)
    near = 1 - np.sqrt(2 * np.pi) / flat[0] * np.sum(np.exp(-((2 * k - 1) ** 2) * np.pi**2 / (8 * flat * flat)), 0)
    value = np.where(flat[0] < 1.18, near, far).reshape(x.shape)
    return np.where(x <= 0, 1.0, np.clip(value, 0.0, 1.0))


def _udf(f, *columns: Column) -> Column:
    def run(*parts: pd.Series) -> pd.Series:
        values = [p.to_numpy(float) for p in parts]
        known = ~np.logical_or.reduce([np.isnan(v) for v in values])
        out = np.full(len(parts[0]), np.nan)
        out[known] = f(*(v[known] for v in values))
        return pd.Series(out).astype("Float64").mask(~known, pd.NA)

    # as many parameters as columns, which pandas_udf reads from the signature
    made = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(columns)]
    made.__annotations__ = dict.fromkeys([*"abc"[: len(columns)], "return"], pd.Series)
    return F.pandas_udf(made, "double")(*[c.cast("double") for c in columns])


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null for nulls."""
    return _udf(t_tail, t, df)


def t_bound(share: Column, df: Column) -> Column:
    """Half the width, in standard errors, of an interval that holds `share`."""
    return _udf(t_quantile, share, df)


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value of the largest difference d of two distribution functions of n and m values."""
    return _udf(lambda d, n, m: kolmogorov_tail(d * np.sqrt(n * m / (n + m))), d, n, m)
