"""Tails of distributions in numpy and math, for the few helpers that need them."""

from __future__ import annotations

import math

import numpy as np


def _log_choose(n: float, k: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return math.lgamma(n + 1) - lg(k + 1) - lg(n - k + 1)


def hypergeom_sf(k: int, N: int, K: int, n: int) -> float:
    """P(X >= k) for n draws without replacement from N of which K count."""
    low, high = max(k, n - (N - K), 0), min(K, n)
    if k <= max(0, n - (N - K)):
        return 1.0
    if low > high:
        return 0.0
    x = np.arange(low, high + 1, dtype=float)
    logs = _log_choose(K, x) + _log_choose(N - K, n - x) - _log_choose(N, np.array([float(n)]))[0]
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def hypergeom_cdf(N: int, K: int, n: int) -> tuple[int, np.ndarray]:
    """(least count, P(X <= count) of it and all after it) for n draws without replacement from N of which K count."""
    low = max(0, n - (N - K))
    x = np.arange(low, min(K, n) + 1, dtype=float)
    return low, np.cumsum(np.exp(_log_choose(K, x) + _log_choose(N - K, n - x) - _log_choose(N, np.array([float(n)]))[0]))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def kolmogorov_sf(x: float) -> float:
    """Asymptotic P(K > x) of the Kolmogorov distribution."""
    if x <= 0:
        return 1.0
    if x < 1.18:  # the other form of the series converges faster here
        t = math.exp(-math.pi**2 / (8 * x * x))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * (t + t**9 + t**25 + t**49))
    return max(0.0, min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def student_sf(t: float, df: float) -> float:
    """P(T > t), by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    half = 0.5 * _beta_inc(df / 2, 0.5, x)
    return half if t >= 0 else 1 - half


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out / a
