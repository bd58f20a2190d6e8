"""The chi-square distribution for even degrees of freedom, in closed form."""

from __future__ import annotations

import math


def cdf(x: float, freedom: int) -> float:
    if freedom % 2:
        raise ValueError("even degrees of freedom only")
    term = total = math.exp(-x / 2)
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return max(0.0, 1 - total)


def quantile(p: float, freedom: int) -> float:
    """The least x with cdf(x) of p or more, by bisection."""
    low, high = 0.0, 1.0
    while cdf(high, freedom) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, freedom) < p else (low, mid)
    return high
