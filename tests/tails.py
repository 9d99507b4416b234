"""Tail probabilities in plain Python: the error function and finite sums."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_upper(x: float, df: int) -> float:
    """P(X > x) for integer degrees of freedom: a finite sum, after erfc when df is odd."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        total, term, start = 0.0, math.exp(-half), 0
    else:
        total = math.erfc(math.sqrt(half))
        term, start = math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 0.5
    for i in range(df // 2):
        total += term
        term *= half / (start + i + 1)
    return min(1.0, total)
