"""Chi-square distribution without scipy: incomplete gamma by series and continued fraction, quantile by bisection."""

from __future__ import annotations

import math


def lower_gamma(a: float, x: float) -> float:
    """Regularised P(a, x)."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, d = x + 1 - a, 0.0
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * scale


def chi2inv(p: float, dof: float) -> float:
    """The value below which a share p lies."""
    if not 0 < p < 1 or not dof > 0:
        return float("nan")
    low, high = 0.0, dof + 10.0
    while lower_gamma(dof / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if lower_gamma(dof / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
