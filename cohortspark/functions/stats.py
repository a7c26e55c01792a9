"""Distribution functions for p-values and intervals, without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _N.inv_cdf(p)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - lead * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b or tiny
        c = b + an / c or tiny
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return lead * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile for p > 0.5 by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Exact test: the probability of all outcomes no likelier than k."""
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return min(1.0, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7)))


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values."""
    n = len(p)
    order = np.argsort(p, kind="stable")
    s = p[order]
    q = pa = np.full(n, min(n * s / np.arange(1, n + 1))) if n else p
    for m in range(n - 1, 1, -1):
        head, tail = np.arange(n - m + 1), np.arange(n - m + 1, n)
        low = min(m * s[tail] / np.arange(2, m + 1))
        q = q.copy()
        q[head] = np.minimum(m * s[head], low)
        q[tail] = q[n - m]
        pa = np.maximum(pa, q)
    out = np.empty(n)
    out[order] = np.maximum(pa, s) if n else s
    return np.minimum(out, 1)


def lausen_schumacher(b: float, low: float = 0.1, high: float = 0.9) -> float:
    """p-value of a maximally selected standardised statistic, over cut-points between two quantiles (1992 approximation)."""
    if b < 1e-9:
        return 1.0
    density = math.exp(-b * b / 2) / math.sqrt(2 * math.pi)
    p = density * (b - 1 / b) * math.log(high * (1 - low) / ((1 - high) * low)) + 4 * density / b
    return min(max(p, 0.0), 1.0)
