"""Tails and quantiles of distributions, for a few numbers a group."""

from __future__ import annotations

import math


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 500):
        for odd in (False, True):
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if odd else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """By bisection of the distribution function."""
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_two_sided(k: int, n: int) -> float:
    """The exact sign test: twice the smaller tail at a half, 1 at most."""
    if n == 0:
        return 1.0
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * tail)


def poisson_binomial_tail(ps: list[float], k: int) -> float:
    """The chance of k or more successes, by convolution."""
    dist = [1.0]
    for p in ps:
        dist = [a * (1 - p) + b * p for a, b in zip([*dist, 0.0], [0.0, *dist], strict=True)]
    return sum(dist[k:])


def chi2_sf(x: float, df: float) -> float:
    """The upper tail of chi squared: the regularised incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    f = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / ((k * d + b) or 1e-300)
        c = (b + k / c) or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f
