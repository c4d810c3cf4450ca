"""Tails of distributions by published series and quadrature; for small inputs on the driver."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - normal_sf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
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
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else max(0.0, 1 - _gamma_lower(df / 2, x / 2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def student_cdf(t: float, df: float) -> float:
    tail = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of one half."""
    if not n:
        return 1.0
    low = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * low)


def studentized_range_sf(q: float, k: int, df: float = math.inf) -> float:
    """Upper tail of the range of k normal values, by quadrature (infinite degrees of freedom)."""
    if q <= 0:
        return 1.0
    x = np.linspace(-8, 8, 4001)
    pdf = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([1 - normal_sf(v) for v in x])
    shifted = np.array([1 - normal_sf(v - q) for v in x])
    return float(max(0.0, 1 - k * np.trapezoid(pdf * np.clip(cdf - shifted, 0, 1) ** (k - 1), x)))


def shapiro(values) -> tuple[float, float]:
    """W and p by Royston's approximation; not a number for fewer than 3 or constant values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss = m @ m
    u = n**-0.5
    a = m / math.sqrt(ss)
    if n > 3:
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(ss)], u)
        if n > 5:
            before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ss)], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / math.sqrt(phi)
            a[[-2, 1]] = before, -before
        else:
            a = m / math.sqrt((ss - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[[-1, 0]] = last, -last
    else:
        a = np.array([-(0.5**0.5), 0, 0.5**0.5])
    w = float((a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean())))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(1, w))) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1e-300, 1 - w))
    if n <= 11:
        g = 0.459 * n - 2.273
        z = (-math.log(max(1e-300, g - y)) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n)) / math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        z = (y - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, normal_sf(float(z))
