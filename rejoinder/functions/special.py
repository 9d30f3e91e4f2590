"""Tail probabilities as Spark column expressions (no Python UDF, no driver work).

* ``erfc``            — Taylor series below 3 (absolute error < 1e-13), continued fraction
                        above (relative error < 1e-12)
* ``normal_sf2``      — two-sided normal p-value  erfc(|z| / sqrt 2)
* ``chi2_sf``         — chi-square survival for any integer degrees of freedom
* ``binom_two_sided`` — exact two-sided sign/McNemar p = min(1, 2 P(X <= s)), X ~ Bin(n, 1/2), as an
                        incomplete beta integral by Gauss-Legendre quadrature: 64 nodes for any n
* ``signed_rank_cdf`` — exact P(T <= w) of the Wilcoxon signed-rank statistic (subset-sum DP)

Each has a DuckDB twin in ``rejoinder.plans.oracle``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAYLOR_TERMS = 80
_CF_DEPTH = 80
SQRT_PI = math.sqrt(math.pi)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _seq(lo: int, hi) -> Column:
    """Ascending integer sequence lo..hi (empty when hi < lo)."""
    hi = (_c(hi) if not isinstance(hi, int) else F.lit(hi)).cast("long")
    lo_c = F.lit(lo).cast("long")
    return F.filter(F.sequence(lo_c, F.greatest(hi, lo_c)), lambda i: i <= hi)


def erfc(x) -> Column:
    x = _c(x).cast("double")
    ax = F.abs(x)
    # erf by Taylor series: sum_{n>=0} (-1)^n x^(2n+1) / (n! (2n+1))
    taylor = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TAYLOR_TERMS)),
        F.struct(ax.alias("t"), ax.alias("s")),
        lambda acc, n: F.struct((acc["t"] * (-ax * ax) / n).alias("t"),
                                (acc["s"] + acc["t"] * (-ax * ax) / n / (2 * n + 1)).alias("s")),
        lambda acc: 1.0 - 2.0 / SQRT_PI * acc["s"])
    # erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...))))
    frac = F.aggregate(
        F.sequence(F.lit(_CF_DEPTH), F.lit(1), F.lit(-1)),
        ax,
        lambda f, k: ax + (k / 2.0) / f,
        lambda f: F.exp(-ax * ax) / (F.lit(SQRT_PI) * f))
    pos = F.when(ax < 3.0, taylor).otherwise(frac)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x >= 0, pos).otherwise(2.0 - pos)


def normal_sf2(z) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return erfc(F.abs(_c(z)) / math.sqrt(2.0))


def chi2_sf(x, df) -> Column:
    """Upper tail of chi-square with integer ``df`` (closed forms for even and odd df)."""
    x = _c(x).cast("double")
    df = _c(df).cast("int") if not isinstance(df, int) else F.lit(df)
    h = x / 2.0
    # even: exp(-h) * sum_{i=0}^{df/2-1} h^i / i!
    even = F.exp(-h) * F.aggregate(_seq(1, F.floor(df / 2) - 1), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                                   lambda a, i: F.struct((a["t"] * h / i).alias("t"), (a["s"] + a["t"] * h / i)
                                                         .alias("s")),
                                   lambda a: a["s"])
    # odd: erfc(sqrt h) + exp(-h) * sum_{i=1}^{(df-1)/2} h^(i-1/2) / Gamma(i+1/2)
    first = F.sqrt(h) / (SQRT_PI / 2.0)
    odd = erfc(F.sqrt(h)) + F.exp(-h) * F.aggregate(
        _seq(2, F.floor((df - 1) / 2)), F.struct(first.alias("t"), first.alias("s")),
        lambda a, i: F.struct((a["t"] * h / (i - 0.5)).alias("t"), (a["s"] + a["t"] * h / (i - 0.5)).alias("s")),
        lambda a: F.when(df >= 3, a["s"]).otherwise(F.lit(0.0)))
    res = F.when(df % 2 == 0, even).otherwise(odd)
    return F.when(x.isNull() | df.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)) \
        .otherwise(F.least(F.lit(1.0), res))


def _stirling_rest(k: Column) -> Column:
    """log k! less Stirling's formula: exact for small k, the asymptotic series (below double precision) beyond."""
    small = [0.0] + [math.lgamma(i + 1) - (0.5 * math.log(2 * math.pi * i) + i * math.log(i) - i) for i in range(1, 16)]
    k = k.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (k * k)) / (k * k)) / (k * k)) / (k * k)) / k
    return F.when(k < 16, F.get(F.array(*map(F.lit, small)), k.cast("int"))).otherwise(series)


def _log_half_binomial(s: Column, n: Column) -> Column:
    """log(C(n, s) / 2^n) for 0 <= s <= n / 2, without differences of large logarithms."""
    x, m = s.cast("double"), n.cast("double")
    d = (m - 2 * x) / m                                  # s = n (1 - d) / 2
    apart = m / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    inner = (_stirling_rest(n) - _stirling_rest(s) - _stirling_rest(n - s) - apart
             + 0.5 * F.log(m / (2 * math.pi * x * (m - x))))
    return F.when(s == 0, -m * math.log(2.0)).otherwise(inner)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def binom_two_sided(s, n) -> Column:
    """min(1, 2 * P(X <= s)) for X ~ Binomial(n, 1/2) and s <= n/2 (exact McNemar / sign test).

    P(X <= s) = (n - s) C(n, s) / 2^n * integral over u from 0 to 1 of (1 - u)^(n - s - 1) (1 + u)^s.
    The integrand falls from 1 at least as fast as exp(-(n - 2s - 1) u - n u^2 / 3), so the integral is taken
    to where that is e^-45, far below double precision, and is smooth there.
    """
    s, n = _c(s).cast("long"), _c(n).cast("long")
    m = (n - 2 * s - 1).cast("double")
    end = F.least(F.lit(1.0), 90.0 / (m + F.sqrt(m * m + 60.0 * n)))
    nodes = F.array(*[F.struct(F.lit(float((1 + x) / 2)).alias("u"), F.lit(float(w / 2)).alias("w"))
                      for x, w in zip(_NODES, _WEIGHTS, strict=True)])
    area = F.aggregate(nodes, F.lit(0.0), lambda a, p: a + p["w"] * F.exp(
        (n - s - 1) * F.log1p(-p["u"] * end) + s * F.log1p(p["u"] * end)))
    p = 2.0 * (n - s) * F.exp(_log_half_binomial(s, n)) * end * area
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def signed_rank_cdf(w, n) -> Column:
    """Exact P(T+ <= w) for n untied, non-zero differences: subset sums of {1..n} / 2^n."""
    n = _c(n).cast("int")
    w = _c(w).cast("double")
    top = n * (n + 1) / 2
    init = F.transform(F.sequence(F.lit(0), top.cast("int")), lambda j: F.when(j == 0, F.lit(1.0))
                       .otherwise(F.lit(0.0)))
    counts = F.aggregate(_seq(1, n), init,
                         lambda acc, k: F.transform(acc, lambda v, j: v + F.when(j >= k, F.get(acc, j - k))
                                                    .otherwise(F.lit(0.0))))
    le = F.aggregate(F.filter(F.transform(counts, lambda v, j: F.when(j <= w, v).otherwise(F.lit(0.0))),
                              lambda v: v > 0), F.lit(0.0), lambda a, v: a + v)
    return le / F.pow(F.lit(2.0), n)
