"""Special functions and distributions: scalars for planning on the driver, pandas UDFs where a column needs them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, evaluated backwards from a depth that suffices."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    depth = 60 + int(8 * math.sqrt(max(a, b)))
    tail = 0.0
    for m in range(depth, 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        tail = odd / (1 + even / (1 + tail))
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front / a / (1 + tail)


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: the series below a + 1, else one minus the continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return front * total
    value = 0.0
    for m in range(200 + int(4 * math.sqrt(a)), 0, -1):
        value = m * (m - a) / (x + 2 * m + 1 - a - value)
    return 1 - front / (x + 1 - a - value)


def digamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def bessel_k(nu: float, x: float) -> float:
    """Modified Bessel K from its integral of exp(-x cosh t) cosh(nu t), by the trapezoid rule (which converges geometrically)."""
    top = math.acosh(1 + (745 + nu * 30) / x) if x > 0 else 0
    t = np.linspace(0, top, 4001)
    f = np.exp(-x * np.cosh(t)) * np.cosh(nu * t)
    return float((f.sum() - (f[0] + f[-1]) / 2) * (t[1] - t[0]))


def bisect(f, target: float, lo: float, hi: float) -> float:
    """The x in [lo, hi] at which the increasing f reaches target."""
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return bisect(normal_cdf, p, -40, 40) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


def student_t_cdf(t: float, dof: float) -> float:
    tail = 0.5 * betainc(dof / 2, 0.5, dof / (dof + t * t))
    return 1 - tail if t > 0 else tail


def student_t_ppf(p: float, dof: float) -> float:
    if dof <= 0:
        return math.nan
    top = 10.0
    while student_t_cdf(top, dof) < max(p, 1 - p):
        top *= 2
    return bisect(lambda t: student_t_cdf(t, dof), p, -top, top)


def chi2_cdf(x: float, dof: float) -> float:
    return gammainc(dof / 2, x / 2)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def _udf(f, *args: Column) -> Column:
    each = np.vectorize(f, otypes=[float])

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        ok = np.logical_and.reduce([s.notna() for s in series])
        out = np.full(len(series[0]), np.nan)
        if ok.any():
            out[ok] = each(*[s[ok].to_numpy(float) for s in series])
        return pd.Series(out)

    return run(*args)


def gammaln_column(x: Column) -> Column:
    return _udf(math.lgamma, x)


def erf_column(x: Column) -> Column:
    return _udf(math.erf, x)


def normal_cdf_column(x: Column) -> Column:
    return _udf(normal_cdf, x)


def student_t_p_column(t: Column, dof: Column) -> Column:
    """Two-sided p value."""
    return _udf(lambda a, b: betainc(b / 2, 0.5, b / (b + a * a)), t, dof)


def chi2_sf2(x: Column) -> Column:
    """Upper tail of chi-squared with two degrees of freedom, in closed form."""
    return F.exp(-x / 2)


def box_cox(y: Column, lam: float) -> Column:
    return F.log(y) if lam == 0 else (F.pow(y, F.lit(lam)) - 1) / lam


def box_cox_inverse(z: Column, lam: float) -> Column:
    return F.exp(z) if lam == 0 else F.pow(F.greatest(F.lit(lam) * z + 1, F.lit(1e-300)), F.lit(1 / lam))


def yeo_johnson(y: Column, lam: float) -> Column:
    up = F.log1p(y) if lam == 0 else (F.pow(y + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-y) if lam == 2 else -(F.pow(1 - y, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(y >= 0, up).otherwise(down)


def yeo_johnson_inverse(z: Column, lam: float) -> Column:
    up = F.expm1(z) if lam == 0 else F.pow(F.lit(lam) * z + 1, F.lit(1 / lam)) - 1
    down = -F.expm1(-z) if lam == 2 else 1 - F.pow(1 - F.lit(2 - lam) * z, F.lit(1 / (2 - lam)))
    return F.when(z >= 0, up).otherwise(down)
