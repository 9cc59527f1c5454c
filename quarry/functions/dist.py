"""Distribution tails for p-values, without scipy.

Only summary rows reach these functions (one row per experiment), in Arrow
batches; every function works on whole arrays.  The data work stays in Spark
aggregates.

* Student t, F : regularised incomplete beta (continued fraction, Lentz)
* chi-square, normal : regularised incomplete gamma (series / continued fraction)
* Mann-Whitney exact : sums of binomials, no table of all rank sums

Counts may be of any size: the factors in front of the fractions are formed
from differences to the mode, not from large logarithms that cancel.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 3e-16
_TINY = 1e-300
_STEPS = 100_000
#: Corrections to Stirling's formula are taken at arguments of at least this.
_SHIFT = 12


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _floats(*xs) -> list[np.ndarray]:
    return np.broadcast_arrays(*[np.atleast_1d(np.asarray(x, dtype="float64")) for x in xs])


def _away(x: np.ndarray) -> np.ndarray:
    """Keeps a divisor of a continued fraction off zero."""
    return np.where(np.abs(x) < _TINY, _TINY, x)


def _stirling_rest(x: np.ndarray) -> np.ndarray:
    """lgamma(x) - ((x - 1/2) ln x - x + ln(2 pi) / 2) for x > 0."""
    low = x < _SHIFT
    y = np.where(low, x + _SHIFT, x)
    z = 1.0 / (y * y)
    rest = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188))))) / y
    if low.any():
        xl, yl = x[low], y[low]
        down = sum(np.log(xl + i) for i in range(_SHIFT))
        rest[low] += (yl - 0.5) * np.log(yl) - yl - ((xl - 0.5) * np.log(xl) - xl) - down
    return rest


def _settle(step, n: int) -> None:
    """Runs ``step(m, at)`` on the entries that have not settled; it returns
    the entries of ``at`` that move on."""
    at = np.arange(n)
    m = 1
    while len(at) and m < _STEPS:
        at = at[step(m, at)]
        m += 1


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    c, h = np.ones_like(x), np.empty_like(x)
    d = 1.0 / _away(1.0 - (a + b) * x / (a + 1.0))
    h[:] = d

    def step(m, at):
        aa, bb, xx = a[at], b[at], x[at]
        for num in (m * (bb - m) * xx / ((aa - 1.0 + 2 * m) * (aa + 2 * m)),
                    -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 1.0 + 2 * m))):
            d[at] = 1.0 / _away(1.0 + num * d[at])
            c[at] = _away(1.0 + num / c[at])
            move = c[at] * d[at]
            h[at] *= move
        return np.abs(move - 1.0) > _EPS

    _settle(step, len(x))
    return h


def betainc(a, b, x, y=None) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); ``y`` = 1 - x where it is known
    more exactly than the difference."""
    a, b, x, y = _floats(a, b, x, 1.0 - np.asarray(x, dtype="float64") if y is None else y)
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & np.isfinite(a + b + x + y)
    out[ok & (x <= 0)] = 0.0
    out[ok & (y <= 0)] = 1.0
    at = np.flatnonzero(ok & (x > 0) & (y > 0))
    if len(at):
        a, b, x, y = a[at], b[at], x[at], y[at]
        dev = a * y - b * x  # distance from the mode: x (a + b) = a - dev
        log_front = (a * np.log1p(-dev / a) + b * np.log1p(dev / b) + 0.5 * (np.log(a) + np.log(b) - np.log(a + b))
                     - 0.5 * math.log(2 * math.pi) + _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b))
        front = np.exp(log_front)
        swap = x > (a + 1.0) / (a + b + 2.0)
        p, q, u = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x)
        tail = front * _beta_fraction(p, q, u) / p
        out[at] = np.where(swap, 1.0 - tail, tail)
    return out


def gammaincc(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = _floats(a, x)
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & np.isfinite(a + x)
    out[ok & (x <= 0)] = 1.0
    at = np.flatnonzero(ok & (x > 0))
    if not len(at):
        return out
    a, x = a[at], x[at]
    dev = (x - a) / a
    # x^a e^-x / gamma(a), from the distance to the mode
    front = np.exp(a * (np.log1p(dev) - dev) + 0.5 * np.log(a / (2 * math.pi)) - _stirling_rest(a))
    got = np.empty_like(x)
    low = x < a + 1.0
    if low.any():
        al, xl = a[low], x[low]
        term, total = 1.0 / al, 1.0 / al

        def add(m, i):
            term[i] *= xl[i] / (al[i] + m)
            total[i] += term[i]
            return term[i] > total[i] * _EPS

        term, total = term.copy(), total.copy()
        _settle(add, len(al))
        got[low] = 1.0 - total * front[low]
    if (~low).any():
        ah, xh = a[~low], x[~low]
        b = xh + 1.0 - ah
        c, d = np.full_like(b, 1.0 / _TINY), 1.0 / _away(b)
        h = d.copy()

        def step(m, i):
            num, den = -m * (m - ah[i]), b[i] + 2.0 * m
            d[i] = 1.0 / _away(num * d[i] + den)
            c[i] = _away(den + num / c[i])
            move = c[i] * d[i]
            h[i] *= move
            return np.abs(move - 1.0) > _EPS

        _settle(step, len(ah))
        got[~low] = front[~low] * h
    out[at] = got
    return out


def norm_sf(z) -> np.ndarray:
    """Upper tail of the normal distribution."""
    (z,) = _floats(z)
    half = 0.5 * gammaincc(0.5, z * z / 2.0)
    return np.where(z >= 0, half, 1.0 - half)


def t_sf2(t, df) -> np.ndarray:
    """Two-sided p of a t statistic."""
    t, df = _floats(t, df)
    with np.errstate(all="ignore"):
        sq = t * t
        return betainc(df / 2.0, 0.5, df / (df + sq), sq / (df + sq))


def f_sf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = _floats(f, d1, d2)
    with np.errstate(all="ignore"):
        part = d1 * np.maximum(f, 0.0)
        return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + part), part / (d2 + part))


def chi2_sf(x, k) -> np.ndarray:
    x, k = _floats(x, k)
    return gammaincc(k / 2.0, x / 2.0)


#: Exact rank-sum tails are taken where the smaller side has at most this many values.
EXACT_SIDE = 8


@cache
def _rank_sum_tables(s: int):
    """For a smaller side of ``s`` values: the period L, per residue the
    coefficients of (1 - q^L)^(s + 1) / ((1 - q) prod(1 - q^i)), and the
    expanded prod(1 - q^(n + i)) as {(power of q^n, offset): sign}."""
    period = math.lcm(*range(1, s + 1))
    series = np.zeros((s + 1) * period + 1, dtype=object)  # whole numbers of any size
    series[0] = 1
    for part in (1, *range(1, s + 1)):
        for r in range(part):
            series[r::part] = np.add.accumulate(series[r::part])
        series[period:] = series[period:] - series[:-period]
    signs = {(0, 0): 1}
    for i in range(1, s + 1):
        for (power, off), v in list(signs.items()):
            key = (power + 1, off + i)
            signs[key] = signs.get(key, 0) - v
    by_rest = [[(j, series[j]) for j in range(rest, len(series), period) if series[j]] for rest in range(period)]
    return period, by_rest, signs


def mwu_exact_p(u, n1, n2) -> np.ndarray:
    """Two-sided exact p of U without ties, NaN where both sides have more than
    ``EXACT_SIDE`` values.

    The number of arrangements with U <= k is a coefficient of the Gaussian
    binomial over (1 - q); with s values on the smaller side it is a sum of at
    most 2^s (s + 1) binomials in whole numbers, whatever the larger side."""
    u, n1, n2 = _floats(u, n1, n2)
    out = np.full(u.shape, np.nan)
    small, big = np.minimum(n1, n2), np.maximum(n1, n2)
    for s in range(1, EXACT_SIDE + 1):
        rows = np.flatnonzero((small == s) & np.isfinite(u + big))
        if not len(rows):
            continue
        period, by_rest, signs = _rank_sum_tables(s)
        for r in rows:
            n = int(big[r])
            k = math.floor(min(u[r], s * n - u[r]) + 1e-9)
            ways = 0
            for (power, off), sign in signs.items():
                left = k - power * n - off
                if left >= 0:
                    ways += sign * sum(v * math.comb((left - j) // period + s, s)
                                       for j, v in by_rest[left % period] if j <= left)
            out[r] = min(1.0, 2 * ways / math.comb(n + s, s))
    return out


# ---------------------------------------------------------------- UDF wrappers
@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(t, df))


@F.pandas_udf(T.DoubleType())
def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f, d1, d2))


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x, k))


@F.pandas_udf(T.DoubleType())
def _mwu_exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series(mwu_exact_p(u, n1, n2))


@F.pandas_udf(T.DoubleType())
def _norm_sf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_sf(z))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def t_pvalue(t: Column, df: Column) -> Column:
    return nan_to_null(_t_p(t.cast("double"), df.cast("double")))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return nan_to_null(_f_p(f.cast("double"), d1.cast("double"), d2.cast("double")))


def chi2_pvalue(x: Column, k: Column) -> Column:
    return nan_to_null(_chi2_p(x.cast("double"), k.cast("double")))


def mwu_exact_pvalue(u: Column, n1: Column, n2: Column) -> Column:
    return nan_to_null(_mwu_exact(u.cast("double"), n1.cast("double"), n2.cast("double")))


def norm_sf_col(z: Column) -> Column:
    """Normal upper tail; Spark's functions have no error function."""
    return nan_to_null(_norm_sf(z.cast("double")))
