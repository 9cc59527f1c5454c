"""Least squares from sums of products: one summary row per series.

``gram`` is the Spark side: all products of the given columns, summed in one
aggregate.  The solvers are Arrow UDFs over the summary rows; they stack the
rows of a batch into one array, so numpy solves all series at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram(cols: Sequence[Column], where: Column | None = None) -> Column:
    """The upper triangle, row by row, of the sums of products of ``cols``."""
    out = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x = a * b
            out.append(F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0.0)).cast("double"))
    return F.array(*out)


_SOLVED = T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType())),
                        T.StructField("sse", T.DoubleType())])


def _square(g: pd.Series) -> np.ndarray:
    """Symmetric matrices of a column of triangles of equal length."""
    flat = np.array(g.tolist(), np.float64)
    d = int((np.sqrt(8 * flat.shape[1] + 1) - 1) / 2)
    out = np.zeros((len(flat), d, d))
    i, j = np.triu_indices(d)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _fit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, inverses, residual sums of squares) where the last row
    and column belong to the target.  Columns are scaled to unit length first;
    a singular system gives NaN."""
    x, y, yy = m[:, :-1, :-1], m[:, :-1, -1], m[:, -1, -1]
    size = np.sqrt(np.maximum(np.einsum("bii->bi", x), 1e-300))
    scaled = x / size[:, :, None] / size[:, None, :]
    fine = (np.linalg.cond(scaled) < 1e13) if len(m) else np.zeros(0, bool)
    inv = np.full_like(scaled, np.nan)
    if fine.any():
        inv[fine] = np.linalg.inv(scaled[fine])
    inv = inv / size[:, :, None] / size[:, None, :]
    coef = np.einsum("bij,bj->bi", inv, y)
    sse = yy - 2 * np.einsum("bi,bi->b", coef, y) + np.einsum("bi,bij,bj->b", coef, x, coef)
    return coef, inv, np.maximum(sse, 0.0)


@F.pandas_udf(_SOLVED)
def solve(g: pd.Series) -> pd.DataFrame:
    """triangle -> (coef, inverse, sse); null where it is singular."""
    coef, inv, sse = _fit(_square(g))
    ok = np.isfinite(coef).all(axis=1)
    return pd.DataFrame({"coef": [c.tolist() if o else None for c, o in zip(coef, ok)],
                         "inverse": [c.ravel().tolist() if o else None for c, o in zip(inv, ok)],
                         "sse": pd.Series(sse).where(ok)})


@F.pandas_udf(T.IntegerType())
def best_lag(g: pd.Series, most: pd.Series, nobs: pd.Series) -> pd.Series:
    """The number of lags with the smallest AIC; the triangle's columns are
    (constant, level, lag 1, lag 2, ..., target)."""
    m, most, nobs = _square(g), most.to_numpy(), nobs.to_numpy().astype(float)
    best, lag = np.full(len(m), np.inf), np.zeros(len(m), np.int32)
    for p in range(int(most.max(initial=0)) + 1):
        keep = [*range(p + 2), m.shape[1] - 1]
        _, _, sse = _fit(m[:, keep][:, :, keep])
        with np.errstate(all="ignore"):
            aic = nobs * (np.log(2 * np.pi * sse / nobs) + 1) + 2 * (p + 2)
        better = (p <= most) & (aic < best)
        best[better], lag[better] = aic[better], p
    return pd.Series(lag)


@F.pandas_udf(T.DoubleType())
def unit_root(g: pd.Series, lag: pd.Series, nobs: pd.Series) -> pd.Series:
    """t statistic of the level's coefficient with ``lag`` lags."""
    m, lag, n = _square(g), lag.to_numpy(), nobs.to_numpy().astype(float)
    stat = np.full(len(m), np.nan)
    for p in np.unique(lag):
        at = np.flatnonzero(lag == p)
        keep = [*range(p + 2), m.shape[1] - 1]
        coef, inv, sse = _fit(m[at][:, keep][:, :, keep])
        with np.errstate(all="ignore"):
            stat[at] = coef[:, 1] / np.sqrt(sse / (n[at] - p - 2) * inv[:, 1, 1])
    return pd.Series(stat).where(np.isfinite(stat))
