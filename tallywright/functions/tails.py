"""Tail probabilities of the normal, t, F and chi-square distributions, for arrays and for columns.

Spark has no error function or incomplete beta and gamma; these tables are a few thousand cells at
most, so Arrow-batched numpy does it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a, b, x):
    """Lentz's continued fraction for the incomplete beta function."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x):
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, np.where(low, inside, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.0, 1 - inside)) / b)
    return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)), 0, 1)


def normal_two_sided(z):
    return np.clip(_erfc(np.abs(np.asarray(z, float)) / math.sqrt(2)), 0, 1)


def t_two_sided(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f, df1, df2):
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    return np.where(f <= 0, 1.0, incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.maximum(f, 0))))


def chi2_upper(x, df):
    """By the series below df + 2 and the continued fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    a, h = df / 2, np.maximum(x, 0) / 2
    out = np.empty(x.shape)
    for i in np.ndindex(x.shape):
        s, v = float(a[i]), float(h[i])
        if not math.isfinite(s + v) or s <= 0:
            out[i] = math.nan if math.isnan(s + v) else 0.0
        elif v <= 0:
            out[i] = 1.0
        elif v < s + 1:
            term = total = 1 / s
            k = s
            while abs(term) > 1e-17 * abs(total):
                k += 1
                term *= v / k
                total += term
            out[i] = 1 - total * math.exp(-v + s * math.log(v) - math.lgamma(s))
        else:
            b, c = v + 1 - s, 1e300
            d = 1 / b
            g = d
            for k in range(1, 10000):
                an = -k * (k - s)
                b += 2
                d = an * d + b
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = b + an / c
                c = c if abs(c) > 1e-300 else 1e-300
                g *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out[i] = g * math.exp(-v + s * math.log(v) - math.lgamma(s))
    return np.clip(out, 0, 1)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, df1, df2))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x, df))
