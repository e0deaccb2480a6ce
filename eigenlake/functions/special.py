"""Tail probabilities as Arrow-batched functions, by continued fractions and series of the incomplete beta and gamma functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(x).astype(float)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b), by Lentz's continued fraction on the side where it converges fast."""
    x, a, b = (np.asarray(v, float).copy() for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
        out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(turn, 1 - out, out)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised Q(a, x)."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _log_gamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 500):
            term = term * x / (a + n)
            total = total + term
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 500):
            k = -i * (i - a)
            b = b + 2
            d = 1 / (k * d + b)
            c = b + k / c
            h = h * d * c
        out = np.where(x < a + 1, 1 - front * total, front * h)
    return np.where(x <= 0, 1.0, np.clip(out, 0, 1))


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z)."""
    return _erfc(np.asarray(z, float) / math.sqrt(2)).astype(float) / 2


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / (df + t * t), df / 2, np.full_like(df, 0.5))


@F.pandas_udf(DoubleType())
def p_student(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where an argument is null or df isn't positive."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, t.index).astype(object)
    out[ok] = student_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal score; null for null."""
    ok = z.notna()
    out = pd.Series(np.nan, z.index).astype(object)
    out[ok] = 2 * normal_tail(z[ok].abs().to_numpy())
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-squared; null where an argument is null or df isn't positive."""
    ok = x.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, x.index).astype(object)
    out[ok] = upper_gamma(df[ok].to_numpy(float) / 2, x[ok].to_numpy(float) / 2)
    return out.where(ok, None)
