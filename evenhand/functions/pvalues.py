"""Tail probabilities of the chi-square and t distributions.

Spark has no incomplete gamma/beta function, so these two run as Arrow-batched pandas
UDFs. They are only ever applied to result tables (one row per test), never to base rows.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_EPS = 1e-15


def _lgamma(a: np.ndarray) -> np.ndarray:
    return np.array([lgamma(v) for v in a], dtype=float)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): power series below a+1, Lentz above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1.0 / aa
        total = term.copy()
        for i in range(1, 2000):
            term = term * xx / (aa + i)
            total += term
            if np.all(np.abs(term) < np.abs(total) * _EPS):
                break
        out[low] = 1.0 - total * np.exp(aa * np.log(xx) - xx - _lgamma(aa))
    high = x >= a + 1
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1.0 - aa
        c = np.full_like(b, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - aa)
            b = b + 2.0
            d = 1.0 / np.where(np.abs(an * d + b) < _TINY, _TINY, an * d + b)
            c = np.where(np.abs(b + an / c) < _TINY, _TINY, b + an / c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1.0) < _EPS):
                break
        out[high] = h * np.exp(aa * np.log(xx) - xx - _lgamma(aa))
    return np.clip(out, 0.0, 1.0)


def inc_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inner = (x > 0) & (x < 1)
    if not inner.any():
        return out
    aa, bb, xx = a[inner], b[inner], x[inner]
    swap = xx > (aa + 1) / (aa + bb + 2)
    p, q, z = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1.0 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < _TINY, _TINY, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 500):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for num in (even, odd):
            d = 1.0 / np.where(np.abs(1 + num * d) < _TINY, _TINY, 1 + num * d)
            c = np.where(np.abs(1 + num / c) < _TINY, _TINY, 1 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < _EPS):
            break
    val = front * h
    out[inner] = np.where(swap, 1.0 - val, val)
    return np.clip(out, 0.0, 1.0)


def chi2_tail(stat: np.ndarray, dof: np.ndarray) -> np.ndarray:
    stat, dof = np.asarray(stat, float), np.asarray(dof, float)
    ok = dof > 0
    out = np.ones_like(stat)
    out[ok] = upper_gamma(dof[ok] / 2.0, np.maximum(stat[ok], 0.0) / 2.0)
    return out


def t_tail_of_r(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation r over n pairs (t test with n-2 dof)."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    dof = np.maximum(n - 2.0, 1.0)
    x = np.clip(1.0 - r * r, 0.0, 1.0)  # dof / (dof + t^2)
    out = inc_beta(dof / 2.0, np.full_like(dof, 0.5), x)
    return np.where(n > 2, out, 1.0)


def _log_weights(start: int, stop: int, step: int, r1: int, c1: int, t: int, floor: float = -80.0) -> tuple[np.ndarray, np.ndarray]:
    """Log hypergeometric weights of the top-left counts from ``start`` towards ``stop``, relative to the one at
    ``start``, until they are below ``floor`` or the support ends."""
    xs, logs, at, level = [], [], start, 0.0
    while at != stop and level > floor:
        n = min(4096, abs(stop - at))
        x = at + step * np.arange(1, n + 1, dtype=float)
        lo = x - 1 if step > 0 else x  # the ratio of the weights at lo + 1 and lo
        ratio = np.log((r1 - lo) * (c1 - lo)) - np.log((lo + 1) * (t - r1 - c1 + lo + 1))
        part = level + np.cumsum(step * ratio)
        xs.append(x)
        logs.append(part)
        at, level = int(x[-1]), float(part[-1])
    return (np.concatenate(xs), np.concatenate(logs)) if xs else (np.zeros(0), np.zeros(0))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher p of a 2x2: the weights are summed from their mode outwards until they vanish, so the work grows
    with the standard deviation of the count, not with the margins."""
    r1, c1, t = a + b, a + c, a + b + c + d
    low, high = max(0, a - d), min(r1, c1)
    mode = min(max((r1 + 1) * (c1 + 1) // (t + 2), low), high)
    up, down = _log_weights(mode, high, 1, r1, c1, t), _log_weights(mode, low, -1, r1, c1, t)
    x, logs = np.concatenate([[mode], up[0], down[0]]), np.concatenate([[0.0], up[1], down[1]])
    here = logs[x == a]
    if not len(here):  # the observed count is out where weights vanish
        return 0.0
    w = np.exp(logs)
    return float(min(w[w <= np.exp(here[0]) * (1 + 1e-7)].sum() / w.sum(), 1.0))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    cells = zip(a, b, c, d)
    out = [None if any(pd.isna(v) for v in cell) else fisher_two_sided(*(int(v) for v in cell)) for cell in cells]
    return pd.Series(out, index=a.index, dtype=object)


@F.pandas_udf(DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    ok = stat.notna() & dof.notna()
    out = pd.Series(np.nan, index=stat.index, dtype=float)
    if ok.any():
        out[ok] = chi2_tail(stat[ok].to_numpy(), dof[ok].to_numpy())
    return out.astype(object).where(ok, None)


@F.pandas_udf(DoubleType())
def corr_p(r: pd.Series, n: pd.Series) -> pd.Series:
    ok = r.notna() & n.notna()
    out = pd.Series(np.nan, index=r.index, dtype=float)
    if ok.any():
        out[ok] = t_tail_of_r(r[ok].to_numpy(), n[ok].to_numpy())
    return out.astype(object).where(ok, None)
