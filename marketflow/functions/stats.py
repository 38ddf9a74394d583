"""Error measures, buckets and test statistics as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.functions.constants import ERROR_ABOVE, ERROR_BUCKETS, ERROR_UNDEFINED


def relative_error(model: Column, real: Column, *, signed: bool = False) -> Column:
    """(model - real) / |real|. A zero real value gives 0 when both agree, else NULL."""
    gap = model - real
    gap = gap if signed else F.abs(gap)
    return F.when(real == 0, F.when(model == 0, F.lit(0.0))).otherwise(
        F.try_divide(gap.cast("double"), F.abs(real).cast("double"))
    )


def residual_error(residual: Column, total: Column) -> Column:
    """Signed residual over |total|, with the same zero rule as :func:`relative_error`."""
    return F.when(total == 0, F.when(residual == 0, F.lit(0.0))).otherwise(
        F.try_divide(residual.cast("double"), F.abs(total).cast("double"))
    )


def error_bucket(error: Column) -> Column:
    label = F.when(error.isNull(), ERROR_UNDEFINED).when(error == 0, ERROR_BUCKETS[0][0])
    for name, bound in ERROR_BUCKETS[1:]:
        label = label.when(error <= bound, name)
    return label.otherwise(ERROR_ABOVE)


def error_bucket_rank(label: Column) -> Column:
    """Report position of a bucket label."""
    names = [name for name, _ in ERROR_BUCKETS] + [ERROR_ABOVE, ERROR_UNDEFINED]
    return F.array_position(F.array(*[F.lit(n) for n in names]), label).cast("int") - 1


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def to_bps(value: Column) -> Column:
    return value * 10_000


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, all entries at once (modified Lentz steps until none moves)."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    value, m, moving = d.copy(), 0, True
    while moving:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = np.ones_like(x)
        for term in (even, odd):
            d, c = 1.0 / safe(1.0 + term * d), safe(1.0 + term / c)
            change = change * c * d
        value = value * change
        moving = bool(np.any(np.abs(change - 1.0) > 4e-16 * m ** 0.5)) and m < 1_000_000
    return value


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """log Gamma(a + 1/2) - log Gamma(a); a series where the difference of the logarithms would lose digits."""
    big = np.maximum(a, 40.0)
    series = 0.5 * np.log(big) - 1 / (8 * big) + 1 / (192 * big**3) - 1 / (640 * big**5)
    small = np.array([math.lgamma(v + 0.5) - math.lgamma(v) for v in np.minimum(a, 40.0)])
    return np.where(a > 40.0, series, small)


def student_t_tails(t_stat: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-tailed p-value of Student's t with ``df`` >= 1 degrees of freedom: I_x(df/2, 1/2) at x = df / (df + t^2).

    An infinite statistic gives 0; NaN, or ``df`` below 1, gives NaN.
    """
    t_stat, df = np.abs(np.asarray(t_stat, float)), np.asarray(df, float)
    out = np.where(np.isinf(t_stat), 0.0, np.nan)
    out = np.where(np.isnan(df) | (df < 1), np.nan, out)
    fit = np.isfinite(t_stat) & (df >= 1)
    if not fit.any():
        return out
    t, v = t_stat[fit], df[fit]
    half = v / 2
    # x^a (1-x)^b / B(a, b) with a = df/2, b = 1/2; 0 and very large statistics reach the ends of the range.
    with np.errstate(divide="ignore", over="ignore"):
        ratio = t * (t / v)
        x, rest = 1 / (1 + ratio), 1 / (1 + 1 / ratio)
        front = np.exp(-half * np.log1p(ratio) + 0.5 * np.log(rest) + _log_gamma_step(half) - 0.5 * math.log(math.pi))
    direct = x < (half + 1) / (half + 2.5)
    b = np.full_like(half, 0.5)
    one = _beta_fraction(np.where(direct, half, b), np.where(direct, b, half), np.where(direct, x, rest))
    exact = np.where(direct, front * one / half, 1.0 - front * one / b)
    # Beyond a million degrees of freedom x is too near 1 to hold digits; the corrected normal tail errs by about 1 / df^2.
    with np.errstate(over="ignore", invalid="ignore"):
        z = np.where(np.isinf(ratio), np.inf, t * (1 - 1 / (4 * v)) / np.sqrt(1 + ratio / 2))
    out[fit] = np.where(v > 1e6, [math.erfc(q / math.sqrt(2.0)) for q in z], exact)
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def two_tailed_p(t_stat: pd.Series, df: pd.Series) -> pd.Series:
    """Two-tailed p-value of Student's t; NULL where the statistic or the degrees of freedom are missing."""
    p = student_t_tails(t_stat.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
    return pd.Series(p).astype(object).where(~np.isnan(p), None).astype("Float64")
