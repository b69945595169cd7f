"""Tail probabilities and quantiles of the reference distributions.

Scalars work on the handful of statistics a model leaves on the driver; ``normal_quantile`` is a
column expression; ``p_column`` applies a scalar to result rows (one per group) in Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .compat import as_col


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if not (x == x):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if not (x == x):
        return math.nan
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or not (t == t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    if f is None or not (f == f) or df1 <= 0 or df2 <= 0:
        return math.nan
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the two-sided tail."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    target = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > target:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if t_two_sided(mid, df) > target else (low, mid)
    return 0.5 * (low + high)


# Coefficients of algorithm AS 241 (Wichura 1988, PPND16), lowest power first.
AS241_CENTRE_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
AS241_CENTRE_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
AS241_MIDDLE_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
AS241_MIDDLE_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
AS241_TAIL_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
AS241_TAIL_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]


def _poly(coefs, x):
    out = coefs[-1]
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def normal_quantile(p) -> Column:
    """Standard normal quantile of a probability column (AS 241, about 16 digits)."""
    p = as_col(p)
    q = p - 0.5
    r_mid = F.lit(0.180625) - q * q
    centre = q * _poly(AS241_CENTRE_NUM, r_mid) / _poly(AS241_CENTRE_DEN, r_mid)
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    middle = _poly(AS241_MIDDLE_NUM, r - 1.6) / _poly(AS241_MIDDLE_DEN, r - 1.6)
    tail = _poly(AS241_TAIL_NUM, r - 5.0) / _poly(AS241_TAIL_DEN, r - 5.0)
    outer = F.signum(q) * F.when(r <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(outer)


def p_column(kind: str, *args) -> Column:
    """Tail probability of result rows: kind is ``t``, ``f``, ``chi2`` or ``normal``."""
    scalar = {"t": t_two_sided, "f": f_upper, "chi2": chi2_upper, "normal": normal_upper}[kind]

    @F.pandas_udf("double")
    def tail(*cols: pd.Series) -> pd.Series:
        rows = zip(*[c.astype(float) for c in cols])
        return pd.Series([math.nan if any(v != v for v in r) else scalar(*r) for r in rows], dtype="float64")

    return tail(*[as_col(a).cast("double") for a in args])
