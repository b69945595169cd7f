"""Column helpers for the missing-value and infinity rules of the analyses.

The analyses distinguish a missing value (NULL) from NaN and from the infinities that a
logarithm of zero or a division by zero give; Spark's defaults do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r_ln(c) -> Column:
    """Natural logarithm with ln(0) = -inf and ln(negative) = NaN; NULL stays NULL."""
    c = as_col(c)
    return F.when(c == 0, F.lit(-INF)).when(c < 0, F.lit(NAN)).otherwise(F.ln(c))


def r_div(a, b) -> Column:
    """Division with signed infinity or NaN at a zero divisor; NULL stays NULL."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    at_zero = (
        F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    )
    return F.when(b != 0, a / b).when(b == 0, at_zero)


def num(c) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return as_col(c).try_cast("double")


def strict_avg(c) -> Column:
    """Mean that is NULL as soon as one value of the group is NULL."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def not_in(c, values) -> Column:
    """``not in`` that keeps NULLs."""
    return ~F.coalesce(as_col(c).isin(*values), F.lit(False))


def is_present(c) -> Column:
    """Neither NULL nor NaN."""
    c = as_col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c)


def complete_cases(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with a NULL or NaN in ``cols`` (all by default); infinities stay."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def clamp_low(c, low: float = 0.0) -> Column:
    c = as_col(c)
    return F.when(c < low, F.lit(float(low))).otherwise(c)


def clamp_high(c, high: float = 0.0) -> Column:
    c = as_col(c)
    return F.when(c >= high, F.lit(float(high))).otherwise(c)


def replace_value(c, old: float, new: float) -> Column:
    c = as_col(c)
    return F.when(c == F.lit(old), F.lit(new)).otherwise(c)


def join_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi join in which a NULL key matches a NULL key.

    Key columns come once and first; every other column must have one owner.
    """
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on])
    joined = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    keys = [F.coalesce(k, f"__r_{k}").alias(k) if how == "full" else F.col(k) for k in on]
    rest = [c for c in (*left.columns, *right.columns) if c not in on]
    return joined.select(*keys, *[f"`{c}`" for c in rest])
