"""Assumption tests and group comparisons."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.compat import is_present, join_on
from ..session import cut_lineage
from .order_stats import avg_rank, positions, quantiles

# Polynomials of Royston (1995), lowest power first, for weights, W transform and the range of n.
SW_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
SW_SMALL_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_LARGE_SD = [-0.4803, -0.082676, 0.0030302]
SW_GAMMA = [-2.273, 0.459]
SW_MIN, SW_MAX = 3, 5000
RANKS = 10_000  # ranks of equal values that are made at a time


def _poly(coefs, x):
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def shapiro_wilk(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """W and its p-value per group, for groups of 3 and more values; NULL is a group like any other.

    Fewer values are an error without groups and give a NULL result with groups. The p-value's approximation was
    published for up to 5000 values: ``p_in_range`` tells larger groups. Ranks come from counted values; the ranks that equal
    values share are made some at a time, so no window or row grows with a group.
    """
    by = list(by)
    src = df.filter(is_present(value)).select(*by, F.col(value).cast("double").alias("x"))
    sizes = src.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    if not by:
        n = sizes.first()["n"]
        if n < SW_MIN:
            raise ValueError(f"Shapiro-Wilk needs {SW_MIN} values and more, got {n}")
        key = ["__one"]
        src, sizes = src.withColumn("__one", F.lit(1)), sizes.withColumn("__one", F.lit(1))
    else:
        key = by
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / RANKS)))
    first = F.col("lo") + F.col("some") * RANKS
    each = F.explode(F.sequence(first, F.least(first + (RANKS - 1), F.col("lo") + F.col("cnt") - 1)))
    placed = positions(src, "x", key).filter(F.col("n") >= SW_MIN).withColumn("some", some).select(*key, "x", "n", each.alias("i"))
    ranked = join_on(placed, sizes.drop("n"), key)
    ranked = ranked.withColumn("m", tails.normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    at = lambda c, k: F.max(F.when(F.col("i") == k, F.col(c)))
    inner = lambda edge: F.sum(F.when((F.col("i") > edge) & (F.col("i") <= F.col("n") - edge), F.col("m") * F.col("x")))
    n = F.col("n")
    agg = ranked.groupBy(*key, "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum((F.col("x") - F.col("mean")) ** 2).alias("ss"),
        at("x", 1).alias("x1"), at("x", 2).alias("x2"), at("x", n - 1).alias("xp"), at("x", n).alias("xn"),
        at("m", n).alias("mn"), at("m", n - 1).alias("mp"),
        inner(1).alias("in1"), inner(2).alias("in2"),
    )
    u = 1 / F.sqrt(n.cast("double"))
    root = F.sqrt("mm")
    a_n = _poly(SW_C1, u) + F.col("mn") / root
    a_p = _poly(SW_C2, u) + F.col("mp") / root
    phi1 = (F.col("mm") - 2 * F.col("mn") ** 2) / (1 - 2 * a_n**2)
    phi2 = (F.col("mm") - 2 * F.col("mn") ** 2 - 2 * F.col("mp") ** 2) / (1 - 2 * a_n**2 - 2 * a_p**2)
    outer = F.col("xn") - F.col("x1")
    b = (
        F.when(n == 3, math.sqrt(0.5) * outer)
        .when(n <= 5, a_n * outer + F.coalesce("in1", F.lit(0.0)) / F.sqrt(phi1))
        .otherwise(a_n * outer + a_p * (F.col("xp") - F.col("x2")) + F.coalesce("in2", F.lit(0.0)) / F.sqrt(phi2))
    )
    w = F.when(F.col("ss") > 0, F.least(b * b / F.col("ss"), F.lit(1.0)))
    stat = agg.withColumn("W", w)
    x, ln_n = n.cast("double"), F.ln(n.cast("double"))
    gap = F.ln(F.greatest(1 - F.col("W"), F.lit(1e-300)))
    gamma = _poly(SW_GAMMA, x)
    z = (
        F.when((n <= 11) & (gap >= gamma), F.lit(1e10))
        .when(n <= 11, (-F.ln(gamma - gap) - _poly(SW_SMALL_MEAN, x)) / F.exp(_poly(SW_SMALL_SD, x)))
        .otherwise((gap - _poly(SW_LARGE_MEAN, ln_n)) / F.exp(_poly(SW_LARGE_SD, ln_n)))
    )
    exact3 = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt("W")) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    out = stat.withColumn("p", F.when(n == 3, exact3).otherwise(tails.p_column("normal", z)))
    out = out.select(*key, "n", "W", "p", (n <= SW_MAX).alias("p_in_range"))
    if not by:
        return out.drop("__one")
    return join_on(sizes.drop("mean"), out.drop("n"), by)


def long_form(df: DataFrame, values: dict, group: str) -> DataFrame:
    """``(variable, group, y)`` without missing values, one scan for all variables."""
    items = [F.struct(F.lit(n).alias("variable"), c.cast("double").alias("y")) for n, c in values.items()]
    out = df.select(F.col(group).cast("string").alias("group"), F.explode(F.array(*items)).alias("e"))
    return out.select("e.variable", "group", "e.y").filter(is_present("y") & F.col("group").isNotNull())


def _one_way(stats: DataFrame) -> DataFrame:
    """F of a one-way layout from ``(variable, n, mean, ss)`` rows, one per group."""
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    out = stats.groupBy("variable").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum("ss").alias("within"), grand.alias("grand"),
        F.collect_list(F.struct("n", "mean")).alias("g"))
    between = F.aggregate("g", F.lit(0.0), lambda a, e: a + e["n"] * (e["mean"] - F.col("grand")) ** 2)
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    f = F.when((F.col("within") > 0) & (df1 > 0) & (df2 > 0), (between / df1) / (F.col("within") / df2))
    return out.select("variable", df1.cast("long").alias("df1"), df2.cast("long").alias("df2"), f.alias("F"))


def _group_stats(long: DataFrame, y: str) -> DataFrame:
    return long.groupBy("variable", "group").agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("ss"))


def abs_dev_from_group_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Absolute distance of each value from its group's exact median."""
    med = quantiles(df, value, {"__median": 0.5}, by).drop("n")
    return join_on(df, med, by).withColumn("z", F.abs(F.col(value) - F.col("__median"))).drop("__median")


def levene(df: DataFrame, values: dict, group: str) -> DataFrame:
    """Median-centred one-way F on absolute deviations, for several variables in one pass."""
    z = abs_dev_from_group_median(long_form(df, values, group), "y", ["variable", "group"])
    out = _one_way(_group_stats(z, "z"))
    return out.withColumn("p", tails.p_column("f", "F", "df1", "df2"))


def two_group_test(df: DataFrame, values: dict, group: str) -> DataFrame:
    """Pooled t of the second against the first group (alphabetical), for several variables in one pass."""
    stats = _group_stats(long_form(df, values, group), "y")
    sides = stats.groupBy("variable").agg(F.array_sort(F.collect_list(F.struct("group", "n", "mean", "ss"))).alias("g"))
    two = sides.filter(F.size("g") == 2).select("variable", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"))
    df_ = F.col("a.n") + F.col("b.n") - 2
    s2 = F.when(df_ > 0, (F.col("a.ss") + F.col("b.ss")) / df_)
    se = F.sqrt(s2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    est = F.col("b.mean") - F.col("a.mean")
    out = two.select(
        "variable", F.col("a.mean").alias("intercept"), est.alias("estimate"), se.alias("std_error"),
        F.when(se > 0, est / se).alias("t"), df_.cast("long").alias("df"))
    return out.withColumn("p", tails.p_column("t", "t", "df"))


def _exact_rank_sum(w: float, m: int, n: int) -> float:
    """Two-sided p of the rank-sum statistic without ties, from the counts of subsets by sum."""
    ways = np.zeros((m + 1, m * n + 1))
    ways[0, 0] = 1.0
    for v in range(1, m + n + 1):
        for size in range(min(m, v), 0, -1):
            # choosing rank v as the size-th smallest adds v - size to the statistic
            shift = v - size
            if shift <= m * n:
                ways[size, shift:] += ways[size - 1, : m * n + 1 - shift]
    # a rank below its own place in the subset cannot occur, so every subset is counted once
    prob = ways[m] / ways[m].sum()
    k = int(round(w))
    tail = prob[k:].sum() if w > m * n / 2 else prob[: k + 1].sum()
    return float(min(1.0, 2 * tail))


def rank_sum(df: DataFrame, value: str, group: str) -> DataFrame:
    """Wilcoxon rank-sum test of the first against the second group (alphabetical).

    Exact below 50 values per group without ties, otherwise the normal approximation with tie and
    continuity correction. Ranks come from counted values, without a global sort.
    """
    src = df.filter(is_present(value) & F.col(group).isNotNull()).select(
        F.col(value).cast("double").alias("v"), F.col(group).cast("string").alias("g"))
    counted = cut_lineage(src.groupBy("v", "g").agg(F.count(F.lit(1)).alias("k")))
    ranks = cut_lineage(avg_rank(counted, "v", weight="k"))
    per = counted.join(ranks, "v")
    sides = {r["g"]: r for r in per.groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r")).collect()}
    if len(sides) != 2:
        raise ValueError("the rank-sum test compares two groups")
    ties = ranks.agg(F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt"))).first()[0]
    first, second = (sides[k] for k in sorted(sides))
    m, n = first["n"], second["n"]
    w = first["r"] - m * (m + 1) / 2
    if m < 50 and n < 50 and ties == 0:
        p, method = _exact_rank_sum(w, m, n), "exact"
    else:
        total = m + n
        sd = math.sqrt(m * n / 12 * (total + 1 - ties / (total * (total - 1))))
        z = w - m * n / 2
        z = (z - math.copysign(0.5, z) if z else 0.0) / sd if sd > 0 else math.nan
        p, method = 2 * min(tails.normal_upper(z), tails.normal_upper(-z)), "normal"
    return df.sparkSession.createDataFrame([(w, m, n, p, method)], "W double, m long, n long, p double, method string")
