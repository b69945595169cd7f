"""Exact ranks and quantiles without a one-task sort.

Equal values of a group are first counted together. A bounded quantile sketch then cuts the value
range in buckets, so the running count of a group is summed per (group, bucket) and offset by the
totals of the group's lower buckets. However many rows one group holds, each window sees one
bucket's distinct values of it.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import is_present
from ..session import store

MAX_BUCKETS = 10_000
VALUES_PER_BUCKET = 100_000


def _bounds(counted: DataFrame, value: str) -> list[float]:
    """Ends of the buckets: as many as the counted values need, and a quantile sketch for where they lie."""
    k = min(MAX_BUCKETS, math.ceil(counted.count() / VALUES_PER_BUCKET))
    cuts = []
    if k > 1:
        probs = [i / k for i in range(1, k)]
        cuts = counted.agg(F.percentile_approx(value, probs, 10 * k).alias("b")).first()["b"] or []
    return [float("-inf"), *sorted({b for b in cuts if abs(b) != float("inf")}), float("inf")]


def positions(df: DataFrame, value: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Per group and distinct value: ``cnt`` rows, the 1-based rank ``lo`` of the first, the group's ``n``.

    Missing values are left out. ``weight`` names a column that already counts rows.
    """
    by = list(by)
    # stored once: the sketch, the bucket totals and the running counts all read it
    counted = store(
        df.filter(is_present(value))
        .groupBy(*by, F.col(value).cast("double").alias("v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt"))
    )
    splits = _bounds(counted, "v")
    before = Window.unboundedPreceding
    if len(splits) == 2:
        # no more values than one bucket holds: the group itself is the bucket
        up_to = Window.partitionBy(*by).orderBy("v").rowsBetween(before, -1)
        lo = F.coalesce(F.sum("cnt").over(up_to), F.lit(0)) + 1
        n = F.sum("cnt").over(Window.partitionBy(*by))
        return counted.select(*by, F.col("v").alias(value), "cnt", lo.alias("lo"), n.alias("n"))
    bucketed = Bucketizer(splits=splits, inputCol="v", outputCol="__b").transform(counted)
    per_bucket = bucketed.groupBy(*by, "__b").agg(F.sum("cnt").alias("__t"))
    # one row per (group, bucket): at most MAX_BUCKETS rows per group enter this window
    lower = Window.partitionBy(*by).orderBy("__b").rowsBetween(before, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *[F.col(c).alias(f"__o_{c}") for c in by],
        F.col("__b").alias("__o_b"),
        F.coalesce(F.sum("__t").over(lower), F.lit(0)).alias("__before"),
        F.sum("__t").over(whole).alias("n"),
    )
    inside = Window.partitionBy(*by, "__b").orderBy("v").rowsBetween(before, -1)
    ranked = bucketed.withColumn("__in", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    cond = F.col("__b") == F.col("__o_b")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return ranked.join(offsets, cond).select(
        *by, F.col("v").alias(value), "cnt", (F.col("__before") + F.col("__in") + 1).alias("lo"), "n"
    )


def avg_rank(df: DataFrame, value: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Mid-rank of every distinct value: tied values share the mean of their positions."""
    return positions(df, value, by, weight).withColumn("rank", F.col("lo") + (F.col("cnt") - 1) / F.lit(2.0))


def _between(low, high, weight):
    """Between two order statistics; an infinite one is not moved towards itself."""
    return F.when((weight > 0) & (low != high), low * (1 - weight) + high * weight).otherwise(low)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Exact quantiles per group, linear between the two closest order statistics."""
    pos = positions(df, value, by)
    aggs = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p)) + 1
        at = lambda k: F.max(F.when((F.col("lo") <= k) & (k < F.col("lo") + F.col("cnt")), F.col(value)))
        aggs += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"__w_{name}")]
    out = pos.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    return out.select(
        *by,
        "n",
        *[
            _between(F.col(f"__lo_{q}"), F.col(f"__hi_{q}"), F.col(f"__w_{q}")).alias(q)
            for q in probs
        ],
    )


def summary_by(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean and maximum per group."""
    pos = positions(df, value, by).withColumn("__v", F.col(value))
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    aggs = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(p) + 1
        at = lambda k: F.max(F.when((F.col("lo") <= k) & (k < F.col("lo") + F.col("cnt")), F.col("__v")))
        aggs.append(_between(at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))).alias(name))
    mean = (F.sum(F.col("__v") * F.col("cnt")) / F.sum("cnt")).alias("mean")
    return pos.groupBy(*by).agg(F.max("n").alias("n"), *aggs, mean)
