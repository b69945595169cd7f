"""Small table operators shared by the analyses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import as_col, is_present


def select_first(df: DataFrame, first: list[str], drop: list[str] = ()) -> DataFrame:
    """The named columns first, then all others, without the dropped ones."""
    rest = [c for c in df.columns if c not in first and c not in drop]
    return df.select(*first, *rest)


def set_key(df: DataFrame, key: str) -> DataFrame:
    """The table with ``key`` as its key; a missing or repeated key fails the query that reads the result."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in df.columns if c != key])
    guard = F.when(
        F.col(key).isNull() | (F.col("__n") > 1),
        F.raise_error(F.concat(F.lit(f"{key} is no key: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))).cast("string"),
    )
    return per_key.filter(guard.isNull()).select(*df.columns)


def split_by(df: DataFrame, predicate: Column, yes: str, no: str, name: str = "group") -> DataFrame:
    """Label both sides of a predicate in one scan; rows for which it is NULL count as ``no``."""
    return df.withColumn(name, F.when(F.coalesce(predicate, F.lit(False)), F.lit(yes)).otherwise(F.lit(no)))


def known(c, unknown=("", "uncharacterized")) -> Column:
    c = as_col(c)
    return c.isNotNull() & ~c.isin(*unknown)


def mean_by(df: DataFrame, c: str, by: list[str], alias: str | None = None) -> DataFrame:
    """Group mean; missing values are dropped first, so a group of them vanishes."""
    return df.filter(F.col(c).isNotNull()).groupBy(*by).agg(F.avg(c).alias(alias or c))


def value_at(value, at: Column) -> Column:
    """The group's value where ``at`` holds, as an aggregate."""
    return F.max(F.when(at, as_col(value)))


def freq_table(df: DataFrame, c: str, keep_null: bool = True) -> DataFrame:
    src = df if keep_null else df.filter(F.col(c).isNotNull())
    return src.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Counts and density of ``bins`` equal ranges between the minimum and the maximum; infinite values are an error."""
    x = F.col(c).cast("double")
    src = df.filter(is_present(c)).select(x.alias("x"))
    lo, hi, n = src.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        raise ValueError(f"{c} holds no number")
    if math.isinf(lo) or math.isinf(hi):
        raise ValueError(f"{c} holds infinite values, which no range of equal width covers")
    width = (hi - lo) / bins
    which = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
    return (
        src.groupBy(which.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * width).alias("left"),
            (F.lit(lo) + (F.col("bin") + 1) * width).alias("right"),
            "count",
            (F.col("count") / (n * width) if width > 0 else F.lit(None).cast("double")).alias("density"),
        )
    )
