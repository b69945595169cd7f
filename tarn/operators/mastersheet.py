"""Rates, years, chemistry and sample metadata joined into the tables the models read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import join_on, not_in


def mastersheet(
    chemistry: DataFrame, rate_table: DataFrame, years: DataFrame, suva: DataFrame,
    exclude=(), require_rate: str | None = None,
) -> DataFrame:
    """One row per lake and year of the chemistry sheet, with rates, SUVA and proton concentration."""
    dated = join_on(rate_table, years, ["lake_name"], "full")
    out = join_on(chemistry, dated, ["lake_name", "Year"], "left")
    out = join_on(out, suva, ["lake_name"], "left").withColumn("proton_M", F.pow(F.lit(10.0), -F.col("pH")))
    if exclude:
        out = out.filter(not_in("lake_name", exclude))
    return out.na.drop(subset=[require_rate]) if require_rate else out


def env_table(
    metadata: DataFrame, rate_table: DataFrame, years: DataFrame, suva: DataFrame, columns: list[str],
    renames: dict[str, str] | None = None, exclude=(), require_rate: str | None = None,
) -> DataFrame:
    """One row per sequenced sample with chemistry, rates and SUVA.

    ``renames`` replaces a piece of a lake name wherever it occurs in the rate table.
    """
    dated = join_on(rate_table, years, ["lake_name"], "full")
    for old, new in (renames or {}).items():
        dated = dated.withColumn("lake_name", F.replace(F.col("lake_name"), F.lit(old), F.lit(new)))
    out = join_on(metadata, dated, ["lake_name", "Year"], "left")
    out = join_on(out, suva, ["lake_name"], "left").select(*columns)
    if exclude:
        out = out.filter(not_in("lake_name", exclude))
    return out.na.drop(subset=[require_rate]) if require_rate else out


def detected(df: DataFrame, c: str = "kd_24", name: str = "kd_observed") -> DataFrame:
    """Label lakes by whether the constant differs from zero; lakes without one are dropped."""
    return df.filter(F.col(c).isNotNull()).withColumn(name, F.when(F.col(c) != 0, "YES").otherwise("NO"))
