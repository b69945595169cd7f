"""Parsing of sample names, dates, lineages and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .compat import as_col

# The patterns of the sample-name convention "<lake> <treatment><time>".
LAKE_PATTERN = r"\p{Alnum}*(?=\p{Blank})"
CONDITION_PATTERN = r"(?<=\p{Blank})\p{Alnum}*"
TIME_PATTERN = r"[0-9]*$"
TREATMENT_PATTERN = r"\p{Alpha}*"

# The seven taxonomic ranks.
RANKS = ["Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species"]


def lake_of(name) -> Column:
    """The run of letters and digits before the first blank; NULL when there is no blank."""
    name = as_col(name)
    return F.when(name.rlike(r"\p{Blank}"), F.regexp_extract(name, LAKE_PATTERN, 0))


def condition_of(name) -> Column:
    name = as_col(name)
    return F.when(name.rlike(r"\p{Blank}"), F.regexp_extract(name, CONDITION_PATTERN, 0))


def time_of(condition) -> Column:
    """Trailing digits, "" when there are none."""
    return F.regexp_extract(as_col(condition), TIME_PATTERN, 0)


def treatment_of(condition) -> Column:
    """Leading letters, "" when there are none."""
    return F.regexp_extract(as_col(condition), TREATMENT_PATTERN, 0)


def day_month_year(day, month, year) -> Column:
    """Date from three text parts, the month as number or name; NULL when malformed."""
    text = F.concat_ws("-", F.trim(as_col(day)), F.trim(as_col(month)), F.trim(as_col(year)))
    return F.coalesce(F.try_to_date(text, "d-M-yyyy"), F.try_to_date(text, "d-MMMM-yyyy"))


def upper_all(df: DataFrame) -> DataFrame:
    """Upper-case the text columns; typed columns stay typed."""
    return df.select(
        *[F.upper(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    )


def split_lineage(df: DataFrame, lineage: str, ranks=RANKS, sep: str = ";", trim: bool = False) -> DataFrame:
    """One column per rank; short lineages are padded with NULL, further pieces are dropped."""
    parts = F.split(F.col(lineage), sep)
    piece = (lambda i: F.trim(F.get(parts, F.lit(i)))) if trim else (lambda i: F.get(parts, F.lit(i)))
    return df.select(*[c for c in df.columns if c != lineage], *[piece(i).alias(r) for i, r in enumerate(ranks)])


def percent_label(axis: str, of_fitted, of_total, digits: int = 2) -> Column:
    """Axis text such as ``CAP 1 (61.2 % of fitted, 20.1 % of total variation)``."""
    pct = lambda c: F.regexp_replace(F.round(as_col(c) * 100, digits).cast("string"), r"\.0$", "")
    return F.concat(
        F.lit(f"{axis} ("), pct(of_fitted), F.lit(" % of fitted, "), pct(of_total), F.lit(" % of total variation)")
    )


def bin_label(c, breaks: list[float], labels: list[str]) -> Column:
    """Label of the half-open range (low, high] a number falls in; NULL outside all ranges."""
    c = as_col(c)
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(breaks[:-1], breaks[1:], labels))):
        out = F.when((c > low) & (c <= high), F.lit(label)).otherwise(out)
    return out
