"""The registry of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round the double columns (and drop the sign of a zero), so order of summation does not show."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``fn(views) -> DataFrame``; ``views`` gives the input tables and the views built on them."""

    def wrap(fn):
        from .bindings import Views

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Views(spark, sf_dir)), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        # for callers that share one set of views between queries
        run.on_views = lambda views: tidy(fn(views), digits)
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def check(body: str, doubles: str = "", keep: str = "", digits: int = DIGITS) -> str:
    """The SQL of a query: ``body`` over the views it names, double columns rounded like the query's."""
    from .bindings import SQL_VIEWS

    needed: list[str] = []

    def need(text: str):
        for view, definition in SQL_VIEWS.items():
            if view in needed or f"{view}" not in text:
                continue
            need(definition)
            if view not in needed:
                needed.append(view)

    need(body)
    ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in needed)
    cols = ", ".join([*keep.split(), *[f"round(CAST({d} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {d}" for d in doubles.split()]]) or "*"
    return f"WITH {ctes + ', ' if ctes else ''}answer AS ({body}) SELECT {cols} FROM answer"
