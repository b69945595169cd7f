"""Design terms and the one-pass cross-product matrix every linear model is fitted from."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import as_col, is_present

WIDE = 16
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Term:
    """A model term: its design columns and the variables it is made of (for marginality)."""

    name: str
    columns: tuple[tuple[str, Column], ...]
    parts: frozenset[str]

    @property
    def column_names(self) -> list[str]:
        return [n for n, _ in self.columns]


def var(name: str, expr=None) -> Term:
    """A numeric variable, transformed when ``expr`` is given."""
    return Term(name, ((name, as_col(expr if expr is not None else name).cast("double")),), frozenset([name]))


def factor(df: DataFrame, name: str) -> Term:
    """Indicator columns for all levels but the first in alphabetical order."""
    text = F.col(name).cast("string")
    levels = [r[0] for r in df.select(text.alias("v")).filter("v is not null").distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{name} has more than {MAX_LEVELS} levels")
    cols = tuple((f"{name}{lv}", F.when(text.isNotNull(), (text == lv).cast("double"))) for lv in levels[1:])
    return Term(name, cols, frozenset([name]))


def interact(*terms: Term) -> Term:
    """Products of the terms' columns."""
    cols = []
    for combo in product(*[t.columns for t in terms]):
        expr = combo[0][1]
        for _, c in combo[1:]:
            expr = expr * c
        cols.append((":".join(n for n, _ in combo), expr))
    return Term(":".join(t.name for t in terms), tuple(cols), frozenset().union(*[t.parts for t in terms]))


def full_factorial(terms: list[Term]) -> list[Term]:
    """Main effects, then all interactions by order: the ``a * b * c`` design."""
    orders = range(1, len(terms) + 1)
    return [c[0] if k == 1 else interact(*c) for k in orders for c in combinations(terms, k)]


def columns_of(terms: list[Term]) -> dict[str, Column]:
    return {n: c for t in terms for n, c in t.columns}


@dataclass(frozen=True)
class Gram:
    """n, means and centred cross-products of named columns."""

    names: list[str]
    n: int
    mean: np.ndarray
    m: np.ndarray

    def index(self, names) -> list[int]:
        return [self.names.index(x) for x in names]

    def block(self, rows, cols) -> np.ndarray:
        return self.m[np.ix_(self.index(rows), self.index(cols))]

    def correlation(self) -> np.ndarray:
        s = np.sqrt(np.diag(self.m))
        return self.m / np.outer(s, s)


def design(df: DataFrame, columns: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """The complete cases of the design columns, next to the kept ones."""
    out = df.select(*keep, *[c.cast("double").alias(n) for n, c in columns.items()])
    for n in columns:
        out = out.filter(is_present(f"`{n}`"))
    return out


def _pairs(p: int):
    return [(a, b) for a in range(p) for b in range(a, p)]


def _narrow(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    means = ", ".join(f"avg(`{n}`)" for n in names)
    covs = ", ".join(f"covar_pop(`{names[a]}`, `{names[b]}`)" for a, b in _pairs(len(names)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"array({means})").alias("mean"), F.expr(f"array({covs})").alias("cov")
    ).select(*by, "n", "mean", F.transform("cov", lambda c: c * F.col("n")).alias("m"))


def _wide(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Partial matrices per partition about a common shift, summed by position: for designs too wide for one aggregate."""
    p = len(names)
    shift = np.array(df.agg(*[F.avg(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).first(), dtype=float)
    shift = np.where(np.isfinite(shift), shift, 0.0)
    iu = np.triu_indices(p)
    width = 1 + p + len(iu[0])

    def partial(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for key, g in groups:
                x = g[names].to_numpy(float) - shift
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[iu]])
                key = key if isinstance(key, tuple) else (key,)
                acc[key] = acc[key] + flat if key in acc else flat
        for key, flat in acc.items():
            yield pd.DataFrame({**{b: [k] * width for b, k in zip(by, key)}, "pos": range(width), "s": flat})

    keys = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    cells = df.select(*by, *[f"`{n}`" for n in names]).mapInPandas(partial, f"{keys}pos int, s double")
    summed = cells.groupBy(*by, "pos").agg(F.sum("s").alias("s"))
    row = summed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("a"))
    pairs = _pairs(p)
    first = F.array(*[F.lit(a) for a, _ in pairs])
    second = F.array(*[F.lit(b) for _, b in pairs])
    n = F.get("a", F.lit(0))
    centred = F.zip_with(
        F.slice("a", p + 2, len(pairs)),
        F.zip_with(first, second, lambda x, y: F.get("a", x + 1) * F.get("a", y + 1) / n),
        lambda s, c: s - c,
    )
    mean = F.zip_with(F.slice("a", 2, p), F.array(*[F.lit(float(v)) for v in shift]), lambda s, v: s / n + v)
    return row.select(*by, n.cast("long").alias("n"), mean.alias("mean"), centred.alias("m"))


def gram_rows(df: DataFrame, columns: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """One row per group: ``n``, ``mean`` and the upper triangle ``m`` of the centred cross-products."""
    src = design(df, columns, list(by))
    build = _narrow if len(columns) <= WIDE else _wide
    return build(src, list(columns), list(by))


def unpack(names: list[str], n, mean, m) -> Gram:
    p = len(names)
    full = np.zeros((p, p))
    iu = np.triu_indices(p)
    full[iu] = np.asarray(m, dtype=float)
    full = full + np.triu(full, 1).T
    return Gram(list(names), int(n), np.asarray(mean, dtype=float), full)


def gram(df: DataFrame, columns: dict[str, Column]) -> Gram:
    """The p x p matrix on the driver: the only thing a fit collects."""
    row = gram_rows(df, columns).first()
    if row is None or row["n"] == 0:
        raise ValueError("no complete case")
    g = unpack(list(columns), row["n"], row["mean"], row["m"])
    if not np.all(np.isfinite(g.m)):
        raise ValueError("infinite values in the design")
    return g
