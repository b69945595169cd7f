"""Linear models from a Gram matrix: fit, stepwise selection, nested comparison, assumption tests.

Fitting never returns to the rows: every model of a search is a block of one matrix. Rows are read
again only where a residual of each row is needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.compat import as_col, is_present, join_on
from .gram import Gram, Term, columns_of, design, gram, gram_rows, unpack
from .order_stats import avg_rank, quantiles

# Fixed value: a column whose part orthogonal to the earlier ones is below this share of its own
# sum of squares counts as a combination of them.
ALIAS_TOLERANCE = 1e-10


def independent(g: Gram, names: list[str]) -> list[str]:
    """The columns, in order, that are no linear combination of earlier ones."""
    kept: list[str] = []
    m = g.block(names, names).copy()
    own = np.diag(m).copy()
    for k, name in enumerate(names):
        if own[k] > 0 and m[k, k] > ALIAS_TOLERANCE * own[k]:
            kept.append(name)
            m = m - np.outer(m[:, k], m[k, :]) / m[k, k]
    return kept


@dataclass(frozen=True)
class Fit:
    """An ordinary least-squares fit of ``y`` on an intercept and ``names``."""

    y: str
    names: list[str]
    aliased: list[str]
    n: int
    coef: np.ndarray
    cov: np.ndarray
    rss: float
    tss: float

    @property
    def df_model(self) -> int:
        return len(self.names)

    @property
    def df_residual(self) -> int:
        return self.n - 1 - len(self.names)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else math.nan

    @property
    def adj_r2(self) -> float:
        return adj_r2(self.r2, self.n, self.df_model)

    @property
    def sigma(self) -> float:
        return math.sqrt(self.rss / self.df_residual) if self.df_residual > 0 else math.nan

    @property
    def f(self) -> float:
        if not self.names or self.df_residual <= 0:
            return math.nan
        return (self.tss - self.rss) / self.df_model / (self.rss / self.df_residual) if self.rss > 0 else math.inf

    @property
    def aic(self) -> float:
        """n ln(RSS/n) + 2 edf, the criterion of the stepwise search."""
        return self.n * math.log(self.rss / self.n) + 2 * (1 + self.df_model) if self.rss > 0 else -math.inf

    def rows(self) -> list[tuple]:
        """(term, estimate, std_error, t, p) with the intercept first; aliased terms are missing values."""
        se = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        out = []
        for name, b, s in zip(["(Intercept)", *self.names], self.coef, se):
            b, s = float(b), float(s)
            t = b / s if s > 0 else math.nan
            out.append((name, b, s, t, tails.t_two_sided(t, self.df_residual)))
        return out + [(a, None, None, None, None) for a in self.aliased]

    def fitted(self, columns: dict[str, Column] | None = None) -> Column:
        """The fitted value as a column expression."""
        col = lambda n: columns[n] if columns else F.col(f"`{n}`")
        out = F.lit(float(self.coef[0]))
        for n, b in zip(self.names, self.coef[1:]):
            out = out + F.lit(float(b)) * col(n)
        return out


def adj_r2(r2: float, n: int, m: int) -> float:
    return 1 - (1 - r2) * (n - 1) / (n - m - 1) if n - m - 1 > 0 else math.nan


def fit_gram(g: Gram, y: str, names: list[str]) -> Fit:
    kept = independent(g, names)
    tss = float(g.block([y], [y])[0, 0])
    inv, b, rss = np.zeros((0, 0)), np.zeros(0), tss
    mean_y = float(g.mean[g.names.index(y)])
    if kept:
        s = g.block(kept, kept)
        xy = g.block(kept, [y])[:, 0]
        scale = np.sqrt(np.diag(s))
        inv = np.linalg.inv(s / np.outer(scale, scale)) / np.outer(scale, scale)
        b = inv @ xy
        rss = max(tss - float(b @ xy), 0.0)
    means = g.mean[g.index(kept)] if kept else np.zeros(0)
    dfr = g.n - 1 - len(kept)
    s2 = rss / dfr if dfr > 0 else math.nan
    cross = -inv @ means
    full = np.block([[np.array([[1 / g.n + means @ inv @ means]]), cross[None, :]], [cross[:, None], inv]])
    coef = np.concatenate([[mean_y - float(b @ means)], b])
    return Fit(y, kept, [x for x in names if x not in kept], g.n, coef, s2 * full, rss, tss)


@dataclass(frozen=True)
class Model:
    """A fit with the terms and the response it came from."""

    y: Term
    terms: list[Term]
    gram: Gram
    fit: Fit

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.fit.rows(), "term string, estimate double, std_error double, t double, p double")

    def summary(self, spark: SparkSession) -> DataFrame:
        f = self.fit
        p = tails.f_upper(f.f, f.df_model, f.df_residual)
        row = (f.n, f.df_model, f.df_residual, f.r2, f.adj_r2, f.sigma, f.f, p, f.rss, f.aic)
        return spark.createDataFrame(
            [row], "n long, df_model int, df_residual int, r2 double, adj_r2 double, sigma double, f double,"
            " p double, rss double, aic double")

    def residuals(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``keep`` + design columns + ``y``, ``fitted`` and ``residual`` for every complete case."""
        src = design(df, {**columns_of([self.y]), **columns_of(self.terms)}, list(keep))
        y = F.col(f"`{self.fit.y}`")
        return src.withColumn("fitted", self.fit.fitted()).withColumn("residual", y - F.col("fitted"))


def ols(df: DataFrame, y: Term, terms: list[Term]) -> Model:
    """Least squares on the complete cases of the model columns, one pass over the data."""
    g = gram(df, {**columns_of([y]), **columns_of(terms)})
    return Model(y, terms, g, fit_gram(g, y.name, [n for t in terms for n in t.column_names]))


def refit(model: Model, terms: list[Term]) -> Model:
    """A submodel on the same cases, without touching the data."""
    names = [n for t in terms for n in t.column_names]
    return Model(model.y, terms, model.gram, fit_gram(model.gram, model.y.name, names))


def _addable(term: Term, current: list[Term], scope: list[Term]) -> bool:
    """All lower-order terms of the scope that ``term`` contains are in the model."""
    names = {t.name for t in current}
    return all(s.name in names for s in scope if s.parts < term.parts)


def _droppable(term: Term, current: list[Term]) -> bool:
    return not any(term.parts < t.parts for t in current)


def step_aic(model: Model, scope: list[Term] | None = None, direction: str = "both", limit: int = 1000):
    """Stepwise search by AIC that keeps the hierarchy of interactions.

    Returns the chosen model and the list of steps ``(action, term, aic)``; a search that needs more than ``limit`` steps is an error.
    """
    upper = list(scope if scope is not None else model.terms)
    current, path = model, [("start", "", model.fit.aic)]
    while True:
        moves = [("", "", current)]
        if direction in ("both", "backward"):
            moves += [("-", t.name, refit(model, [c for c in current.terms if c.name != t.name]))
                      for t in current.terms if _droppable(t, current.terms)]
        if direction in ("both", "forward"):
            have = {t.name for t in current.terms}
            moves += [("+", t.name, refit(model, [u for u in upper if u.name in have | {t.name}]))
                      for t in upper if t.name not in have and _addable(t, current.terms, upper)]
        best = min(moves, key=lambda m: m[2].fit.aic)
        if not best[0] or best[2].fit.aic >= current.fit.aic - 1e-7:
            return current, path
        if len(path) > limit:
            raise RuntimeError(f"the search has not ended after {limit} steps")
        current = best[2]
        path.append((best[0], best[1], current.fit.aic))


def anova_nested(small: Model, large: Model) -> dict[str, float]:
    """F test of two nested models fitted to the same cases; others are refused."""
    if not set(small.fit.names) <= set(large.fit.names) or small.fit.n != large.fit.n:
        raise ValueError("the models are not nested")
    df1 = large.fit.df_model - small.fit.df_model
    df2 = large.fit.df_residual
    if df1 == 0:
        raise ValueError("the models are the same")
    f = (small.fit.rss - large.fit.rss) / df1 / (large.fit.rss / df2)
    return {"df1": df1, "df2": df2, "f": f, "p": tails.f_upper(f, df1, df2)}


def breusch_pagan(model: Model, df: DataFrame) -> dict[str, float]:
    """Studentised test on the fitted values: n times R2 of the squared residuals on them."""
    row = model.residuals(df).agg(
        F.count(F.lit(1)).alias("n"), F.regr_r2(F.col("residual") ** 2, F.col("fitted")).alias("r2")
    ).first()
    bp = row["n"] * row["r2"] if row["r2"] is not None else math.nan
    return {"statistic": bp, "df": 1, "p": tails.chi2_upper(bp, 1.0)}


def reset_test(model: Model, df: DataFrame, powers=(2, 3)) -> dict[str, float]:
    """F test of adding powers of every regressor."""
    extra = [Term(f"{n}^{k}", ((f"{n}^{k}", c ** k),), t.parts)
             for k in powers for t in model.terms for n, c in t.columns if n in model.fit.names]
    large = ols(df, model.y, [*model.terms, *extra])
    return anova_nested(refit(large, model.terms), large)


def model_rows(rows: DataFrame, y: str, terms: list[Term], by: list[str], stepwise: bool = False) -> DataFrame:
    """Coefficients and fit statistics of one model per group, from one Gram row per group.

    The terms' names and marginality decide the search; no column of the data is read. A group with an infinite
    value has its rows too, with NULL for all but ``n``.
    """
    names = [y] + [n for t in terms for n in t.column_names]
    plain = [Term(t.name, tuple((n, None) for n in t.column_names), t.parts) for t in terms]
    response = Term(y, ((y, None),), frozenset([y]))

    def solve(batches):
        for pdf in batches:
            out, at = [], {c: i for i, c in enumerate(pdf.columns)}
            for r in pdf.itertuples(index=False, name=None):
                g = unpack(names, r[at["n"]], r[at["mean"]], r[at["m"]])
                keys = [r[at[b]] for b in by]
                if not np.all(np.isfinite(g.m)):
                    out += [(*keys, r[at["n"]], term, *[None] * 10) for term in ["(Intercept)", *names[1:]]]
                    continue
                model = Model(response, plain, g, fit_gram(g, y, names[1:]))
                if stepwise:
                    model, _ = step_aic(model)
                f = model.fit
                out += [(*keys, f.n, *t, f.r2, f.adj_r2, f.sigma, f.f, f.rss, f.df_residual) for t in f.rows()]
            yield pd.DataFrame(out, columns=[*by, *[c.split()[0] for c in tail]])

    tail = ["n long", "term string", "estimate double", "std_error double", "t double", "p double", "r2 double",
            "adj_r2 double", "sigma double", "f double", "rss double", "df_residual int"]
    keys = [f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by]
    return rows.mapInPandas(solve, ", ".join(keys + tail))


def model_per_group(df: DataFrame, y: Term, terms: list[Term], by: list[str], stepwise: bool = False) -> DataFrame:
    """One model per group; all groups share one pass and one shuffle of Gram rows."""
    rows = gram_rows(df, {**columns_of([y]), **columns_of(terms)}, by)
    return model_rows(rows, y.name, terms, by, stepwise)


def group_residuals(df: DataFrame, y: Term, terms: list[Term], by: list[str], coefs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Fitted values and residuals of :func:`model_per_group` models: a term that a group left out counts as zero, and both
    are NULL in a group without a fit. NULL is a group like any other."""
    names = [n for t in terms for n in t.column_names]
    wide = coefs.groupBy(*by).agg(
        F.max(F.when(F.col("term") == "(Intercept)", F.col("estimate"))).alias("__b0"),
        *[F.coalesce(F.max(F.when(F.col("term") == n, F.col("estimate"))), F.lit(0.0)).alias(f"__b{i + 1}") for i, n in enumerate(names)])
    src = join_on(design(df, {**columns_of([y]), **columns_of(terms)}, [*by, *keep]), wide, by, "inner")
    fitted = F.col("__b0")
    for i, n in enumerate(names):
        fitted = fitted + F.col(f"__b{i + 1}") * F.col(f"`{n}`")
    out = src.withColumn("fitted", fitted).withColumn("residual", F.col(f"`{y.name}`") - F.col("fitted"))
    return out.drop(*[f"__b{i}" for i in range(len(names) + 1)])


def breusch_pagan_by(residuals: DataFrame, by: list[str]) -> DataFrame:
    stat = residuals.groupBy(*by).agg(
        (F.count(F.lit(1)) * F.regr_r2(F.col("residual") ** 2, F.col("fitted"))).alias("statistic"))
    return stat.withColumn("p", tails.p_column("chi2", "statistic", F.lit(1.0)))


def _nested_rows(rows: DataFrame, y: str, names: list[str], small: list[str], extra, by: list[str]) -> DataFrame:
    """``by``, df1, df2, f and p of the test that adds ``extra(kept)`` to ``small``, from one Gram row of ``names`` per group.

    ``kept``: the columns of ``small`` that the group can tell apart. A group without a test (an infinite value, too few rows,
    nothing added) has NULLs.
    """
    def solve(batches):
        for pdf in batches:
            out, at = [], {c: i for i, c in enumerate(pdf.columns)}
            for r in pdf.itertuples(index=False, name=None):
                g = unpack(names, r[at["n"]], r[at["mean"]], r[at["m"]])
                found = (None, None, None, None)
                if np.all(np.isfinite(g.m)):
                    a = fit_gram(g, y, small)
                    b = fit_gram(g, y, [*small, *extra(a.names)])
                    df1, df2 = b.df_model - a.df_model, b.df_residual
                    if df1 > 0 and df2 > 0:
                        f = (a.rss - b.rss) / df1 / (b.rss / df2) if b.rss > 0 else math.inf if a.rss > 0 else math.nan
                        found = (df1, df2, f, tails.f_upper(f, df1, df2))
                out.append((*[r[at[c]] for c in by], *found))
            yield pd.DataFrame(out, columns=[*by, "df1", "df2", "f", "p"])

    keys = [f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by]
    return rows.mapInPandas(solve, ", ".join([*keys, "df1 int", "df2 int", "f double", "p double"]))


def anova_nested_by(df: DataFrame, y: Term, small: list[Term], large: list[Term], by: list[str]) -> DataFrame:
    """:func:`anova_nested` for every group, on the cases complete in ``large``: one pass and one shuffle of Gram rows."""
    few, many = list(columns_of(small)), list(columns_of(large))
    if not set(few) < set(many):
        raise ValueError("the models are not nested")
    added = [n for n in many if n not in few]
    rows = gram_rows(df, {**columns_of([y]), **columns_of(large)}, by)
    return _nested_rows(rows, y.name, [y.name, *many], few, lambda kept: added, by)


def reset_test_by(df: DataFrame, y: Term, terms: list[Term], by: list[str], powers=(2, 3)) -> DataFrame:
    """:func:`reset_test` for every group, from one pass and one shuffle of Gram rows."""
    plain = columns_of(terms)
    raised = {f"{n}^{k}": c ** k for k in powers for n, c in plain.items()}
    rows = gram_rows(df, {**columns_of([y]), **plain, **raised}, by)
    return _nested_rows(rows, y.name, [y.name, *plain, *raised], list(plain), lambda kept: [f"{n}^{k}" for k in powers for n in kept], by)


def corr_matrix(df: DataFrame, terms: list[Term]) -> DataFrame:
    """Correlation and slope of y on x for every pair of columns, on the rows complete in all of them."""
    g = gram(df, columns_of(terms))
    r = g.correlation()
    rows = [(a, b, float(r[i, j]), float(g.m[i, j] / g.m[i, i]))
            for i, a in enumerate(g.names) for j, b in enumerate(g.names) if i != j]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, slope double")


def glm_log_link(df: DataFrame, y, x, steps: int = 100):
    """Gaussian model of a positive y with logarithmic link on one covariate; the fitted ``ml`` model."""
    src = df.select(as_col(y).cast("double").alias("label"), as_col(x).cast("double").alias("x"))
    src = src.filter(is_present("label") & is_present("x") & (F.abs("x") < float("inf")))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(src)
    model = GeneralizedLinearRegression(family="gaussian", link="log", maxIter=steps, tol=1e-10).fit(data)
    if model.summary.numIterations >= steps:
        raise RuntimeError(f"the fit has not converged after {steps} steps")
    return model


def predict(model: Model, df: DataFrame, keep: list[str], level: float = 0.95) -> DataFrame:
    """Fitted line with its confidence band for the rows of ``df`` that hold the regressors."""
    f = model.fit
    src = design(df, {n: c for t in model.terms for n, c in t.columns if n in f.names}, keep)
    x = [F.lit(1.0), *[F.col(f"`{n}`") for n in f.names]]
    q = F.lit(0.0)
    for a in range(len(x)):
        for b in range(a, len(x)):
            q = q + F.lit(float(f.cov[a, b]) * (1 if a == b else 2)) * x[a] * x[b]
    half = F.sqrt(F.greatest(q, F.lit(0.0))) * F.lit(tails.t_quantile(0.5 + level / 2, f.df_residual))
    fit = f.fitted()
    return src.select(*keep, fit.alias("fit"), (fit - half).alias("lower"), (fit + half).alias("upper"))


def partial_residuals(model: Model, df: DataFrame, keep: list[str]) -> DataFrame:
    """Component plus residual of every term, ``(keep, term, x, partial)``."""
    res = model.residuals(df, keep)
    f = model.fit
    items = [
        F.struct(F.lit(n).alias("term"), F.col(f"`{n}`").alias("x"),
                 (F.lit(float(b)) * (F.col(f"`{n}`") - F.lit(float(model.gram.mean[model.gram.names.index(n)])))
                  + F.col("residual")).alias("partial"))
        for n, b in zip(f.names, f.coef[1:])
    ]
    return res.select(*keep, F.explode(F.array(*items)).alias("e")).select(*keep, "e.term", "e.x", "e.partial")


def qq_points(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Per group: sample value against normal quantile of (rank - a)/(n + 1 - 2a), a = 3/8 up to ten values, else 1/2.

    Equal values come as one row with ``cnt`` and their mean rank's quantile; no global sort.
    """
    a = F.when(F.col("n") <= 10, 0.375).otherwise(0.5)
    return avg_rank(df, value, by).select(
        *[F.col(f"`{b}`") for b in by], F.col(value).alias("sample"), "cnt",
        tails.normal_quantile((F.col("rank") - a) / (F.col("n") + 1 - 2 * a)).alias("theoretical"))


def qq_line(df: DataFrame, value: str) -> dict[str, float]:
    """Line through the quartiles of sample and normal distribution."""
    row = quantiles(df, value, {"q1": 0.25, "q3": 0.75}).first()
    z = 0.6744897501960817  # fixed value: the upper quartile of the standard normal distribution
    slope = (row["q3"] - row["q1"]) / (2 * z)
    return {"slope": slope, "intercept": row["q1"] + slope * z}
