"""Principal coordinates, spatial vectors and distance-based redundancy analysis on long distance tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import as_col, is_present
from ..functions.text import percent_label
from ..session import cut_lineage, store
from .eigen import factored_apply, mix, stored_apply, symmetric_apply, top_eigen
from .blocks import block_cross
from .gram import WIDE, Gram, Term, columns_of, gram
from .linmod import adj_r2, independent
from .pairs import per_item


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / sd over all rows; missing values stay missing. Only means and deviations are collected."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        ok = s is not None and s > 0
        out[c] = (F.col(c) - m) / s if ok else F.lit(None).cast("double")
    return df.withColumns(out)


def env_transform(df: DataFrame, recipe: dict[str, Column], keep: list[str]) -> DataFrame:
    """Transformed variables, then standardised."""
    return standardize(df.select(*keep, *[e.alias(n) for n, e in recipe.items()]), list(recipe))


# --- Gower matrices -----------------------------------------------------------------------------


def half_squares(d: DataFrame, sqrt_dist: bool = False) -> DataFrame:
    """Upper triangle ``(i, j, g)`` of -d^2/2, or of -d/2 when the square root of the distance is meant."""
    return d.select("i", "j", (-0.5 * (F.col("d") if sqrt_dist else F.col("d") ** 2)).alias("g"))


def item_ids(d: DataFrame) -> DataFrame:
    return d.select(F.explode(F.array("i", "j")).alias("id")).distinct()


def double_center(d: DataFrame, sqrt_dist: bool = False) -> DataFrame:
    """Gower's matrix, both triangles and the diagonal: ``(i, j, g)``.

    Row means are grouped sums over both ends of each pair; nothing is ordered or gathered.
    """
    a = half_squares(d, sqrt_dist)
    ends = a.select(F.explode(F.array("i", "j")).alias("id"), "g")
    rows = cut_lineage(ends.groupBy("id").agg(F.sum("g").alias("r")))
    n, total = rows.agg(F.count("id"), F.sum("r")).first()
    mean = rows.select("id", (F.col("r") / n).alias("r"))
    grand = (total or 0.0) / n**2
    side = lambda s: per_item(mean.select(F.col("id").alias(s), F.col("r").alias(f"r{s}")), n)
    off = a.join(side("i"), "i").join(side("j"), "j")
    value = (F.col("g") - F.col("ri") - F.col("rj") + F.lit(grand)).alias("g")
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")
    off = off.select(value, both).select("p.i", "p.j", "g")
    diagonal = mean.select(F.col("id").alias("i"), F.col("id").alias("j"), (F.lit(grand) - 2 * F.col("r")).alias("g"))
    return off.unionByName(diagonal)


def _subtract_means(v: DataFrame, cols: list[str]) -> DataFrame:
    row = v.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return v.select("id", *[(F.col(c) - F.lit(float(row[c]))).alias(c) for c in cols])


@dataclass(frozen=True)
class Ordination:
    """Leading eigenvalues, their share of the trace, and a table of site scores ``(id, axis1..)``."""

    eigenvalues: np.ndarray
    trace: float
    scores: DataFrame

    @property
    def share(self) -> np.ndarray:
        return self.eigenvalues / self.trace

    @property
    def axis_ratio(self) -> float:
        return float(np.sqrt(self.eigenvalues[1] / self.eigenvalues[0]))


def pcoa(d: DataFrame, k: int = 2, sqrt_dist: bool = False) -> Ordination:
    """Principal coordinates: scores are eigenvectors of Gower's matrix times root eigenvalue."""
    d = cut_lineage(d)
    ids = item_ids(d)
    n = ids.count()
    a = half_squares(d, sqrt_dist)
    # leaving the constant vector out is the centring
    values, vectors = top_eigen(stored_apply(a, n), ids.withColumn("deflate", F.lit(n**-0.5)), k)
    trace = -2 * (a.agg(F.sum("g")).first()[0] or 0.0) / n
    cols = [(F.col(f"v{i + 1}") * F.lit(float(np.sqrt(max(x, 0.0))))).alias(f"axis{i + 1}") for i, x in enumerate(values)]
    return Ordination(values, trace, vectors.select("id", *cols))


def dpcoa(d: DataFrame, weights: DataFrame, k: int = 2) -> Ordination:
    """Double principal coordinates of the samples: PCoA of their distances with sample weights.

    ``weights`` is ``(id, w)``. With D = diag(w), the matrix diagonalised is D^1/2 G_w D^1/2, where G_w
    centres on the weighted mean; scores are in distance units.
    """
    d = cut_lineage(d)
    total = weights.agg(F.sum("w")).first()[0]
    w = cut_lineage(weights.select("id", (F.col("w") / total).alias("w")))
    n = w.count()
    a = stored_apply(half_squares(d), n)
    roots = per_item(w.select("id", F.sqrt("w").alias("__root")), n)
    scaled = lambda v, cols: v.join(roots, "id").select("id", *[(F.col(c) * F.col("__root")).alias(c) for c in cols])

    def apply(v: DataFrame, cols: list[str]) -> DataFrame:
        return scaled(a(scaled(v, cols), cols), cols)

    # centring on the weighted mean leaves out the vector of root weights
    values, vectors = top_eigen(apply, w.select("id", F.sqrt("w").alias("deflate")), k)
    side = lambda s: per_item(w.select(F.col("id").alias(s), F.col("w").alias(f"w{s}")), n)
    # the trace is the weighted mean square distance: sum over pairs i < j of w_i w_j d^2
    trace = d.join(side("i"), "i").join(side("j"), "j").agg(F.sum(F.col("wi") * F.col("wj") * F.col("d") ** 2)).first()[0]
    cols = [(F.col(f"v{i + 1}") * F.lit(float(np.sqrt(max(x, 0.0)))) / F.sqrt("w")).alias(f"axis{i + 1}") for i, x in enumerate(values)]
    return Ordination(values, trace, vectors.join(w, "id").select("id", *cols))


def _cells_of(cells: DataFrame, item: str, key: str, value: str) -> DataFrame:
    return store(cells.select(F.col(item).alias("id"), F.col(key).alias("key"), F.col(value).cast("double").alias("y")).filter("y <> 0"))


def pcoa_cells(cells: DataFrame, item: str, key: str, value: str, k: int = 2) -> Ordination:
    """Principal coordinates of the Euclidean distances between the items' cells (absent ones are zero), without any distance.

    Gower's matrix is YY' without the row and column means, so Lanczos steps multiply by the cells twice. Items need a cell, if
    only of value zero.
    """
    ids = cut_lineage(cells.select(F.col(item).alias("id")).distinct())
    n, y = ids.count(), _cells_of(cells, item, key, value)
    values, vectors = top_eigen(factored_apply(y, n), ids.withColumn("deflate", F.lit(n**-0.5)), k)
    per_key = y.groupBy("key").agg(F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("ss"))
    trace = per_key.agg(F.sum(F.col("ss") - F.col("s") ** 2 / n)).first()[0] or 0.0
    cols = [(F.col(f"v{i + 1}") * F.lit(float(np.sqrt(max(x, 0.0))))).alias(f"axis{i + 1}") for i, x in enumerate(values)]
    return Ordination(values, trace, vectors.select("id", *cols))


def dpcoa_cells(proportions: DataFrame, weights: DataFrame, k: int = 2) -> Ordination:
    """Double principal coordinates from branch proportions ``(sample_id, branch, length, p)`` and ``(id, w)``, as of ``dpcoa`` but
    without distances: the cells are the proportions times the root of the branch length."""
    y = _cells_of(proportions.withColumn("y", F.sqrt("length") * F.col("p")), "sample_id", "branch", "y")
    total = weights.agg(F.sum("w")).first()[0]
    w = cut_lineage(weights.select("id", (F.col("w") / total).alias("w")))
    n = w.count()
    joined = y.join(per_item(w, n), "id")
    scaled = store(joined.select("id", "key", (F.col("y") * F.sqrt("w")).alias("y")))
    values, vectors = top_eigen(factored_apply(scaled, n), w.select("id", F.sqrt("w").alias("deflate")), k)
    per_key = joined.groupBy("key").agg(F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") ** 2).alias("ss"))
    trace = per_key.agg(F.sum(F.col("ss") - F.col("s") ** 2)).first()[0]
    cols = [(F.col(f"v{i + 1}") * F.lit(float(np.sqrt(max(x, 0.0)))) / F.sqrt("w")).alias(f"axis{i + 1}") for i, x in enumerate(values)]
    return Ordination(values, trace, vectors.join(w, "id").select("id", *cols))


def spatial_vector(truncated: DataFrame, k: int = 2) -> Ordination:
    """Scaled principal components of the truncated distance matrix, its columns being the variables.

    ``scores`` holds the loadings per site (``axis1`` is the spatial vector); the trace is the number
    of sites. A constant column has no standard deviation and is an error.
    """
    t = cut_lineage(truncated.select("i", "j", F.col("d").alias("g")))
    ends = t.select(F.explode(F.array("i", "j")).alias("id"), "g")
    sums = ends.groupBy("id").agg(F.sum("g").alias("s"), F.sum(F.col("g") ** 2).alias("ss"))
    n = sums.count()
    stats = cut_lineage(sums.select(
        "id", (F.col("s") / n).alias("mu"),
        F.sqrt((F.col("ss") - F.col("s") ** 2 / n) / (n - 1)).alias("sd")))
    return _scaled_components(stats, stored_apply(t, n), n, k)


def spatial_vector_near(sites: DataFrame, near: DataFrame, far: float, k: int = 2) -> Ordination:
    """``spatial_vector`` of the matrix that holds ``near``'s distances ``(i, j, d)`` and ``far`` for all other pairs of ``sites`` (id).

    The matrix is the constant ``far`` off the diagonal plus what the near pairs differ from it: the first is one sum per column, the
    second sparse. Nothing grows with the square of the sites.
    """
    ids = cut_lineage(sites.select("id"))
    n, far = ids.count(), float(far)
    t = cut_lineage(near.select("i", "j", (F.col("d") - far).alias("g")))
    ends = t.select(F.explode(F.array("i", "j")).alias("id"), "g").groupBy("id").agg(F.sum("g").alias("s"), F.sum(F.col("g") * (F.col("g") + 2 * far)).alias("ss"))
    sums = ids.join(ends, "id", "left").select("id", *[(F.coalesce(c, F.lit(0.0)) + v * (n - 1)).alias(c) for c, v in (("s", far), ("ss", far**2))])
    stats = cut_lineage(sums.select("id", (F.col("s") / n).alias("mu"), F.sqrt((F.col("ss") - F.col("s") ** 2 / n) / (n - 1)).alias("sd")))
    sparse = stored_apply(t, n)

    def apply(v: DataFrame, cols: list[str]) -> DataFrame:
        total = v.agg(*[F.sum(c).alias(c) for c in cols]).first()
        image = sparse(v, cols).select("id", *[F.col(c).alias(f"near_{c}") for c in cols])
        return v.join(image, "id", "left").select(
            "id", *[(F.coalesce(f"near_{c}", F.lit(0.0)) + far * (F.lit(float(total[c])) - F.col(c))).alias(c) for c in cols])

    return _scaled_components(stats, apply, n, k)


def _scaled_components(stats: DataFrame, a, n: int, k: int) -> Ordination:
    """Leading components of the standardised columns of a symmetric matrix that ``a`` applies; ``stats`` is ``(id, mu, sd)``."""
    if not stats.filter(F.coalesce(F.col("sd") <= 0, F.lit(True)) | F.isnan("sd")).isEmpty():
        raise ValueError("a site has the same distance to all sites")
    scaling = per_item(stats, n)

    def apply(v: DataFrame, cols: list[str]) -> DataFrame:
        # Z'Z/(n-1) with Z the standardised columns; Zx sums to zero, so only its own shift needs a number
        u = v.join(scaling, "id").select("id", "mu", *[(F.col(c) / F.col("sd")).alias(c) for c in cols])
        shift = u.agg(*[F.sum(F.col(c) * F.col("mu")).alias(c) for c in cols]).first()
        w = a(u.drop("mu"), cols).select("id", *[(F.col(c) - F.lit(float(shift[c]))).alias(c) for c in cols])
        return a(w, cols).join(scaling, "id").select("id", *[(F.col(c) / (F.col("sd") * (n - 1))).alias(c) for c in cols])

    values, vectors = top_eigen(apply, stats.select("id"), k)
    return Ordination(values, float(n), vectors.select("id", *[F.col(f"v{i + 1}").alias(f"axis{i + 1}") for i in range(len(values))]))


# --- distance-based redundancy analysis ---------------------------------------------------------


@dataclass(frozen=True)
class Space:
    """What every constrained model of one distance table and one set of variables is made from.

    ``design`` is ``(id, x...)`` with centred columns, ``s`` their cross-products, ``t`` = X'GX, ``trace``
    the total sum of squares; ``pairs`` is the upper triangle of -d^2/2. Since X is centred, X'GX needs no
    centred G. Submodels, partial models and stepwise candidates are blocks of ``s`` and ``t``.
    """

    terms: list[Term]
    names: list[str]
    n: int
    s: np.ndarray
    t: np.ndarray
    trace: float
    pairs: DataFrame | None
    design: DataFrame
    #: the cells ``(id, key, y)`` whose Euclidean distances are meant, where no pairs are
    cells: DataFrame | None = None

    def image(self, u: DataFrame, cols: list[str]) -> DataFrame:
        """G times centred vectors, but for a constant per column."""
        apply = symmetric_apply(self.pairs, rows=self.n) if self.cells is None else factored_apply(self.cells, self.n)
        return apply(u, cols)

    def columns(self, names: list[str]) -> list[int]:
        """Positions of the design columns of the named terms that are not aliased with earlier ones."""
        wanted = [c for t in self.terms if t.name in set(names) for c in t.column_names]
        g = Gram(self.names, self.n, np.zeros(len(self.names)), self.s)
        return [self.names.index(c) for c in independent(g, wanted)]


def cross_gower(pairs: DataFrame, table: DataFrame, names: list[str], rows: int) -> np.ndarray:
    """X'AX of an upper triangle with a zero diagonal, as one aggregate of p(p+1)/2 sums; wide designs by blocks."""
    if len(names) > WIDE:
        t = block_cross(pairs, table.select("id", F.array(*[F.col(f"`{n}`") for n in names]).alias("xs")), len(names), rows)
        return np.array(t.first()["t"], dtype=float).reshape(len(names), len(names))
    side = lambda s: per_item(table.select(F.col("id").alias(s), *[F.col(f"`{n}`").alias(f"{s}{k}") for k, n in enumerate(names)]), rows)
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    idx = [(a, b) for a in range(len(names)) for b in range(a, len(names))]
    sums = ", ".join(f"sum(g * (i{a} * j{b} + i{b} * j{a}))" for a, b in idx)
    row = both.agg(F.expr(f"array({sums})").alias("t")).first()["t"]
    out = np.zeros((len(names), len(names)))
    for (a, b), v in zip(idx, row):
        out[a, b] = out[b, a] = v if v is not None else 0.0
    return out


def constrained_space(d: DataFrame, env: DataFrame, terms: list[Term], key: str = "id", sqrt_dist: bool = True) -> Space:
    """Join distances and environment on the complete samples and reduce them to p x p matrices."""
    cols = columns_of(terms)
    d = cut_lineage(d)
    table, g, kept = _centred_design(item_ids(d), env, cols, key)
    only = per_item(table.select("id"), g.n)
    pairs = half_squares(d, sqrt_dist)
    pairs = pairs.join(only.withColumnRenamed("id", "i"), "i", "left_semi").join(only.withColumnRenamed("id", "j"), "j", "left_semi")
    pairs = cut_lineage(pairs)
    trace = -2 * pairs.agg(F.sum("g")).first()[0] / g.n
    return Space(_live(terms, kept), kept, g.n, g.block(kept, kept), cross_gower(pairs, table, kept, g.n), trace, pairs, table)


def constrained_space_cells(cells: DataFrame, item: str, key: str, value: str, env: DataFrame, terms: list[Term], env_key: str = "id") -> Space:
    """``constrained_space`` of the Euclidean distances between the items' cells, without any distance.

    With X centred, X'GX is the sum over keys of the squares of X'y: one grouped sum of p numbers per key, then one of p(p+1)/2.
    Items need a cell, if only of value zero.
    """
    cols = columns_of(terms)
    ids = cut_lineage(cells.select(F.col(item).alias("id")).distinct())
    table, g, kept = _centred_design(ids, env, cols, env_key)
    y = _cells_of(cells, item, key, value)
    y = store(y.join(per_item(table.select("id"), g.n), "id", "left_semi"))
    down = y.join(per_item(table, g.n), "id").groupBy("key").agg(
        F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("ss"), *[F.sum(F.col("y") * F.col(f"`{n}`")).alias(f"x{k}") for k, n in enumerate(kept)])
    idx = [(a, b) for a in range(len(kept)) for b in range(a, len(kept))]
    sums = ", ".join(["sum(ss - s * s / %d)" % g.n, *[f"sum(x{a} * x{b})" for a, b in idx]])
    row = down.agg(F.expr(f"array({sums})").alias("t")).first()["t"]
    t = np.zeros((len(kept), len(kept)))
    for (a, b), v in zip(idx, row[1:]):
        t[a, b] = t[b, a] = v or 0.0
    return Space(_live(terms, kept), kept, g.n, g.block(kept, kept), t, row[0] or 0.0, None, table, y)


def _centred_design(ids: DataFrame, env: DataFrame, cols: dict[str, Column], key: str) -> tuple[DataFrame, Gram, list[str]]:
    """Centred design ``(id, x...)`` of the complete samples among ``ids``, its Gram, and the columns that are not aliased."""
    src = env.select(F.col(key).alias("id"), *[c.cast("double").alias(n) for n, c in cols.items()])
    for n in cols:
        src = src.filter(is_present(f"`{n}`"))
    src = cut_lineage(src.join(ids, "id", "left_semi"))
    g = gram(src, {n: F.col(f"`{n}`") for n in cols})
    if src.select("id").distinct().count() != g.n:
        raise ValueError(f"{key} is no key of the environment table")
    # an aliased column adds nothing to any model that holds the earlier ones
    kept = independent(g, list(cols))
    centre = [(F.col(f"`{n}`") - F.lit(float(g.mean[g.names.index(n)]))).alias(n) for n in kept]
    return cut_lineage(src.select("id", *centre)), g, kept


def _live(terms: list[Term], kept: list[str]) -> list[Term]:
    live = [Term(t.name, tuple(c for c in t.columns if c[0] in kept), t.parts) for t in terms]
    return [t for t in live if t.columns]


def _explained(s: np.ndarray, t: np.ndarray) -> float:
    return float(np.trace(np.linalg.solve(s, t))) if len(s) else 0.0


@dataclass(frozen=True)
class Constrained:
    """A (partial) distance-based redundancy analysis: sums of squares, axes and weights on the design columns."""

    space: Space
    terms: list[str]
    condition: list[str]
    x: list[int]
    z: list[int]
    ss_condition: float
    ss_constrained: float
    eigenvalues: np.ndarray
    weights: np.ndarray

    @property
    def inertia(self) -> dict[str, float]:
        n1 = self.space.n - 1
        rest = self.space.trace - self.ss_condition - self.ss_constrained
        return {"total": self.space.trace / n1, "conditioned": self.ss_condition / n1,
                "constrained": self.ss_constrained / n1, "unconstrained": rest / n1}

    @property
    def df_model(self) -> int:
        return len(self.x)

    @property
    def df_residual(self) -> int:
        return self.space.n - 1 - len(self.x) - len(self.z)

    @property
    def r2(self) -> float:
        return self.ss_constrained / self.space.trace

    @property
    def adj_r2(self) -> float:
        """Adjusted share; of a partial model the difference of the two adjusted shares."""
        n, q, m = self.space.n, len(self.z), len(self.x)
        both = (self.ss_condition + self.ss_constrained) / self.space.trace
        full = adj_r2(both, n, q + m)
        return full - adj_r2(self.ss_condition / self.space.trace, n, q) if q else full

    @property
    def f(self) -> float:
        rest = self.space.trace - self.ss_condition - self.ss_constrained
        return self.ss_constrained / self.df_model / (rest / self.df_residual)


def residual_map(space: Space, x: list[int], z: list[int]) -> np.ndarray:
    """Weights that turn the design columns into the x columns with the z columns partialled out."""
    p = len(space.names)
    m = np.zeros((p, len(x)))
    m[x, range(len(x))] = 1.0
    if z:
        m[z, :] -= np.linalg.solve(space.s[np.ix_(z, z)], space.s[np.ix_(z, x)])
    return m


def dbrda(space: Space, terms: list[str], condition: list[str] = ()) -> Constrained:
    """Model of the named terms, given the named conditions, from the reduced matrices alone."""
    z = space.columns(list(condition))
    x = [c for c in space.columns([*condition, *terms]) if c not in z]
    m = residual_map(space, x, z)
    s, t = m.T @ space.s @ m, m.T @ space.t @ m
    low = np.linalg.cholesky(s)
    inv = np.linalg.inv(low)
    val, vec = np.linalg.eigh(inv @ t @ inv.T)
    order = np.argsort(val)[::-1]
    return Constrained(space, list(terms), list(condition), x, z,
                       _explained(space.s[np.ix_(z, z)], space.t[np.ix_(z, z)]), float(np.trace(np.linalg.solve(s, t))),
                       val[order], m @ inv.T @ vec[:, order])


def vif(space: Space, terms: list[str] | None = None) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    x = space.columns(terms or [t.name for t in space.terms])
    return _inflation([space.names[i] for i in x], space.s[np.ix_(x, x)])


def vif_of(df: DataFrame, terms: list[Term]) -> dict[str, float]:
    """``vif`` of the terms' columns on the complete rows of ``df``: a number of the design alone, from one Gram."""
    g = gram(df, columns_of(terms))
    kept = independent(g, g.names)
    return _inflation(kept, g.block(kept, kept))


def _inflation(names: list[str], s: np.ndarray) -> dict[str, float]:
    d = np.sqrt(np.diag(s))
    return dict(zip(names, np.diag(np.linalg.inv(s / np.outer(d, d))).tolist()))


def varpart(space: Space, first: list[str], second: list[str]) -> dict[str, float]:
    """Unique, shared and residual fractions of two sets of terms, from adjusted shares."""
    a = dbrda(space, first).adj_r2
    b = dbrda(space, second).adj_r2
    ab = dbrda(space, [*first, *second]).adj_r2
    return {"unique_first": ab - b, "shared": a + b - ab, "unique_second": ab - a, "residual": 1 - ab}


def eigen_table(model: Constrained, spark: SparkSession) -> DataFrame:
    """Per constrained axis: eigenvalue and its share of total and fitted inertia, with running sums and a label."""
    n1 = model.space.n - 1
    total, fitted = model.space.trace, model.ss_constrained
    run_t = np.cumsum(model.eigenvalues) / total
    run_f = np.cumsum(model.eigenvalues) / fitted
    rows = [(i + 1, float(v / n1), float(v / total), float(v / fitted), float(run_t[i]), float(run_f[i]))
            for i, v in enumerate(model.eigenvalues)]
    out = spark.createDataFrame(rows, "axis int, eigenvalue double, of_total double, of_fitted double, "
                                      "cum_total double, cum_fitted double")
    label = percent_label("CAP", "of_fitted", "of_total")
    return out.withColumn("label", F.replace(label, F.lit("CAP ("), F.concat(F.lit("CAP "), F.col("axis").cast("string"), F.lit(" ("))))


def axis_signs(model: Constrained, k: int) -> np.ndarray:
    """Make the largest absolute biplot arrow of each axis positive."""
    b = _biplot_matrix(model)[:, :k]
    return np.where(b[np.abs(b).argmax(axis=0), range(b.shape[1])] < 0, -1.0, 1.0)


def _biplot_matrix(model: Constrained) -> np.ndarray:
    s = model.space.s
    every = [*model.z, *model.x]
    return (s[every] @ model.weights) / np.sqrt(np.diag(s)[every])[:, None]


def biplot(model: Constrained, spark: SparkSession, k: int = 2) -> DataFrame:
    """Correlation of every variable with the constrained axes."""
    k = min(k, len(model.x))
    b = _biplot_matrix(model)[:, :k] * axis_signs(model, k)
    names = [model.space.names[i] for i in [*model.z, *model.x]]
    rows = [(n, *map(float, r)) for n, r in zip(names, b) if n in {model.space.names[i] for i in model.x}]
    return spark.createDataFrame(rows, "variable string, " + ", ".join(f"cap{i + 1} double" for i in range(k)))


def constraint_scores(model: Constrained, k: int | None = None) -> DataFrame:
    """Unit-length linear combinations of the variables, ``(id, cap1..)``."""
    k = min(k or len(model.x), len(model.x))
    w = model.weights[:, :k] * axis_signs(model, k)
    names = model.space.names
    return model.space.design.select("id", *[e.alias(f"cap{i + 1}") for i, e in enumerate(mix(names, w))])


def site_scores(model: Constrained, k: int = 2) -> DataFrame:
    """Weighted-average site scores, scaled by the fourth root of the total sum of squares."""
    k = min(k, len(model.x))
    cols = [f"cap{i + 1}" for i in range(k)]
    u = cut_lineage(constraint_scores(model, k))
    image = _subtract_means(model.space.image(u, cols), cols)
    const = model.space.trace ** 0.25
    return image.select("id", *[(F.col(c) * F.lit(const / float(v))).alias(c) for c, v in zip(cols, model.eigenvalues)])
