"""Permutation tests of constrained ordinations.

A permutation of the samples is an ordering by a seeded hash, made by Spark for all permutations at
once; it depends on seed, permutation number and sample name and not on the partitioning. Pairs and
permuted design rows meet per block pair of samples, where one matrix product serves all
permutations; only p x p sums leave a block, and the statistic of a permutation is computed where
its sums arrive.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import block_cross
from .eigen import inner_products, mix, symmetric_apply
from .ordination import Constrained, Space, residual_map
from .pairs import per_item


# numbers one sample's permuted rows may hold in one batch; 512 samples of it make a task of about 80 MB
NUMBERS_PER_ROW = 20_000


SAMPLES_PER_BUCKET = 100_000


def _shuffled(numbered: DataFrame, buckets: int) -> DataFrame:
    """``(id, perm, at)``: the place of every sample in every permutation, ordered by hash ``h``.

    The hash is uniform, so equal ranges of it split a permutation into buckets of even size; a place is
    the size of the lower buckets plus the place within its own.
    """
    share = F.col("h") / F.lit(2.0**64) + F.lit(0.5)
    cut = numbered.withColumn("b", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int"))
    inside = cut.withColumn("at", F.row_number().over(Window.partitionBy("perm", "b").orderBy("h", "id")))
    if buckets == 1:
        return inside.select("id", "perm", "at")
    lower = Window.partitionBy("perm").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("perm", "b").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("perm", "b", F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("before"))
    return inside.join(before, ["perm", "b"]).select("id", "perm", (F.col("at") + F.col("before")).cast("int").alias("at"))


def permuted_design(
    design: DataFrame, names: list[str], n: int, n_perm: int, seed: int, per_batch: int | None = None
) -> DataFrame:
    """``(id, batch, xs)``: per sample the rows of the design that permutations 0..n_perm give it; 0 is the data."""
    per_batch = per_batch or n_perm + 1
    numbered = design.select("id", F.explode(F.sequence(F.lit(0), F.lit(n_perm))).alias("perm"))
    place = _shuffled(numbered.withColumn("h", F.xxhash64(F.lit(seed), "perm", "id")), math.ceil(n / SAMPLES_PER_BUCKET))
    base = place.filter("perm = 0").select("id", "at")
    values = design.join(base, "id").select("at", F.array(*[F.col(f"`{n}`") for n in names]).alias("x"))
    given = place.join(values, "at").select("id", "perm", "x", F.floor(F.col("perm") / per_batch).cast("int").alias("batch"))
    in_order = F.array_sort(F.collect_list(F.struct("perm", "x")))
    return given.groupBy("id", "batch").agg(F.flatten(F.transform(in_order, lambda e: e["x"])).alias("xs"))


def permuted_cross(pairs: DataFrame, design: DataFrame, names: list[str], n: int, n_perm: int, seed: int) -> DataFrame:
    """``(perm, t)``: the flattened p x p matrix X'AX of every permutation, for pairs with i <= j."""
    per_batch = min(n_perm + 1, max(1, NUMBERS_PER_ROW // len(names)))
    batches = math.ceil((n_perm + 1) / per_batch)
    rows = permuted_design(design, names, n, n_perm, seed, per_batch)
    return block_cross(pairs, rows, len(names), n, per_batch, batches)


def residual_pairs(space: Space, z: list[int]) -> DataFrame:
    """Gower's matrix with the centre and the z columns partialled out, ``(i, j, g)`` with i <= j.

    With Q an orthonormal basis of those columns: A - QU' - UQ' + QCQ', U = AQ, C = Q'AQ.
    """
    n = space.n
    basis = [F.lit(1.0 / np.sqrt(n)).alias("q0")]
    if z:
        low = np.linalg.inv(np.linalg.cholesky(space.s[np.ix_(z, z)]))
        axes = mix([space.names[c] for c in z], low.T)
        basis += [e.alias(f"q{k + 1}") for k, e in enumerate(axes)]
    cols = [f"q{k}" for k in range(len(basis))]
    q = space.design.select("id", *basis)
    u = symmetric_apply(space.pairs, rows=n)(q, cols).withColumnsRenamed({c: f"u{c}" for c in cols})
    both = cut_lineage(q.join(u, "id"))
    c = inner_products(both, cols, [f"u{k}" for k in cols])

    def value(i: str, j: str):
        out = F.lit(0.0)
        for a, name in enumerate(cols):
            out = out - F.col(f"{i}{name}") * F.col(f"{j}u{name}") - F.col(f"{i}u{name}") * F.col(f"{j}{name}")
            for b, other in enumerate(cols):
                out = out + F.lit(float(c[a, b])) * F.col(f"{i}{name}") * F.col(f"{j}{other}")
        return out

    every = [*cols, *[f"u{k}" for k in cols]]
    side = lambda s: per_item(both.select(F.col("id").alias(s), *[F.col(k).alias(f"{s}{k}") for k in every]), n)
    off = space.pairs.join(side("i"), "i").join(side("j"), "j").select("i", "j", (F.col("g") + value("i", "j")).alias("g"))
    own = side("i").withColumns({f"j{k}": F.col(f"i{k}") for k in every})
    diagonal = own.select("i", F.col("i").alias("j"), value("i", "j").alias("g"))
    return off.unionByName(diagonal)


def _statistics(crosses: DataFrame, p: int, compute, labels: list[str]) -> DataFrame:
    """Apply ``compute(T) -> list of numbers`` to the matrix of every permutation, on the executors."""

    def run(batches):
        for pdf in batches:
            out = [(int(k), *compute(np.asarray(t, dtype=float).reshape(p, p))) for k, t in zip(pdf["perm"], pdf["t"])]
            yield pd.DataFrame(out, columns=["perm", *labels])

    return crosses.mapInPandas(run, "perm int, " + ", ".join(f"{c} double" for c in labels))


def _p_values(stats: DataFrame, labels: list[str], n_perm: int) -> list[tuple[float, float]]:
    """Observed value and (hits + 1)/(n + 1) of every statistic; ties within rounding count as hits."""
    stats = cut_lineage(stats)
    seen = stats.filter("perm = 0").first()
    row = stats.filter("perm > 0").agg(*[
        F.count_if(F.col(c) >= F.lit(seen[c] - 1e-9 * abs(seen[c]))).alias(c) for c in labels]).first()
    return [(float(seen[c]), (row[c] + 1) / (n_perm + 1)) for c in labels]


def _solve_trace(s: np.ndarray, t: np.ndarray) -> float:
    return float(np.trace(np.linalg.solve(s, t))) if len(s) else 0.0


def permutation_test(model: Constrained, spark: SparkSession, n: int = 999, by: str | None = None, seed: int = 1) -> DataFrame:
    """Pseudo-F tests: the whole model, its terms in order, or its axes.

    Conditions are partialled out of the distances before permuting. Rows: ``term, df, ss, f, p`` and a
    residual row.
    """
    if by is None:
        return _test_model(model, spark, n, seed)
    if by == "terms":
        return _test_terms(model, spark, n, seed)
    if by == "axis":
        return _test_axes(model, spark, n, seed)
    raise ValueError("by is None, 'terms' or 'axis'")


SCHEMA = "term string, df int, ss double, f double, p double"


def _cross_of(model: Constrained, n: int, seed: int):
    """Permuted matrices over [z, x] columns, x with z partialled out."""
    space = model.space
    pairs = residual_pairs(space, model.z) if model.z else space.pairs
    cols = [*model.z, *model.x]
    names = [space.names[c] for c in cols]
    weights = np.zeros((len(space.names), len(cols)))
    weights[model.z, range(len(model.z))] = 1.0
    weights[:, len(model.z):] = residual_map(space, model.x, model.z)
    s = weights.T @ space.s @ weights
    mixed = space.design.select("id", *[e.alias(n) for e, n in zip(mix(space.names, weights), names)])
    trace = space.trace - model.ss_condition
    return permuted_cross(pairs, mixed, names, space.n, n, seed), s, trace


def _test_model(model: Constrained, spark: SparkSession, n: int, seed: int) -> DataFrame:
    crosses, s, trace = _cross_of(model, n, seed)
    q, dfm, dfr = len(model.z), model.df_model, model.df_residual

    def compute(t):
        ss = _solve_trace(s[q:, q:], t[q:, q:])
        rest = trace - ss - _solve_trace(s[:q, :q], t[:q, :q])
        return [ss / dfm / (rest / dfr)]

    (f, p), = _p_values(_statistics(crosses, len(s), compute, ["f"]), ["f"], n)
    rest = trace - model.ss_constrained
    return spark.createDataFrame([("Model", dfm, model.ss_constrained, f, p), ("Residual", dfr, rest, None, None)], SCHEMA)


def _test_terms(model: Constrained, spark: SparkSession, n: int, seed: int) -> DataFrame:
    crosses, s, trace = _cross_of(model, n, seed)
    q, dfr = len(model.z), model.df_residual
    ends, names = [], []
    owners = {c: t.name for t in model.space.terms for c in t.column_names}
    for k, col in enumerate(model.x):
        owner = owners[model.space.names[col]]
        if names and names[-1] == owner:
            ends[-1] = q + k + 1
        else:
            names.append(owner)
            ends.append(q + k + 1)
    sizes = np.diff([q, *ends])

    def compute(t):
        upto = [0.0, *[_solve_trace(s[q:e, q:e], t[q:e, q:e]) for e in ends]]
        rest = trace - upto[-1] - _solve_trace(s[:q, :q], t[:q, :q])
        return [(b - a) / d / (rest / dfr) for a, b, d in zip(upto, upto[1:], sizes)]

    labels = [f"f{k}" for k in range(len(names))]
    tested = _p_values(_statistics(crosses, len(s), compute, labels), labels, n)
    rest = trace - model.ss_constrained
    rows = [(t, int(d), float(f * d * rest / dfr), f, p) for t, d, (f, p) in zip(names, sizes, tested)]
    return spark.createDataFrame([*rows, ("Residual", dfr, rest, None, None)], SCHEMA)


def _test_axes(model: Constrained, spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Axis k: the first eigenvalue of the constraints, given conditions and the earlier axes."""
    space, dfr, rows = _with_axes(model), model.df_residual, []
    first = len(model.space.names)
    for k in range(len(model.x)):
        # earlier axes join the conditions; the later ones span the rest of the constraints
        z = [*model.z, *range(first, first + k)]
        x = list(range(first + k, first + len(model.x)))
        before = model.ss_condition + float(model.eigenvalues[:k].sum())
        stage = Constrained(space, [], [], x, z, before, float(model.eigenvalues[k:].sum()), model.eigenvalues[k:], model.weights)
        crosses, s, trace = _cross_of(stage, n, seed + k)
        q = len(z)

        def compute(t, q=q, s=s, trace=trace):
            inv = np.linalg.inv(np.linalg.cholesky(s[q:, q:]))
            eig = np.linalg.eigvalsh(inv @ t[q:, q:] @ inv.T)
            left = trace - eig.sum() - _solve_trace(s[:q, :q], t[:q, :q])
            return [eig[-1] / (left / dfr)]

        (f, p), = _p_values(_statistics(crosses, len(s), compute, ["f"]), ["f"], n)
        rows.append((f"CAP{k + 1}", 1, float(model.eigenvalues[k]), f, p))
    rest = model.space.trace - model.ss_condition - model.ss_constrained
    return spark.createDataFrame([*rows, ("Residual", dfr, rest, None, None)], SCHEMA)


def _with_axes(model: Constrained) -> Space:
    """The model's space with its axes as further columns."""
    space, axes = model.space, [f"__cap{k + 1}" for k in range(len(model.x))]
    grow = np.hstack([np.eye(len(space.names)), model.weights])
    table = space.design.select("*", *[e.alias(a) for e, a in zip(mix(space.names, model.weights), axes)])
    return Space(space.terms, [*space.names, *axes], space.n, grow.T @ space.s @ grow, grow.T @ space.t @ grow,
                 space.trace, space.pairs, table)


def ordistep(
    space: Space, spark: SparkSession, scope: list[str] | None = None, n: int = 999, p_in: float = 0.05, p_out: float = 0.1,
    seed: int = 1, limit: int = 50,
):
    """Forward and backward selection of terms by permutation p, starting from no term.

    A step drops the worst term above ``p_out``, or else adds the best one up to ``p_in``. One job tests all
    candidates to add: they are blocks of the same permuted matrices. Returns the chosen terms and a table of steps ``(step, action, term, f, p)``;
    a search that needs more than ``limit`` steps is an error.
    """
    terms = [t for t in space.terms if scope is None or t.name in scope]
    current: list[str] = []
    log: list[tuple] = []
    for step in range(limit):
        dropped = False
        if current:
            tests = []
            for name in current:
                mine = next(t for t in terms if t.name == name)
                if any(mine.parts < t.parts for t in terms if t.name in current):
                    continue
                rest = [c for c in current if c != name]
                (f, p), = _marginal_tests(space, rest, [name], n, seed + 2 * step)
                tests.append((p, -f, name))
            worst = max(tests) if tests else None
            if worst and worst[0] > p_out:
                current.remove(worst[2])
                log.append((step, "-", worst[2], -worst[1], worst[0]))
                dropped = True
        names = set(current)
        free = [t for t in terms if t.name not in names and all(
            s.name in names for s in terms if s.parts < t.parts)]
        z = space.columns(current)
        free = [t for t in free if len(space.columns([*current, t.name])) > len(z)]
        added = False
        if free and not dropped:
            tested = _marginal_tests(space, current, [t.name for t in free], n, seed + 2 * step + 1)
            f, p, name = max(((f, p, t.name) for (f, p), t in zip(tested, free)), key=lambda e: (-e[1], e[0]))
            if p <= p_in:
                current = [t.name for t in terms if t.name in names | {name}]
                log.append((step, "+", name, f, p))
                added = True
        if not dropped and not added:
            break
    else:
        raise RuntimeError(f"the search has not ended after {limit} steps")
    table = spark.createDataFrame(log, "step int, action string, term string, f double, p double")
    return current, table


def _marginal_tests(space: Space, current: list[str], names: list[str], n: int, seed: int) -> list[tuple[float, float]]:
    """F and p of adding each named term to the current ones, all from one job."""
    z = space.columns(current)
    groups = [[c for c in space.columns([*current, name]) if c not in z] for name in names]
    flat = [c for g in groups for c in g]
    ss_z = _solve_trace(space.s[np.ix_(z, z)], space.t[np.ix_(z, z)])
    stage = Constrained(space, [], [], flat, z, ss_z, 0.0, np.zeros(0), np.zeros((0, 0)))
    crosses, s, trace = _cross_of(stage, n, seed)
    q = len(z)
    spans, at = [], q
    for g in groups:
        spans.append((at, at + len(g)))
        at += len(g)
    free = space.n - 1 - q

    def compute(t):
        outside = _solve_trace(s[:q, :q], t[:q, :q])
        out = []
        for a, b in spans:
            ss = _solve_trace(s[a:b, a:b], t[a:b, a:b])
            out.append(ss / (b - a) / ((trace - ss - outside) / (free - (b - a))))
        return out

    labels = [f"f{k}" for k in range(len(names))]
    return _p_values(_statistics(crosses, len(s), compute, labels), labels, n)
