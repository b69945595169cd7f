"""Leading eigenpairs of a symmetric operator that is only ever applied to blocks of vectors.

Block Lanczos with full reorthogonalisation. The basis is a table with one row per item; the
operator is a join and a grouped sum; only inner products of basis vectors (small matrices) reach
the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pairs import per_item

MAX_BASIS = 160
MAX_STEPS = 400


def inner_products(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    sums = ", ".join(f"sum(`{a}` * `{b}`)" for a in left for b in right)
    row = df.agg(F.expr(f"array({sums})").alias("s")).first()["s"]
    return np.array([0.0 if v is None else v for v in row], dtype=float).reshape(len(left), len(right))


def mix(columns: list[str], weights: np.ndarray) -> list:
    """Linear combinations of columns, one per column of ``weights``."""
    terms = lambda k: [f"({float(w)!r}D) * `{c}`" for c, w in zip(columns, weights[:, k]) if w != 0.0]
    return [F.expr(" + ".join(terms(k)) or "0.0D") for k in range(weights.shape[1])]


def symmetric_apply(upper: DataFrame, rows: int) -> Callable[[DataFrame, list[str]], DataFrame]:
    """``V -> A V`` for a symmetric matrix with zero diagonal in upper-triangle form ``(i, j, g)``.

    The vectors are joined to the pairs (broadcast while they are small) and summed per item with a
    partial sum before the shuffle.
    """

    def apply(v: DataFrame, cols: list[str]) -> DataFrame:
        side = lambda s: per_item(v.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols]), rows)
        both = upper.join(side("i"), "i").join(side("j"), "j")
        parts = both.select(F.explode(F.array(
            F.struct(F.col("i").alias("id"), *[(F.col("g") * F.col(f"j_{c}")).alias(c) for c in cols]),
            F.struct(F.col("j").alias("id"), *[(F.col("g") * F.col(f"i_{c}")).alias(c) for c in cols]),
        )).alias("e")).select("e.*")
        return parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in cols])

    return apply


def stored_apply(upper: DataFrame, rows: int) -> Callable[[DataFrame, list[str]], DataFrame]:
    """``V -> A V`` for many applications: both triangles are stored once, so each is one join and one grouped sum."""
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")
    full = cut_lineage(upper.select("g", both).select(F.col("p.i").alias("id"), F.col("p.j").alias("__j"), "g"))

    def apply(v: DataFrame, cols: list[str]) -> DataFrame:
        joined = full.join(per_item(v.select(F.col("id").alias("__j"), *cols), rows), "__j")
        return joined.groupBy("id").agg(*[F.expr(f"sum(g * `{c}`)").alias(c) for c in cols])

    return apply


def factored_apply(cells: DataFrame, rows: int) -> Callable[[DataFrame, list[str]], DataFrame]:
    """``V -> Y Y'V`` for a matrix of cells ``(id, key, y)``, unique per id and key: down to the keys and back up to the items.

    Work is in proportion to the cells; no pair of items is made. ``cells`` should be stored.
    """

    def apply(v: DataFrame, cols: list[str]) -> DataFrame:
        down = cells.join(per_item(v.select("id", *cols), rows), "id").groupBy("key").agg(*[F.expr(f"sum(y * `{c}`)").alias(c) for c in cols])
        return cells.join(down, "key").groupBy("id").agg(*[F.expr(f"sum(y * `{c}`)").alias(c) for c in cols])

    return apply


def _orthonormal(m: np.ndarray, floor: float) -> np.ndarray:
    """Weights that make vectors with inner products ``m`` orthonormal; directions below ``floor`` vanish."""
    val, vec = np.linalg.eigh((m + m.T) / 2)
    keep = val > floor
    return vec[:, keep] / np.sqrt(val[keep])


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.stack(arrays.to_numpy()).astype(float)


def _block_products(table: DataFrame, basis: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the basis ``q`` and of the block ``w`` with the block, summed from partial matrices."""

    def partial(batches):
        acc = np.zeros((basis + block, block))
        for pdf in batches:
            if len(pdf):
                w = _matrix(pdf["w"])
                acc += np.hstack([_matrix(pdf["q"]), w]).T @ w
        yield pd.DataFrame({"pos": np.arange(acc.size), "s": acc.ravel()})

    sums = table.select("q", "w").mapInPandas(partial, "pos int, s double").groupBy("pos").agg(F.sum("s").alias("s"))
    out = np.zeros((basis + block) * block)
    for r in sums.collect():
        out[r["pos"]] = r["s"]
    out = out.reshape(basis + block, block)
    return out[:basis], out[basis:]


def _combine(weights: np.ndarray):
    """Column of linear combinations of a row's basis and block values."""

    @F.pandas_udf("array<double>")
    def run(q: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(list(np.hstack([_matrix(q), _matrix(w)]) @ weights) if len(q) else [], dtype=object)

    return run("q", "w")


def top_eigen(apply, ids: DataFrame, k: int, block: int = 8, tol: float = 1e-9):
    """The ``k`` largest eigenvalues and a table ``(id, v1..vk)`` of unit eigenvectors.

    ``ids`` has a column ``id`` and may have a unit vector ``deflate``: the operator is then restricted
    to the vectors orthogonal to it. The sign is fixed: the loading of largest absolute value is positive
    (ties: the smallest id). A step is three jobs: the image of the last block and two rounds of inner
    products. A full basis is restarted from its best vectors.
    """
    skip = int("deflate" in ids.columns)
    first = F.array("deflate") if skip else F.array().cast("array<double>")
    seeds = F.array(*[(F.xxhash64("id", F.lit(101 + c)) % 1_000_003) / 1_000_003.0 for c in range(block)])
    table = cut_lineage(ids.select("id", first.alias("q"), seeds.alias("w")))
    t = np.zeros((0, 0))
    width, size = block, 0
    for _ in range(MAX_STEPS):
        # q holds [deflate,] and `size` basis vectors, w the image of the last `width` of them
        h, own = _block_products(table, skip + size, width)
        if size:
            grown = np.zeros((size, size))
            grown[: len(t), : len(t)] = t
            grown[:, size - width:] = h[skip:]
            grown[size - width:, :] = h[skip:].T
            t = (grown + grown.T) / 2
        m = own - h.T @ h
        weights = _orthonormal(m, 1e-15 * max(np.trace(own), 1e-300))
        coupling, fresh = weights.T @ m, weights.shape[1]
        if fresh:
            table = table.select("id", "q", _combine(np.vstack([-h @ weights, weights])).alias("w"))
            h, own = _block_products(table, skip + size, fresh)
            m = own - h.T @ h
            weights = _orthonormal(m, 1e-8)
            coupling, fresh = weights.T @ m @ coupling, weights.shape[1]
            table = table.select("id", "q", _combine(np.vstack([-h @ weights, weights])).alias("w"))
        if size:
            val, vec = np.linalg.eigh(t)
            order = np.argsort(val)[::-1][:k]
            residual = np.linalg.norm(coupling @ vec[size - width:, order], axis=0) if fresh else np.zeros(1)
            if not fresh or (size >= k and residual.max() <= tol * np.abs(val).max()):
                break
        elif not fresh:
            raise ValueError("no vector is left to start from")
        if size + fresh > MAX_BASIS:
            best = np.argsort(val)[::-1][: max(2 * block, k + block)]
            keep = np.zeros((skip + size + fresh, skip + len(best)))
            keep[:skip, :skip] = np.eye(skip)
            keep[skip: skip + size, skip:] = vec[:, best]
            table = table.select("id", _combine(keep).alias("q"), "w")
            t, size = np.diag(val[best]), len(best)
        names = [f"x{c}" for c in range(fresh)]
        vectors = table.select("id", *[F.get("w", F.lit(c)).alias(x) for c, x in enumerate(names)])
        image = apply(vectors, names).select("id", F.array(*names).alias("__w"))
        grown_q = table.select("id", F.concat("q", "w").alias("q"))
        zeros = F.array(*[F.lit(0.0)] * fresh)
        table = cut_lineage(grown_q.join(image, "id", "left").select("id", "q", F.coalesce("__w", zeros).alias("w")))
        width, size = fresh, size + fresh
    else:
        raise RuntimeError("the leading eigenvalues did not converge")
    k = len(order)
    final = np.zeros((skip + size + fresh, k))
    final[skip: skip + size] = vec[:, order]
    if not fresh:
        table = table.select("id", "q", F.array().cast("array<double>").alias("w"))
    out = cut_lineage(table.select("id", _combine(final).alias("v")))
    out = out.select("id", *[F.get("v", F.lit(i)).alias(f"v{i + 1}") for i in range(k)])
    heads = out.agg(*[
        F.min_by(f"v{i + 1}", F.struct(-F.round(F.abs(f"v{i + 1}"), 9), "id")).alias(f"v{i + 1}") for i in range(k)
    ]).first()
    signs = [-1.0 if heads[f"v{i + 1}"] < 0 else 1.0 for i in range(k)]
    return val[order], out.select("id", *[(F.col(f"v{i + 1}") * s).alias(f"v{i + 1}") for i, s in enumerate(signs)])
