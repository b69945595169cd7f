"""X'AX of a long symmetric matrix for one or many versions of X, block pair by block pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import block_count, block_of


def _block_sums(p: int, per_batch: int):
    def run(key, pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if pairs.empty or rows.empty:
            return pd.DataFrame({"perm": [], "pos": [], "t": []})
        ids = pd.Index(rows["id"])
        x = np.stack(rows["xs"].to_numpy()).astype(float)
        perms = x.shape[1] // p
        a = np.zeros((len(ids), len(ids)))
        i, j = ids.get_indexer(pairs["i"]), ids.get_indexer(pairs["j"])
        a[i, j] = pairs["g"]
        a[j, i] = pairs["g"]
        y = (a @ x).reshape(len(ids), perms, p)
        t = np.einsum("ikp,ikq->kpq", x.reshape(len(ids), perms, p), y).reshape(perms, p * p)
        first = int(key[2]) * per_batch
        return pd.DataFrame({
            "perm": np.repeat(np.arange(first, first + perms), p * p),
            "pos": np.tile(np.arange(p * p), perms), "t": t.ravel()})

    return run


def block_cross(pairs: DataFrame, rows: DataFrame, p: int, n: int, per_batch: int = 1, batches: int = 1) -> DataFrame:
    """``(perm, t)``: the flattened p x p matrix of every version of X.

    ``pairs`` is ``(i, j, g)`` with i <= j. ``rows`` is ``(id, [batch,] xs)``, ``xs`` holding the item's rows of
    up to ``per_batch`` versions one after another. A task sees the pairs of two blocks of items and their rows
    of one batch.
    """
    blocks = block_count(n)
    every = F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))
    placed = pairs.withColumns({"__a": block_of(F.col("i"), blocks), "__b": block_of(F.col("j"), blocks), "batch": every})
    placed = placed.select("i", "j", "g", F.least("__a", "__b").alias("bi"), F.greatest("__a", "__b").alias("bj"), "batch")
    if "batch" not in rows.columns:
        rows = rows.withColumn("batch", F.lit(0))
    rows = rows.withColumns({"__a": block_of(F.col("id"), blocks), "__b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    rows = rows.select("id", "xs", F.least("__a", "__b").alias("bi"), F.greatest("__a", "__b").alias("bj"), "batch")
    at = ["bi", "bj", "batch"]
    sums = placed.groupBy(*at).cogroup(rows.groupBy(*at)).applyInPandas(_block_sums(p, per_batch), "perm int, pos int, t double")
    total = sums.groupBy("perm", "pos").agg(F.sum("t").alias("t"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "t")))
    return total.groupBy("perm").agg(F.transform(in_order, lambda e: e["t"]).alias("t"))
