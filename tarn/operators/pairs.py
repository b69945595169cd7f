"""Sums over shared keys for all pairs of items, in bounded blocks.

``sum over keys of combine(a_ik, a_jk)`` is what Bray-Curtis, both UniFracs, DPCoA and the Euclidean
distances need. A join of the cells with themselves on the key would emit every pair of items of a
key, so one key that all items hold would explode. Here items are hashed to blocks and keys to
slices: a cell is copied once per partner block, a task sees the cells of two blocks and one slice,
and only sums leave it. The numbers of blocks and slices follow from measured counts, so a task's
input is bounded whatever the skew.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, store

ITEMS_PER_BLOCK = 256
CELLS_PER_TASK = 200_000
SLAB = 4096
BROADCAST_VALUES = 4_000_000


def block_count(items: int) -> int:
    return max(1, math.ceil(items / ITEMS_PER_BLOCK))


def block_of(item: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")


def per_item(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of ``rows`` rows (one per item) while rows times columns is small; beyond it
    Spark shuffles."""
    return F.broadcast(df) if rows * len(df.columns) <= BROADCAST_VALUES else df


def _min_sums(out, ri, rk, rv, right):
    order = np.argsort(ri, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(ri[order])) + 1):
        out[ri[part[0]]] += np.minimum(rv[part, None], right[rk[part]]).sum(axis=0)


def _dense(item, key, value, items, width):
    out = np.zeros((width, items))
    out[key, item] = value
    return out


def _pair_matrix(rows: pd.DataFrame, cols: pd.DataFrame, combine: str):
    """Items of both sides and the matrix of their pair sums, one slab of keys at a time."""
    ri, r_items = pd.factorize(rows["item"], sort=True)
    ci, c_items = pd.factorize(cols["item"], sort=True)
    real_r, real_c = ~rows["mark"].to_numpy(bool), ~cols["mark"].to_numpy(bool)
    ri, ci = ri[real_r], ci[real_c]
    code, uniques = pd.factorize(pd.concat([rows["key"][real_r], cols["key"][real_c]], ignore_index=True))
    rk, ck = code[: len(ri)], code[len(ri):]
    rv, cv = rows["value"].to_numpy(float)[real_r], cols["value"].to_numpy(float)[real_c]
    out = np.zeros((len(r_items), len(c_items)))
    for start in range(0, len(uniques), SLAB):
        width = min(SLAB, len(uniques) - start)
        a = (rk >= start) & (rk < start + width)
        b = (ck >= start) & (ck < start + width)
        if combine != "sqdiff" and not (a.any() and b.any()):
            continue
        right = _dense(ci[b], ck[b] - start, cv[b], len(c_items), width)
        if combine == "min":
            _min_sums(out, ri[a], rk[a] - start, rv[a], right)
            continue
        left = _dense(ri[a], rk[a] - start, rv[a], len(r_items), width)
        if combine == "product":
            out += left.T @ right
        else:
            for i in range(len(r_items)):
                out[i] += ((left[:, i, None] - right) ** 2).sum(axis=0)
    return r_items, c_items, out


def upper_pairs(rows, cols, values, same: bool):
    """Long ``i, j, s`` with i < j of one block pair."""
    left, right, s = np.repeat(rows, len(cols)), np.tile(cols, len(rows)), values.ravel()
    if same:
        keep = left < right
        left, right, s = left[keep], right[keep], s[keep]
    swap = left > right
    return pd.DataFrame({"i": np.where(swap, right, left), "j": np.where(swap, left, right), "s": s})


def _block_task(combine: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iat[0]), int(pdf["bj"].iat[0])
        rows = pdf[pdf["block"] == bi]
        cols = rows if bi == bj else pdf[pdf["block"] == bj]
        if rows.empty or cols.empty:
            return pd.DataFrame({"i": [], "j": [], "s": []})
        return upper_pairs(*_pair_matrix(rows, cols, combine), same=bi == bj)

    return run


def pair_sums(cells: DataFrame, item: str, key: str, value: str, combine: str = "min", totals: bool = False) -> DataFrame:
    """``(i, j, s)`` with i < j for every pair of items, zero sums included.

    ``combine`` is ``min`` (of non-negative values), ``product`` or ``sqdiff``; an absent cell is a zero.
    ``totals`` adds both items' sums ``ti`` and ``tj``. Cells must be unique per item and key; they are
    stored once, since sizing, markers and copies each read them.
    """
    src = store(
        cells.select(F.col(item).alias("item"), F.col(key).alias("key"), F.col(value).cast("double").alias("value")))
    sizes = cut_lineage(src.groupBy("item").agg(
        F.count(F.lit(1)).alias("cells"), F.min("key").alias("key"), F.sum("value").alias("total")))
    n_items = sizes.count()
    blocks = block_count(n_items)
    fullest = sizes.groupBy(block_of(F.col("item"), blocks)).agg(F.sum("cells").alias("c")).agg(F.max("c")).first()[0]
    slices = max(1, math.ceil(2 * (fullest or 0) / CELLS_PER_TASK))
    real = src.withColumns({"slice": F.pmod(F.xxhash64("key", F.lit(17)), F.lit(slices)).cast("int"), "mark": F.lit(False)})
    # markers name an item to slices in which it may hold no cell; only squared differences need it everywhere
    named = F.sequence(F.lit(0), F.lit(slices - 1)) if combine == "sqdiff" else F.array(F.lit(0))
    markers = sizes.select("item", "key", F.lit(0.0).alias("value"), F.explode(named).alias("slice"), F.lit(True).alias("mark"))
    copies = (
        real.unionByName(markers)
        .withColumn("block", block_of(F.col("item"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
        .drop("other")
    )
    kind = cells.schema[item].dataType.simpleString()
    pairs = copies.groupBy("bi", "bj", "slice").applyInPandas(_block_task(combine), f"i {kind}, j {kind}, s double")
    if slices > 1:
        pairs = pairs.groupBy("i", "j").agg(F.sum("s").alias("s"))
    if not totals:
        return pairs
    side = lambda s: per_item(sizes.select(F.col("item").alias(s), F.col("total").alias(f"t{s}")), n_items)
    return pairs.join(side("i"), "i").join(side("j"), "j")
