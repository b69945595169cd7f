"""Distances between samples as long tables ``(i, j, d)`` with i < j, and the spanning-tree threshold."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, store
from .links import overlap_links, overlap_near
from .pairs import pair_sums, per_item
from .similar import overlap_pairs

GRID_AXES = 3  # coordinates that a grid has at most; the others are only compared
GATHERED = 1_000_000  # components up to which one task follows the ways between them; more merge in Spark first
TILE = 50_000  # points of a tile of grid cells, unless one cell has more
TASK_POINTS = 10_000  # points for which a task is worth while
MET = 2_000_000  # pairs of points that a task lists at once
CROWDED = 256  # different points in a cell beyond which a search starts with smaller cells


def _distance(pairs: DataFrame, d: Column) -> DataFrame:
    return pairs.select("i", "j", d.alias("d"))


def symmetric(d: DataFrame) -> DataFrame:
    """Both directions of every pair; the diagonal stays implicit (zero)."""
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return d.select(F.explode(both).alias("p"), "d").select("p.i", "p.j", "d")


def _neighbours(points: DataFrame, key: str, coords: list[str], within: float) -> DataFrame:
    """Pairs at most ``within`` apart: points meet in the cells of a grid and in the neighbouring ones."""
    src = store(points.select(F.col(f"`{key}`").alias("i"), F.array(*[F.col(f"`{c}`").cast("double") for c in coords]).alias("x")))
    src = src.filter(F.forall("x", lambda v: F.abs(v) < float("inf")))
    top = src.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    # a little wider than asked for, and no more cells than a double tells apart: rounding moves no pair two cells away
    width = max(within * (1 + 1e-6), (top or 0.0) * 1e-9) or 1.0
    axes = range(min(len(coords), GRID_AXES))
    steps = F.array(*[F.lit(float(s)) for s in (-1, 0, 1)])
    placed = src.select("i", "x", *[F.floor(F.col("x")[a] / width).cast("double").alias(f"c{a}") for a in axes])
    others = placed.select(F.col("i").alias("j"), F.col("x").alias("y"), *[f"c{a}" for a in axes])
    for a in axes:
        others = others.withColumn("s", F.explode(steps)).withColumn(f"c{a}", F.col(f"c{a}") + F.col("s")).drop("s")
    squares = F.zip_with("x", "y", lambda u, v: (u - v) * (u - v))
    met = placed.join(others, [f"c{a}" for a in axes]).filter("i < j")
    return _distance(met, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))).filter(F.col("d") <= within)


def euclidean(points: DataFrame, key: str, coords: list[str], within: float | None = None) -> DataFrame:
    """Distances of all pairs or, with ``within``, of the pairs at most that far apart; the others are not built then, and
    points with a missing or infinite coordinate are near none."""
    if within is not None:
        return _neighbours(points, key, coords, within)
    cells = points.select(key, *[F.col(c).cast("double") for c in coords]).unpivot(key, coords, "__axis", "__x")
    return _distance(pair_sums(cells, key, "__axis", "__x", "sqdiff"), F.sqrt("s"))


def distance_of_distances(d: DataFrame) -> DataFrame:
    """Euclidean distances between the rows of the full distance matrix."""
    return _distance(pair_sums(symmetric(d), "i", "j", "d", "sqdiff"), F.sqrt("s"))


def _checked_limit(within: float) -> float:
    if not 0 <= within < 1:
        raise ValueError("the limit must be at least 0 and below 1: samples that share nothing are 1 apart")
    return within


def _bray_curtis(s, total):
    return 1 - 2 * s / total


def _unifrac(s, total):
    return (total - 2 * s) / total


def _unifrac_unweighted(s, total):
    return 1 - s / (total - s)


def _links(cells: DataFrame, key: str, value: str, distance, within: float | None, share: float) -> DataFrame:
    return overlap_links(cells, "sample_id", key, value, distance, within, share).withColumnRenamed("item", "sample_id")


def bray_curtis(counts: DataFrame, within: float | None = None, links: bool = False) -> DataFrame:
    """Distances of all pairs or, with ``within`` (below 1), of the pairs at most that far apart; the others are not built then,
    and cells that are NULL, infinite or not above zero count as absent.

    With ``links`` as well, no pair is built: ``(sample_id, class_id, links)`` has every sample's number of such pairs and the smallest
    sample that they lead to, from one to the next.
    """
    if links and within is None:
        raise ValueError("links need a limit")
    if within is not None:
        share = (1 - _checked_limit(within)) / 2
        if links:
            return _links(counts, "feature_id", "count", _bray_curtis, within, share)
        near = overlap_pairs(counts, "sample_id", "feature_id", "count", share)
        return _distance(near, F.greatest(_bray_curtis(F.col("s"), F.col("ti") + F.col("tj")), F.lit(0.0))).filter(F.col("d") <= within)
    return _distance(pair_sums(counts, "sample_id", "feature_id", "count", "min", totals=True), _bray_curtis(F.col("s"), F.col("ti") + F.col("tj")))


def unifrac(proportions: DataFrame, weighted: bool = True, normalized: bool = True, within: float | None = None, links: bool = False) -> DataFrame:
    """UniFrac from branch proportions, of all pairs or, with ``within`` (below 1, and not for the weighted form that is not
    normalized), of the pairs at most that far apart (or a billionth more: sums at the limit depend on their order). ``links`` as for ``bray_curtis``.

    Only shared branches need a pair: sum L|a-b| = sum La + sum Lb - 2 sum L min(a, b). Branches near the root are below nearly all samples, so
    near pairs are looked for block by block (``overlap_near``); none but them leaves a task.
    """
    if within is not None and weighted and not normalized:
        raise ValueError("a distance that is not normalized has no limit below which samples share a branch")
    if links and within is None:
        raise ValueError("links need a limit")
    share = F.col("length") * (F.col("p") if weighted else F.lit(1.0))
    held = F.col("p") > 0
    if within is not None:
        cells, of = proportions.select("sample_id", "branch", F.when(held, share).alias("w")), _unifrac if weighted else _unifrac_unweighted
        least = (1 - _checked_limit(within)) / (2 if weighted else 2 - within)
        return _links(cells, "branch", "w", of, within, least) if links else overlap_near(cells, "sample_id", "branch", "w", of, within, least)
    both = pair_sums(proportions.filter(held).select("sample_id", "branch", share.alias("w")), "sample_id", "branch", "w", "min", totals=True)
    total = F.col("ti") + F.col("tj")
    if weighted:
        unshared = total - 2 * F.col("s")
        return _distance(both, F.greatest(unshared / total if normalized else unshared, F.lit(0.0)))
    return _distance(both, _unifrac_unweighted(F.col("s"), total))


def dpcoa_distance(proportions: DataFrame) -> DataFrame:
    """Square root of sum L (a-b)^2 over branches: distances of double principal coordinate analysis."""
    cells = proportions.select("sample_id", "branch", (F.sqrt("length") * F.col("p")).alias("w"))
    return _distance(pair_sums(cells, "sample_id", "branch", "w", "sqdiff"), F.sqrt("s"))


def mst_threshold(d: DataFrame) -> float:
    """Longest edge of the minimum spanning tree, by Boruvka rounds over the long table.

    Every component picks its shortest way out (ties by the pair's names), the picks are merged by
    pointer doubling, and at most log2(n) rounds remain. Only the longest pick of a round reaches the
    driver.
    """
    d = cut_lineage(d)
    label = cut_lineage(
        d.select(F.explode(F.array("i", "j")).alias("node")).distinct().withColumn("c", F.col("node"))
    )
    n, longest = label.count(), 0.0
    while True:
        at = lambda s: per_item(label.select(F.col("node").alias(s), F.col("c").alias(f"c{s}")), n)
        across = d.join(at("i"), "i").join(at("j"), "j").filter(F.col("ci") != F.col("cj"))
        edge = F.struct("d", "i", "j")
        ways = across.select(F.explode(F.array(
            F.struct(F.col("ci").alias("c"), edge.alias("e"), F.col("cj").alias("to")),
            F.struct(F.col("cj").alias("c"), edge.alias("e"), F.col("ci").alias("to")),
        )).alias("w")).select("w.*")
        pick = cut_lineage(ways.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e.d"))
        row = pick.agg(F.max("d"), F.count("c")).first()
        if not row[1]:
            if label.select("c").distinct().count() > 1:
                raise ValueError("the distance table leaves nodes unconnected")
            return longest
        longest = max(longest, row[0])
        # two components that picked each other form the only cycles: the smaller name becomes the root
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("__back"))
        mutual = (F.col("__back") == F.col("c")) & (F.col("c") < F.col("to"))
        parent = cut_lineage(pick.join(back, "to").select("c", F.when(mutual, F.col("c")).otherwise(F.col("to")).alias("p")))
        while True:
            hop = parent.select(F.col("c").alias("p"), F.col("p").alias("__pp"))
            jumped = cut_lineage(parent.join(hop, "p").select("c", "p", F.col("__pp")))
            stable = jumped.filter(F.col("p") != F.col("__pp")).isEmpty()
            parent = jumped.select("c", F.col("__pp").alias("p"))
            if stable:
                break
        label = cut_lineage(label.join(parent, "c").select("node", F.col("p").alias("c")))


def truncate(d: DataFrame, threshold: float) -> DataFrame:
    """Distances above the threshold become four times the threshold."""
    return d.withColumn("d", F.when(F.col("d") > threshold, F.lit(4 * threshold)).otherwise(F.col("d")))


# --- the spanning tree without all pairs ----------------------------------------------------------


def _cells(width: float, axes: int, point: str = "x") -> list[Column]:
    return [F.floor(F.col(point)[a] / width).cast("double").alias(f"c{a}") for a in range(axes)]


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges between components ``a`` and ``b`` those of the minimum spanning forest, all components, and the one that each becomes part of.

    Boruvka rounds; of edges of one length the one with the smaller ids ``i``, ``j`` is the shorter.
    """
    nodes = np.unique(np.concatenate([a, b]))
    order = np.lexsort((j, i, d))
    a, b = np.searchsorted(nodes, a[order]), np.searchsorted(nodes, b[order])
    label, live, kept = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        u, v = label[a[live]], label[b[live]]
        live, u, v = live[u != v], u[u != v], v[u != v]
        if not len(live):
            return order[np.concatenate(kept)] if kept else order[:0], nodes, nodes[label]
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, u, live)
        np.minimum.at(first, v, live)
        own = np.flatnonzero(first < len(order))
        kept.append(np.unique(first[own]))
        up = np.arange(len(nodes))
        up[own] = label[a[first[own]]] + label[b[first[own]]] - own  # the other end
        root = own[(up[up[own]] == own) & (own < up[own])]  # two that picked each other form the only cycles
        up[root] = root
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _tile_forest(tile: pd.DataFrame, radius: float, axes: int) -> pd.DataFrame:
    """The minimum spanning forest of a tile's components: shortest ways of at most ``radius`` between their points."""
    point, c = tile["id"].to_numpy(np.int64), tile["c"].to_numpy(np.int64)
    x = tile[[n for n in tile.columns if n.startswith("x")]].to_numpy(float)
    _, c_code = np.unique(c, return_inverse=True)
    place = np.floor(x[:, :axes] / (radius * (1 + 1e-6)))
    # rounding leaves a point in a cell next to its own at most, so there is room around
    place = (place - place.min(axis=0)).astype(np.int64) + 1
    strides = np.cumprod(np.concatenate([[1], (place.max(axis=0) + 2)[:-1]]))
    cell = place @ strides
    order = np.lexsort((c_code, cell))
    point, c, x, c_code, cell = point[order], c[order], x[order], c_code[order], cell[order]
    held = int(c_code.max(initial=0)) + 1
    run = cell * held + c_code
    kept = [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64)]
    for step in itertools.product((-1, 0, 1), repeat=axes):
        if step < (0,) * axes:
            continue  # the other side of a step that is taken
        there = cell + int(np.dot(step, strides))
        to = np.searchsorted(cell, there, "right")
        after = np.searchsorted(run, there * held + c_code, "right")
        ranges = [(after, to)]
        if any(step):
            ranges.append((np.searchsorted(cell, there), np.searchsorted(run, there * held + c_code)))
        for low, high in ranges:
            n = high - low
            upto = np.cumsum(n)
            for part in np.split(np.arange(len(n)), np.searchsorted(upto, np.arange(MET, upto[-1], MET))):
                p = np.repeat(part, n[part])
                if not len(p):
                    continue
                q = np.arange(len(p)) - np.repeat(upto[part] - n[part] - (upto[part[0]] - n[part[0]]), n[part]) + low[p]
                squares = np.zeros(len(p))
                for axis in range(x.shape[1]):
                    squares += (x[p, axis] - x[q, axis]) ** 2
                d = np.sqrt(squares)
                p, q, d = p[d <= radius], q[d <= radius], d[d <= radius]
                more = [c[p], c[q], d, np.minimum(point[p], point[q]), np.maximum(point[p], point[q])]
                edges = [np.concatenate(e) for e in zip(kept, more)]
                best = _forest(*edges)[0]
                kept = [e[best] for e in edges]
    return pd.DataFrame(dict(zip(("a", "b", "d", "i", "j"), kept)))


def _forests(points: DataFrame, radius: float, axes: int, coords: int) -> DataFrame:
    """``(a, b, d, i, j)``: shortest ways of at most ``radius`` between the points of different components of ``points`` (id, x, c), as
    many as the minimum spanning forest may have.

    Cells lie in tiles of at most ``TILE`` points, or one cell; a tile's task sees its points and those of the cells around it. An
    edge that is the longest of a circle there is in no minimum spanning tree, so only the edges of the tile's own forest leave it.
    """
    n, fullest = points.groupBy(*_cells(radius * (1 + 1e-6), axes)).count().agg(F.sum("count"), F.max("count")).first()
    across = max(1, int((TILE / (fullest or 1)) ** (1 / axes)))
    placed = points.select("id", "c", *[F.col("x")[a].alias(f"x{a}") for a in range(coords)], *_cells(radius * (1 + 1e-6), axes))
    for a in range(axes):
        near = F.array_distinct(F.array(*[F.floor((F.col(f"c{a}") + s) / across).cast("double") for s in (-1.0, 0.0, 1.0)]))
        placed = placed.withColumn(f"t{a}", F.explode(near)).drop(f"c{a}")
    at = [f"t{a}" for a in range(axes)]
    return placed.repartition(max(1, math.ceil((n or 0) / TASK_POINTS)), *at).groupBy(*at).applyInPandas(
        lambda tile: _tile_forest(tile, radius, axes), "a long, b long, d double, i long, j long")


def _ways_out(points: DataFrame, radius: float, axes: int) -> DataFrame:
    """``(c, to, d)``: of every component of ``points`` (id, x, c), the shortest way to a point of another one, if there is one
    of at most ``radius``. Pairs within a component are never made."""
    coords = points.agg(F.max(F.size("x"))).first()[0] or axes
    return _picks(_forests(points, radius, axes, coords))


def _picks(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to")))
    best = edges.select(F.explode(ways).alias("w"), "d", "i", "j").groupBy("w.c").agg(F.min(F.struct("d", "i", "j", "w.to")).alias("e"))
    return best.select("c", F.col("e.to").alias("to"), F.col("e.d").alias("d"))


def _connected(edges: pd.DataFrame) -> pd.DataFrame:
    """``(c, p, d)``: components, those they become part of when all edges are followed, and the longest edge of the forest."""
    best, nodes, into = _forest(*[edges[n].to_numpy() for n in ("a", "b", "d", "i", "j")])
    return pd.DataFrame({"c": nodes, "p": into, "d": edges["d"].to_numpy()[best].max(initial=0.0)})


def _merged(picks: DataFrame) -> DataFrame:
    """``(c, p)``: the component that every picking one becomes part of, by pointer jumping, two jumps between checkpoints."""
    back = picks.select(F.col("c").alias("to"), F.col("to").alias("back_"))
    mutual = F.coalesce(F.col("back_") == F.col("c"), F.lit(False)) & (F.col("c") < F.col("to"))
    parent = cut_lineage(picks.join(back, "to", "left").select("c", F.when(mutual, F.col("c")).otherwise(F.col("to")).alias("p")))
    while True:
        hop = lambda t: t.select(F.col("c").alias("p"), F.col("p").alias("pp_"))
        jump = lambda t: t.join(hop(t), "p", "left").select("c", F.coalesce("pp_", "p").alias("p"))
        once = jump(parent)
        twice = cut_lineage(jump(once))
        moved = not twice.join(parent.withColumnRenamed("p", "was_"), "c").filter("p <> was_").isEmpty()
        parent = twice
        if not moved:
            return parent


def spanning_threshold(points: DataFrame, key: str, coords: list[str], gathered: int = GATHERED) -> float:
    """Longest edge of the points' minimum spanning tree, from neighbours on a grid instead of all pairs.

    Tiles of the grid give the shortest ways of at most a radius between different components, those of their own spanning forests
    only. Up to ``gathered`` components one task follows these ways; more of them merge in Boruvka rounds in Spark first. When no way is
    left, the radius doubles. A shortest way out that is known is an edge of the tree whatever lies farther away. Points at one
    place are one node. The first radius makes cells with few points each. A missing or infinite coordinate is an error; fewer than two places give 0.
    """
    src = points.select(F.array(*[F.col(f"`{c}`").cast("double") for c in coords]).alias("x"))
    # a coordinate of -0.0 is one of 0.0
    src = store(store(src.select(F.transform("x", lambda v: v + F.lit(0.0)).alias("x")).distinct()).withColumn("id", F.monotonically_increasing_id()))
    if not src.filter(F.coalesce(~F.forall("x", lambda v: F.abs(v) < float("inf")), F.lit(True))).isEmpty():
        raise ValueError(f"a {key} has no place")
    n, axes = src.count(), min(len(coords), GRID_AXES)
    if n < 2:
        return 0.0
    box = src.agg(*[F.max(F.col("x")[a]) - F.min(F.col("x")[a]) for a in range(len(coords))]).first()
    span = max(box)
    radius = span * (max(1.0, math.log(n)) / n) ** (1 / axes)
    for _ in range(30):
        fullest = src.groupBy(*_cells(radius, axes)).count().agg(F.max("count")).first()[0]
        if fullest <= CROWDED or radius < span * 1e-9:
            break
        radius /= 4
    labelled, parts, longest = src.withColumn("c", F.col("id")), n, 0.0
    while parts > 1:
        ways = store(_forests(labelled, radius, axes, len(coords)))
        if parts <= gathered:
            into = store(ways.groupBy().applyInPandas(_connected, "c long, p long, d double"))
            far, merged = into.agg(F.max("d"), F.count_if(F.col("c") != F.col("p"))).first()
        else:
            picks = cut_lineage(_picks(ways))
            into, far, merged = _merged(picks), picks.agg(F.max("d")).first()[0], None
        if far is None:
            radius *= 2
            continue
        longest = max(longest, far)
        labelled = store(labelled.join(into.select("c", "p"), "c", "left").select("id", "x", F.coalesce("p", "c").alias("c")))
        parts = labelled.select("c").distinct().count() if merged is None else parts - merged
        if merged is not None:
            radius *= 2  # all ways of this radius are followed
    return float(longest)


def near_within_tree(points: DataFrame, key: str, coords: list[str]) -> tuple[DataFrame, float]:
    """The pairs ``(i, j, d)`` at most as far apart as the longest edge of the spanning tree, and that length. All other
    distances count as four times it in the spatial step, so they need no rows."""
    threshold = spanning_threshold(points, key, coords)
    return euclidean(points, key, coords, within=threshold), threshold
