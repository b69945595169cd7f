"""Rooted trees as edge tables ``(node, parent, length, is_tip)``; the root has no parent row of its own
or a NULL parent."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, store
from .pairs import per_item
from .prefix import running

MAX_ROUNDS = 40
#: Tip positions whose cells meet in one task, at most.
SLICE = 1 << 16
CELLS_PER_TASK = 100_000
BEGIN, END = -1, -2  # in place of an interval's length: the running sum up to its begin or end
ROOT = -1  # stands above all roots


def tree_closure(edges: DataFrame) -> DataFrame:
    """``(tip, branch, length)``: every tip with the branches on its way to the root, its own included.

    Pointer doubling: each round doubles the known stretch of every path, so a tree of depth d takes
    log2(d) rounds. A branch is named by its lower node.
    """
    branch = edges.filter(F.col("parent").isNotNull())
    # jump: node -> the ancestor reached so far; path: node -> branches passed on the way
    path = cut_lineage(branch.select("node", F.col("node").alias("branch")))
    jump = cut_lineage(branch.select("node", F.col("parent").alias("to")))
    for _ in range(MAX_ROUNDS):
        onward = path.select(F.col("node").alias("to"), "branch")
        longer = jump.join(onward, "to").select("node", "branch")
        path = cut_lineage(path.unionByName(longer))
        hop = jump.select(F.col("node").alias("to"), F.col("to").alias("__next"))
        jump = cut_lineage(jump.join(hop, "to").select("node", F.col("__next").alias("to")))
        if jump.isEmpty():
            lengths = branch.select(F.col("node").alias("branch"), "length")
            tips = branch.filter("is_tip").select("node")
            return (
                path.join(tips, "node", "left_semi").join(lengths, "branch")
                .select(F.col("node").alias("tip"), "branch", "length")
            )
    raise ValueError("the edges hold a cycle")


def branch_proportions(counts: DataFrame, closure: DataFrame) -> DataFrame:
    """``(sample_id, branch, length, p)``: share of a sample's individuals below each branch."""
    totals = counts.groupBy("sample_id").agg(F.sum("count").alias("__t"))
    below = (
        counts.join(closure, counts["feature_id"] == closure["tip"])
        .groupBy("sample_id", "branch")
        .agg(F.sum("count").alias("__c"), F.first("length").alias("length"))
    )
    return below.join(totals, "sample_id").select("sample_id", "branch", "length", (F.col("__c") / F.col("__t")).alias("p"))


# --- tips in a row, branches as intervals ---------------------------------------------------------


def _rank_list(links: DataFrame) -> DataFrame:
    """``(e, s)``: the sum of the weights from each element to the end of its list ``(e, next, s)``, by pointer doubling."""
    links = cut_lineage(links)
    open_ = links.filter("next IS NOT NULL").count()
    for _ in range(2 * MAX_ROUNDS):
        if not open_:
            return links.select("e", "s")
        onward = links.select(F.col("e").alias("next"), F.col("next").alias("next_"), F.col("s").alias("s_"))
        links = cut_lineage(links.join(onward, "next", "left").select("e", F.col("next_").alias("next"), (F.col("s") + F.coalesce("s_", F.lit(0))).alias("s")))
        left = links.filter("next IS NOT NULL").count()
        if left == open_:
            break
        open_ = left
    raise ValueError("the edges hold a cycle")


def _tour(core: DataFrame) -> DataFrame:
    """``(id, start, size)`` of a tree ``(id, pid, w)`` below ROOT: weights before a node and in its subtree, by an Euler tour.

    The tour goes down and up every edge; each step knows the next one, so it is a linked list whose ranks are the sums.
    """
    core = store(core)
    placed = store(running(core.filter(F.col("id") != ROOT), "w", "pid", "id").select("id", "pid", "at"))
    down, up = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    child = placed.filter("at = 0").select(F.col("pid").alias("id"), F.col("id").alias("child"))
    sibling = placed.select("pid", (F.col("at") - 1).alias("at"), F.col("id").alias("sibling"))
    steps = core.join(child, "id", "left").select(down("id").alias("e"), F.coalesce(down("child"), up("id")).alias("next"), F.col("w").alias("s"))
    back = placed.join(sibling, ["pid", "at"], "left").select(up("id").alias("e"), F.coalesce(down("sibling"), up("pid")).alias("next"), F.lit(0).cast("long").alias("s"))
    end = core.filter(F.col("id") == ROOT).select(up("id").alias("e"), F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("s"))
    ranked = _rank_list(steps.unionByName(back).unionByName(end))
    total = ranked.agg(F.max("s")).first()[0] or 0
    half = lambda side, name: ranked.filter(F.pmod("e", F.lit(2)) == side).select(F.floor(F.col("e") / 2).alias("id"), F.col("s").alias(name))
    return half(0, "d").join(half(1, "u"), "id").select("id", (F.lit(total) - F.col("d")).alias("start"), (F.col("d") - F.col("u")).alias("size"))


def tree_intervals(edges: DataFrame) -> DataFrame:
    """``(node, parent, length, is_tip, first, tips)``: the tips in a row, so that those below any node stand at ``first`` and the
    ``tips - 1`` places after it. Stored.

    Leaves are raked into their parents while they are at least a quarter of what is left (three rounds for three ranks); what is left
    then, such as long chains, is numbered by an Euler tour, in rounds by the logarithm of its size. Nothing grows with the depth.
    """
    rows = store(store(edges.select("node", "parent", F.col("length").cast("double").alias("length"), "is_tip")).withColumn("id", F.monotonically_increasing_id()))
    above = rows.select(F.col("node").alias("parent"), F.col("id").alias("pid"))
    own = F.col("is_tip").cast("long")
    root = rows.sparkSession.createDataFrame([(ROOT, None, 0)], "id long, pid long, w long")
    live = store(rows.join(above, "parent", "left").select("id", F.coalesce("pid", F.lit(ROOT)).alias("pid"), F.coalesce(own, F.lit(0)).alias("w")).unionByName(root))
    raked, left = [], live.count()
    while left > 1:
        leaves = store(live.filter(F.col("id") != ROOT).join(live.select(F.col("pid").alias("id")).distinct(), "id", "left_anti"))
        gone = leaves.count()
        if 4 * gone < left:
            break
        base = live.select(F.col("id").alias("pid"), F.col("w").alias("base"))
        raked.append(store(running(leaves, "w", "pid", "id").join(base, "pid").select("id", "pid", (F.col("base") + F.col("before")).alias("offset"), F.col("w").alias("size"))))
        more = leaves.groupBy(F.col("pid").alias("id")).agg(F.sum("w").alias("more"))
        live = store(live.join(leaves.select("id"), "id", "left_anti").join(more, "id", "left").select("id", "pid", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")))
        left -= gone
    done = store(_tour(live)) if left > 1 else live.select("id", F.lit(0).cast("long").alias("start"), F.col("w").alias("size"))
    for level in reversed(raked):
        at = done.select(F.col("id").alias("pid"), "start")
        done = store(done.unionByName(level.join(at, "pid").select("id", (F.col("start") + F.col("offset")).alias("start"), "size")))
    return store(rows.join(done, "id").select("node", "parent", "length", "is_tip", F.col("start").alias("first"), F.col("size").alias("tips")))


def _nested(lo: list[int], hi: list[int], low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of nested intervals, outermost first: the one around each, and the innermost one at every position from ``low`` on."""
    parent, innermost, stack, at = np.full(len(lo), -1), np.full(width, -1), [], low

    def upto(end: int) -> None:
        nonlocal at
        while at < end:
            while stack and hi[stack[-1]] <= at:
                stack.pop()
            to = min(end, hi[stack[-1]]) if stack else end
            innermost[at - low:to - low] = stack[-1] if stack else -1
            at = to

    for k, a in enumerate(lo):
        upto(a)
        while stack and hi[stack[-1]] <= a:
            stack.pop()
        parent[k] = stack[-1] if stack else -1
        stack.append(k)
    upto(low + width)
    return parent, innermost


def _slice_sums(cells: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Sums of samples' cells in intervals of positions, only those that hold a cell, and samples' running sums up to given positions.

    ``cells`` is ``sample, pos, c, n`` with one row ``pos = -1`` for what a sample holds in earlier slices; ``spans`` is ``first, tips``,
    an interval within the slice or, with ``tips`` BEGIN or END, a position up to which the sums run.
    """
    code, samples = pd.factorize(cells["sample"], sort=True)
    pos, c, n = cells["pos"].to_numpy(np.int64), cells["c"].to_numpy(float), cells["n"].to_numpy(np.int64)
    order = np.lexsort((pos, code))
    code, pos, c, n = code[order].astype(np.int64), pos[order], c[order], n[order]
    sums, count = np.concatenate([[0.0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(n)])
    starts = np.searchsorted(code, np.arange(len(samples)))
    own = np.flatnonzero(pos >= 0)
    low = int(np.concatenate([spans["first"].to_numpy(np.int64), pos[own]]).min(initial=np.iinfo(np.int64).max)) if len(spans) or len(own) else 0
    width = int(max(pos.max(initial=0), (spans["first"] + spans["tips"]).max() if len(spans) else 0)) + 2 - low
    keys = code * (width + 1) + np.where(pos < 0, 0, pos - low + 1)
    whose, firsts, tips, total, number = [], [], [], [], []

    def add(w, f, t, s, k) -> None:
        for into, x in zip((whose, firsts, tips, total, number), (w, f, t, s, k)):
            into.append(x)

    inner = spans[spans["tips"] >= 0].sort_values(["first", "tips"], ascending=[True, False])
    lo = inner["first"].to_numpy(np.int64)
    hi = lo + inner["tips"].to_numpy(np.int64)
    parent, innermost = _nested(lo.tolist(), hi.tolist(), low, width)
    before = np.where((own > 0) & (code[own - 1] == code[own]), pos[own - 1], -1)
    at = innermost[pos[own] - low] if len(own) else own
    while len(own):  # climb from each cell to the intervals that hold no earlier cell of the sample
        keep = at >= 0
        keep[keep] = lo[at[keep]] > before[keep]
        own, before, at = own[keep], before[keep], at[keep]
        end = np.searchsorted(keys, code[own] * (width + 1) + hi[at] - low + 1)
        add(code[own], lo[at], hi[at] - lo[at], sums[end] - sums[own], count[end] - count[own])
        at = parent[at]
    points = spans[spans["tips"] < 0]
    if len(points):
        every, x = np.repeat(np.arange(len(samples)), len(points)), np.tile(points["first"].to_numpy(np.int64), len(samples))
        end = np.searchsorted(keys, every * (width + 1) + x - low + 1)
        add(every, x, np.tile(points["tips"].to_numpy(np.int64), len(samples)), sums[end] - sums[starts[every]], count[end] - count[starts[every]])
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pd.DataFrame({"sample": samples[joined(whose, np.int64)], "first": joined(firsts, np.int64), "tips": joined(tips, np.int64),
                         "c": joined(total, float), "n": joined(number, np.int64)})


def branch_sums(counts: DataFrame, intervals: DataFrame, width: int = SLICE, cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """``(sample_id, branch, length, c)``: what a sample holds below every branch where it holds anything.

    Cells are dealt by slices of at most ``width`` tip positions. A branch is an interval: if it lies in one slice, its sum is a difference of
    the sample's running sums there; else it is the difference of the running sums at its two ends, to which the slices before
    theirs contribute one number per sample. A running sum is worked out once per sample and position, however many branches begin
    or end there. No cell is copied along its way to the root. Branches over the same tips share their sums. Slices are made narrower
    while they hold more than ``cells_per_task`` cells and more than two per sample, then dealt out by samples.
    """
    tips = intervals.filter("is_tip").select(F.col("node").alias("feature_id"), F.col("first").alias("pos"))
    placed = store(counts.join(tips, "feature_id").select(
        F.col("sample_id").alias("sample"), "pos", F.col("count").cast("double").alias("c"), F.lit(1).cast("long").alias("n")))
    n_cells, top, samples = placed.agg(F.count("*"), F.max("pos"), F.approx_count_distinct("sample")).first()
    wide = (top or 0) + 1
    slices = max(math.ceil(wide / width), min(n_cells // cells_per_task, n_cells // (2 * max(samples, 1))), 1)
    width = math.ceil(wide / slices)
    cells = placed.withColumn("slice", F.floor(F.col("pos") / width).cast("int"))
    branch = intervals.filter("parent IS NOT NULL AND tips > 0").select(F.col("node").alias("branch"), "length", "first", "tips")
    spans = branch.select("first", "tips").distinct()
    begin, end = F.floor(F.col("first") / width).cast("int"), F.floor((F.col("first") + F.col("tips") - 1) / width).cast("int")
    row = cells.groupBy("slice").agg(F.count("*").alias("n")).agg(F.max("n"), F.max("slice")).first()
    slices = (row[1] or 0) + 1
    blocks = max(1, math.ceil(((row[0] or 0) + (samples if slices > 1 else 0)) / cells_per_task))
    ends = spans.filter(begin == end).select("first", "tips", begin.alias("slice"))
    if slices > 1:
        across = spans.filter(begin != end).withColumn("end", F.col("first") + F.col("tips"))
        # the running sum up to an end is taken in the slice of the last position before it
        point = lambda at, side, there: across.select(F.col(at).alias("first"), F.lit(side).cast("long").alias("tips"), there.alias("slice")).distinct()
        ends = ends.unionByName(point("first", BEGIN, begin)).unionByName(point("end", END, end))
        held = cells.groupBy("sample", "slice").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
        every = cells.select("sample").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        so_far = Window.partitionBy("sample").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        earlier = every.join(held, ["sample", "slice"], "left").select(
            "sample", F.lit(-1).cast("long").alias("pos"), "slice", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).cast(t).alias(c) for c, t in (("c", "double"), ("n", "long"))])
        cells = cells.unionByName(earlier)
    kind = counts.schema["sample_id"].dataType.simpleString()
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int"))
    ends = ends.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = dealt.groupBy("slice", "block").cogroup(ends.groupBy("slice", "block")).applyInPandas(
        lambda left, right: _slice_sums(left, right[["first", "tips"]]), f"sample {kind}, first long, tips long, c double, n long")
    if slices > 1:
        parts = store(parts)
        upto = lambda side, at, k: parts.filter(F.col("tips") == side).select("sample", F.col("first").alias(at), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"))
        far = across.join(upto(BEGIN, "first", 0), "first").join(upto(END, "end", 1), ["sample", "end"]).filter("n1 > n0")
        parts = parts.filter("tips >= 0").unionByName(far.select("sample", "first", "tips", (F.col("c1") - F.col("c0")).alias("c"), (F.col("n1") - F.col("n0")).alias("n")))
    return parts.join(branch, ["first", "tips"]).select(F.col("sample").alias("sample_id"), "branch", "length", "c")


def interval_proportions(counts: DataFrame, intervals: DataFrame, width: int = SLICE) -> DataFrame:
    """``(sample_id, branch, length, p)`` as of ``branch_proportions``, from intervals instead of a closure."""
    totals = counts.groupBy("sample_id").agg(F.sum("count").alias("t"))
    totals = store(totals)
    return branch_sums(counts, intervals, width).join(per_item(totals, totals.count()), "sample_id").select("sample_id", "branch", "length", (F.col("c") / F.col("t")).alias("p"))
