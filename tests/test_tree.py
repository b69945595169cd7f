"""Tips in a row and branches as intervals, against walks to the root."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tarn.operators import prefix, tree
from tarn.operators.tree import branch_proportions, branch_sums, interval_proportions, tree_closure, tree_intervals

EDGES = "node string, parent string, length double, is_tip boolean"


def random_tree(rnd, n, back):
    """n nodes; a node's parent is one of the ``back`` nodes before it."""
    parent = {k: max(0, k - rnd.randint(1, back)) for k in range(1, n)}
    inner = set(parent.values())
    return [(f"n{k}", f"n{p}", 0.5 + k % 5, k not in inner) for k, p in parent.items()]


def walk(edges):
    up = {n: p for n, p, _, _ in edges}
    below = defaultdict(set)
    for n, _, _, tip in edges:
        at = n
        while tip and at in up:
            below[at].add(n)
            at = up[at]
    return below


@pytest.mark.parametrize("back", [1, 2, 6, 200])
def test_intervals(spark, back):
    edges = random_tree(random.Random(back), 200, back)
    rows = {r.node: r for r in tree_intervals(spark.createDataFrame(edges, EDGES).repartition(3)).collect()}
    place = {r.first: r.node for r in rows.values() if r.is_tip}
    below = walk(edges)
    assert len(rows) == 199 and sorted(place) == list(range(len(place)))
    for n, r in rows.items():
        assert {place[k] for k in range(r.first, r.first + r.tips)} == below[n]


@pytest.mark.parametrize("back, width, per_task", [(1, 10, 5), (3, 7, 20), (3, 1 << 16, 1 << 20), (200, 16, 30)])
def test_branch_sums(spark, back, width, per_task):
    rnd = random.Random(back + width)
    edges = random_tree(rnd, 150, back) + [("r0", None, 0.0, False), ("lone", "r0", 2.0, True)]
    tips = [e[0] for e in edges if e[3]]
    counts = [(rnd.choice(tips), f"s{k}") for k in range(9) for _ in range(12)] + [("not in the tree", "s1")]
    counts = [(f, s, float(rnd.randint(1, 9))) for f, s in sorted(set(counts))]
    want = defaultdict(float)
    for branch, some in walk(edges).items():
        for f, s, c in counts:
            if f in some and branch != "r0":  # a root is no branch
                want[s, branch] += c
    df = spark.createDataFrame(counts, "feature_id string, sample_id string, count double")
    got = branch_sums(df, tree_intervals(spark.createDataFrame(edges, EDGES)), width, per_task).collect()
    assert {(r.sample_id, r.branch): r.c for r in got} == pytest.approx(dict(want)) and len(got) == len(want)


def test_proportions_equal_the_closure_s(spark):
    edges = random_tree(random.Random(8), 120, 9)
    tips = [e[0] for e in edges if e[3]]
    tree = spark.createDataFrame(edges, EDGES)
    counts = spark.createDataFrame([(f, s, float(k + 1)) for k, f in enumerate(tips) for s in ("a", "b") if (k + ord(s)) % 3], "feature_id string, sample_id string, count double")
    old = {(r.sample_id, r.branch): (r.length, r.p) for r in branch_proportions(counts, tree_closure(tree)).collect()}
    new = {(r.sample_id, r.branch): (r.length, r.p) for r in interval_proportions(counts, tree_intervals(tree), 8).collect()}
    assert new.keys() == old.keys() and all(new[k] == pytest.approx(old[k]) for k in old)


def test_a_chain_of_many_nodes(spark):
    n = 100_000
    chain = spark.range(n).selectExpr(f"'n' || id AS node", "CASE WHEN id > 0 THEN 'n' || (id - 1) END AS parent", "1.0D AS length", f"id = {n - 1} OR id % 1000 = 999 AS is_tip")
    rows = tree_intervals(chain)
    assert rows.filter(f"tips <> floor((999 + {n} - int(substring(node, 2))) / 1000)").isEmpty()
    counts = spark.createDataFrame([(f"n{n - 1}", "s", 2.0), ("n999", "s", 1.0)], "feature_id string, sample_id string, count double")
    sums = branch_sums(counts, rows)
    assert sums.count() == n - 1 and sums.filter("c = 3").count() == 999


def test_cycles_are_refused(spark):
    rows = [("a", "b", 1.0, False), ("b", "c", 1.0, False), ("c", "a", 1.0, False), ("t", "a", 1.0, True), ("x", None, 1.0, False), ("y", "x", 1.0, True)]
    with pytest.raises(ValueError):
        tree_intervals(spark.createDataFrame(rows, EDGES))


def test_running(spark):
    rows = [(k, k % 3, k % 7) for k in range(400)]
    got = prefix.running(spark.createDataFrame(rows, "k long, g int, v long"), "v", "g", "k").collect()
    for g in range(3):
        total, mine = 0, sorted((r for r in got if r.g == g), key=lambda r: r["at"])
        for place, r in enumerate(mine):
            assert (r["at"], r.before) == (place, total)
            total += r.v


def test_a_running_sum_is_worked_out_once_per_sample_and_position():
    """However many intervals end there: a chain's end in one place."""
    cells = pd.DataFrame({"sample": ["a", "a", "b"], "pos": [3, 5, 4], "c": [1.0, 2.0, 4.0], "n": [1, 1, 1]})
    spans = pd.DataFrame({"first": [3, 4, 6], "tips": [2, tree.BEGIN, tree.END]})
    got = tree._slice_sums(cells, spans)
    assert sorted(map(tuple, got[["sample", "first", "tips", "c"]].itertuples(index=False))) == [
        ("a", 3, 2, 1.0), ("a", 4, tree.BEGIN, 1.0), ("a", 6, tree.END, 3.0), ("b", 3, 2, 4.0), ("b", 4, tree.BEGIN, 0.0), ("b", 6, tree.END, 4.0)]


def test_cells_of_a_tip_without_a_branch_count_nowhere():
    """A root tip's cell may stand before all intervals of its slice."""
    cells = pd.DataFrame({"sample": ["a", "a"], "pos": [0, 2], "c": [1.0, 2.0], "n": [1, 1]})
    got = tree._slice_sums(cells, pd.DataFrame({"first": [2], "tips": [1]}))
    assert got.values.tolist() == [["a", 2, 1, 2.0, 1]]


def test_the_largest_task_of_branch_sums_is_small():
    """As many cells as a task takes, 25 samples and all their branches, in less memory than a tenth of a worker's share."""
    n = tree.CELLS_PER_TASK
    cells = pd.DataFrame({"sample": [f"NATION_{k % 25}" for k in range(n)], "pos": np.arange(n) // 25, "c": 1.0, "n": 1})
    spans = pd.DataFrame({"first": np.arange(n // 25), "tips": 1})
    tracemalloc.start()
    got = tree._slice_sums(cells, spans)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n and peak < 100e6
