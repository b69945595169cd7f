"""What must hold for any input: sums, symmetry, inequalities, and independence of partitioning."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import community as C, distance as D, gram as G, ordination as O, permute as P
from tarn.operators.tree import branch_proportions, tree_closure

RNG = np.random.default_rng(21)
SAMPLES, FEATURES = [f"s{i}" for i in range(9)], [f"f{i}" for i in range(30)]
CELLS = [(f, s, float(RNG.integers(1, 40))) for f in FEATURES for s in SAMPLES if RNG.random() < 0.6]


def tables(spark, parts):
    counts = spark.createDataFrame(CELLS, "feature_id string, sample_id string, count double").repartition(parts)
    inner = [(f"c{k}", "root", 1.0 + k, False) for k in range(5)]
    tips = [(f, f"c{i % 5}", 0.5 + i % 3, True) for i, f in enumerate(FEATURES)]
    tree = spark.createDataFrame(inner + tips, "node string, parent string, length double, is_tip boolean").repartition(parts)
    env = spark.createDataFrame([(s, float(i % 4), float(i * i % 7)) for i, s in enumerate(SAMPLES)], "id string, x double, y double")
    return counts, tree, env.repartition(parts)


def results(spark, parts):
    counts, tree, env = tables(spark, parts)
    shares = branch_proportions(counts, tree_closure(tree))
    d = D.unifrac(shares)
    space = O.constrained_space(d, env, [G.var("x"), G.var("y")])
    m = O.dbrda(space, ["x", "y"])
    return {
        "rich": {r["sample_id"]: tuple(r)[1:] for r in C.richness(counts).collect()},
        "d": {(r["i"], r["j"]): r["d"] for r in d.collect()},
        "bray": {(r["i"], r["j"]): r["d"] for r in D.bray_curtis(counts).collect()},
        "eig": O.pcoa(d, 2).eigenvalues, "f": m.f,
        "p": [r["p"] for r in P.permutation_test(m, spark, 99, by="terms").collect()],
        "trace": space.trace, "model": m,
    }


@pytest.fixture(scope="module")
def eight(spark):
    return results(spark, 8)


def test_partitioning_does_not_matter(spark, eight):
    one = results(spark, 1)
    for name in ("rich", "d", "bray"):
        assert one[name].keys() == eight[name].keys()
        assert all(np.allclose(one[name][k], eight[name][k], equal_nan=True) for k in one[name])
    assert np.allclose(one["eig"], eight["eig"]) and math.isclose(one["f"], eight["f"]) and one["p"] == eight["p"]


def test_distances_are_distances(eight):
    for name in ("d", "bray"):
        d = eight[name]
        assert set(d) == set(itertools.combinations(SAMPLES, 2)) and all(0 <= v <= 1 for v in d.values())
    at = lambda a, b: math.sqrt(eight["bray"][min(a, b), max(a, b)])
    for a, b, c in itertools.permutations(SAMPLES, 3):
        assert at(a, c) <= at(a, b) + at(b, c) + 1e-12


def test_inertia_adds_up(eight):
    parts = eight["model"].inertia
    assert math.isclose(parts["total"], parts["constrained"] + parts["unconstrained"]) and eight["model"].f >= 0
    assert math.isclose(eight["model"].eigenvalues.sum(), eight["model"].ss_constrained)


def test_shares_sum_to_one(spark):
    counts, tree, _ = tables(spark, 4)
    shares = branch_proportions(counts, tree_closure(tree))
    tips = shares.filter(F.col("branch").startswith("f")).groupBy("sample_id").agg(F.sum("p").alias("p"))
    assert all(math.isclose(r["p"], 1) for r in tips.collect())
