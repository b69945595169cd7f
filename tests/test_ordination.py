import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.operators import distance as D, ordination as O, permute as P
from tarn.operators.gram import full_factorial, interact, var

from dense import gower, hat, square

RNG = np.random.default_rng(3)
IDS = [f"s{i:02d}" for i in range(14)]
POINTS = RNG.normal(size=(14, 5))
ENV = np.column_stack([POINTS[:, 0] + RNG.normal(size=14) * 0.3, RNG.normal(size=14), POINTS[:, 1] + RNG.normal(size=14)])


@pytest.fixture(scope="module")
def dist(spark):
    rows = [(k, *map(float, p)) for k, p in zip(IDS, POINTS)]
    pts = spark.createDataFrame(rows, "id string, a double, b double, c double, d double, e double")
    return D.euclidean(pts, "id", list("abcde")).cache()


@pytest.fixture(scope="module")
def env(spark):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in zip(IDS, ENV)], "id string, x double, y double, z double").cache()


@pytest.fixture(scope="module")
def space(dist, env):
    return O.constrained_space(dist, env, [var("x"), var("y"), var("z")], sqrt_dist=False)


def full():
    return np.sqrt(((POINTS[:, None] - POINTS[None]) ** 2).sum(-1))


def test_euclidean_and_distance_of_distances(dist):
    rows = dist.collect()
    assert len(rows) == 14 * 13 // 2 and all(r["i"] < r["j"] for r in rows)
    d = square(rows, IDS)
    assert np.allclose(d, full())
    dd = square(D.distance_of_distances(dist).collect(), IDS)
    assert np.allclose(dd, np.sqrt(((d[:, None] - d[None]) ** 2).sum(-1)))


@pytest.mark.parametrize("coords", ["a", "ab", "abcd"])
@pytest.mark.parametrize("within", [0.0, 0.25, 1.0])
def test_pairs_within_a_distance(spark, coords, within):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.uniform(-3, 3, (150, 4)), rng.integers(-4, 4, (150, 4)) / 4, [[1e7, 0, 0, 0], [1e7 + 0.25, 0, 0, 0]]])
    rows = [(f"p{i:03d}", *map(float, p)) for i, p in enumerate(x)] + [("q1", None, 0.0, 0.0, 0.0), ("q2", float("inf"), 0.0, 0.0, 0.0), ("q3", float("nan"), 0.0, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "id string, a double, b double, c double, d double")
    d = np.sqrt(((x[:, None, :len(coords)] - x[None, :, :len(coords)]) ** 2).sum(-1))
    want = {(f"p{i:03d}", f"p{j:03d}"): d[i, j] for i, j in zip(*np.nonzero(np.triu(d <= within, 1)))}
    got = D.euclidean(pts, "id", list(coords), within=within)
    found = got.collect()
    assert len(found) == len(want) and {(r["i"], r["j"]): r["d"] for r in found} == pytest.approx(want)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_double_center_matches_dense(dist):
    got = np.zeros((14, 14))
    for r in O.double_center(dist).collect():
        got[IDS.index(r["i"]), IDS.index(r["j"])] = r["g"]
    assert np.allclose(got, gower(full()))


def test_pcoa(dist):
    o = O.pcoa(dist, 3)
    val, vec = np.linalg.eigh(gower(full()))
    assert np.allclose(o.eigenvalues, val[::-1][:3]) and np.isclose(o.trace, val.sum())
    rows = {r["id"]: r for r in o.scores.collect()}
    got = np.array([[rows[k][f"axis{c}"] for c in (1, 2, 3)] for k in IDS])
    want = vec[:, ::-1][:, :3] * np.sqrt(val[::-1][:3])
    assert np.allclose(np.abs(got), np.abs(want))
    assert all(got[np.abs(got[:, c]).argmax(), c] > 0 for c in range(3))


def test_dpcoa_matches_weighted_dense(dist, spark):
    w = np.arange(1, 15, dtype=float)
    o = O.dpcoa(dist, spark.createDataFrame(list(zip(IDS, w.tolist())), "id string, w double"), 2)
    w = w / w.sum()
    c = np.eye(14) - np.outer(np.ones(14), w)
    g = c @ (-0.5 * full() ** 2) @ c.T
    m = np.sqrt(w)[:, None] * g * np.sqrt(w)[None]
    val = np.linalg.eigvalsh(m)[::-1]
    assert np.allclose(o.eigenvalues, val[:2]) and np.isclose(o.trace, val.sum())


def test_mst_threshold_and_truncation(dist, spark):
    d = full()
    inside, longest = [0], 0.0
    while len(inside) < 14:
        out = [j for j in range(14) if j not in inside]
        sub = d[np.ix_(inside, out)]
        longest = max(longest, sub.min())
        inside.append(out[sub.min(axis=0).argmin()])
    t = D.mst_threshold(dist)
    assert np.isclose(t, longest)
    line = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0), ("e", 5.0)], "id string, x double")
    dl = D.euclidean(line, "id", ["x"])
    assert D.mst_threshold(dl) == 3.0
    got = {(r["i"], r["j"]): r["d"] for r in D.truncate(dl, 3.0).collect()}
    assert got[("a", "e")] == 12.0 and got[("b", "e")] == 12.0 and got[("c", "e")] == 3.0 and got[("a", "c")] == 2.0


def test_spatial_vector(dist):
    t = D.mst_threshold(dist)
    o = O.spatial_vector(D.truncate(dist, t), 2)
    m = np.where(full() > t, 4 * t, full())
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    val, vec = np.linalg.eigh(z.T @ z / 13)
    assert np.allclose(o.eigenvalues, val[::-1][:2]) and np.isclose(o.trace, 14)
    rows = {r["id"]: r["axis1"] for r in o.scores.collect()}
    assert np.allclose(np.abs([rows[k] for k in IDS]), np.abs(vec[:, -1]))


def test_dbrda_matches_projection(space, spark):
    g, x = gower(full()), ENV - ENV.mean(0)
    h = hat(x)
    m = O.dbrda(space, ["x", "y", "z"])
    assert np.isclose(m.ss_constrained, np.trace(h @ g)) and np.isclose(space.trace, np.trace(g))
    eig = np.linalg.eigvalsh(h @ g @ h)[::-1][:3]
    assert np.allclose(m.eigenvalues, eig)
    inertia = m.inertia
    assert np.isclose(inertia["total"], inertia["constrained"] + inertia["unconstrained"])
    r2 = np.trace(h @ g) / np.trace(g)
    assert np.isclose(m.adj_r2, 1 - (1 - r2) * 13 / 10)
    # linear combination scores are unit length, site scores G u / lambda
    u = {r["id"]: [r["cap1"], r["cap2"]] for r in O.constraint_scores(m, 2).collect()}
    u = np.array([u[k] for k in IDS])
    assert np.allclose((u**2).sum(0), 1)
    s = {r["id"]: [r["cap1"], r["cap2"]] for r in O.site_scores(m, 2).collect()}
    assert np.allclose(np.array([s[k] for k in IDS]), g @ u / m.eigenvalues[:2] * np.trace(g) ** 0.25)
    b = {r["variable"]: (r["cap1"], r["cap2"]) for r in O.biplot(m, spark).collect()}
    assert np.allclose(b["y"], [np.corrcoef(x[:, 1], u[:, 0])[0, 1], np.corrcoef(x[:, 1], u[:, 1])[0, 1]])
    table = O.eigen_table(m, spark).orderBy("axis").collect()
    assert np.isclose(table[-1]["cum_fitted"], 1) and table[0]["label"].startswith("CAP 1 (")


def test_partial_vif_varpart(space):
    g, x = gower(full()), ENV - ENV.mean(0)
    part = O.dbrda(space, ["x"], ["y", "z"])
    assert np.isclose(part.ss_constrained, np.trace(hat(x) @ g) - np.trace(hat(x[:, 1:]) @ g))
    c = np.linalg.inv(np.corrcoef(x.T))
    assert np.allclose(list(O.vif(space).values()), np.diag(c))
    v = O.varpart(space, ["x"], ["y"])
    assert np.isclose(sum(v.values()), 1)


def test_aliased_and_interaction_terms(dist, env):
    terms = full_factorial([var("x"), var("y"), var("z")])
    assert [t.name for t in terms] == ["x", "y", "z", "x:y", "x:z", "y:z", "x:y:z"]
    twice = O.constrained_space(dist, env, [var("x"), var("x2", F.col("x") * 2), var("y")], sqrt_dist=False)
    assert twice.names == ["x", "y"]


def test_sqrt_distances_have_no_negative_inertia(dist, env):
    s = O.constrained_space(dist, env, [var("x")])
    g = gower(np.sqrt(full()))
    assert np.isclose(s.trace, np.trace(g)) and np.linalg.eigvalsh(g).min() > -1e-8 * s.trace


def test_residual_pairs(space):
    g, x = gower(full()), ENV - ENV.mean(0)
    r = np.eye(14) - hat(x[:, 1:])
    want = r @ g @ r
    got = {(a["i"], a["j"]): a["g"] for a in P.residual_pairs(space, [1, 2]).collect()}
    assert len(got) == 14 * 15 // 2
    for (i, j), v in got.items():
        assert np.isclose(v, want[IDS.index(i), IDS.index(j)])


def test_permutation_tests(space, spark):
    m = O.dbrda(space, ["x", "y", "z"])
    rows = {r["term"]: r for r in P.permutation_test(m, spark, 199).collect()}
    assert np.isclose(rows["Model"]["f"], m.f) and rows["Model"]["p"] <= 0.05
    again = {r["term"]: r for r in P.permutation_test(m, spark, 199).collect()}
    assert again["Model"]["p"] == rows["Model"]["p"]
    terms = P.permutation_test(m, spark, 99, by="terms").collect()
    assert np.isclose(sum(r["ss"] for r in terms), space.trace)
    assert [r["df"] for r in terms] == [1, 1, 1, 10]
    axes = P.permutation_test(m, spark, 99, by="axis").collect()
    assert np.isclose(axes[0]["f"], m.eigenvalues[0] / ((space.trace - m.ss_constrained) / 10))
    assert axes[0]["p"] <= axes[2]["p"]
    part = O.dbrda(space, ["x"], ["y", "z"])
    row = P.permutation_test(part, spark, 99).collect()[0]
    assert np.isclose(row["f"], part.f) and 0 < row["p"] <= 1


def test_permutation_distribution_is_uniform_under_null(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 1))
    rows = [(f"n{i:02d}", float(x[i, 0])) for i in range(30)]
    design = spark.createDataFrame(rows, "id string, x double")
    got = P.permuted_design(design, ["x"], 30, 400, 9).collect()
    monkeypatch.setattr(P, "SAMPLES_PER_BUCKET", 7)
    split = P.permuted_design(design, ["x"], 30, 400, 9).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, got))
    m = np.array([r["xs"] for r in got])
    assert m.shape == (30, 401)
    assert np.allclose(np.sort(m, axis=0), np.sort(m[:, :1], axis=0))
    assert np.allclose([r["xs"][0] for r in sorted(got, key=lambda r: r["id"])], x[:, 0])
    assert abs(m[:, 1:].mean(axis=1) - x.mean()).max() < 0.25


def test_ordistep(space, spark):
    g, x = gower(full()), ENV - ENV.mean(0)

    def partial_f(new, z):
        base = hat(x[:, z]) if z else np.zeros((14, 14))
        both = hat(x[:, [*z, new]])
        ss = np.trace((both - base) @ g)
        return ss / ((np.trace(g) - np.trace(both @ g)) / (14 - 2 - len(z)))

    chosen, log = P.ordistep(space, spark, n=199)
    steps = log.orderBy("step").collect()
    first = max(range(3), key=lambda k: partial_f(k, []))
    assert steps[0]["term"] == "xyz"[first] and np.isclose(steps[0]["f"], partial_f(first, []))
    # the p of the best second term, by brute force over the residualised matrix
    rest = [k for k in range(3) if k != first]
    tests = P._marginal_tests(space, ["xyz"[first]], ["xyz"[k] for k in rest], 399, 7)
    r = np.eye(14) - hat(x[:, [first]])
    rg, rng = r @ g @ r, np.random.default_rng(0)
    for k, (f, p) in zip(rest, tests):
        assert np.isclose(f, partial_f(k, [first]))
        hits = 0
        for _ in range(400):
            o = rng.permutation(14)
            q = r @ rg[np.ix_(o, o)] @ r
            xr = (r @ x[:, [k]])
            ss = np.trace(hat(xr) @ q)
            hits += ss / ((np.trace(q) - ss) / 11) >= f - 1e-12
        assert abs(p - (hits + 1) / 401) < 0.1
    assert set(chosen) <= {"x", "y", "z"}


def test_many_blocks_and_slices_give_the_same(spark, monkeypatch):
    from tarn.operators import pairs

    rows = [(i, f"k{j}", float((i * 7 + j * 3) % 11)) for i in range(23) for j in range(9) if (i + j) % 3]
    cells = spark.createDataFrame(rows, "item int, key string, value double")
    for how in ("min", "product", "sqdiff"):
        one = {(r["i"], r["j"]): r["s"] for r in pairs.pair_sums(cells, "item", "key", "value", how).collect()}
        monkeypatch.setattr(pairs, "ITEMS_PER_BLOCK", 5)
        monkeypatch.setattr(pairs, "CELLS_PER_TASK", 20)
        monkeypatch.setattr(pairs, "SLAB", 2)
        many = {(r["i"], r["j"]): r["s"] for r in pairs.pair_sums(cells, "item", "key", "value", how).collect()}
        monkeypatch.undo()
        assert len(one) == 23 * 22 // 2 and one.keys() == many.keys()
        assert all(abs(one[k] - many[k]) < 1e-9 for k in one)
        d = {(i, k): v for i, k, v in rows}
        f = {"min": min, "product": lambda a, b: a * b, "sqdiff": lambda a, b: (a - b) ** 2}[how]
        keys = {k for _, k, _ in rows}
        for (i, j), s in one.items():
            assert abs(s - sum(f(d.get((i, k), 0.0), d.get((j, k), 0.0)) for k in keys)) < 1e-9


@pytest.mark.parametrize("combine", ["min", "product", "sqdiff"])
def test_the_largest_task_of_pair_sums_is_small(combine):
    """As many cells as a task takes, in less memory than a tenth of a worker's share."""
    from tarn.operators import pairs

    n = pairs.CELLS_PER_TASK // 2  # items of one block: the other half is for a second one
    pdf = pd.DataFrame({"item": [f"NATION_{k % 25}" for k in range(n)], "key": [f"P{k // 25}" for k in range(n)], "value": 1.0, "mark": False, "block": 0, "bi": 0, "bj": 0, "slice": 0})
    tracemalloc.start()
    got = pairs._block_task(combine)(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 300 and peak < 50e6


def test_batches_and_wide_designs_give_the_same(space, spark, monkeypatch):
    m = O.dbrda(space, ["x", "y", "z"])
    one = P.permutation_test(m, spark, 49).collect()
    monkeypatch.setattr(P, "NUMBERS_PER_ROW", 40)
    many = P.permutation_test(m, spark, 49).collect()
    assert np.isclose(one[0]["f"], many[0]["f"]) and one[0]["p"] == many[0]["p"]
    monkeypatch.setattr(O, "WIDE", 2)
    assert np.allclose(O.cross_gower(space.pairs, space.design, space.names, space.n), space.t)


def test_restarts_reach_the_same_axes(spark, monkeypatch):
    from tarn.operators import eigen

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 60))
    ids = [f"r{i:03d}" for i in range(90)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = [(ids[i], ids[j], float(d[i, j])) for i in range(90) for j in range(i + 1, 90)]
    long = spark.createDataFrame(rows, "i string, j string, d double")
    monkeypatch.setattr(eigen, "MAX_BASIS", 40)
    o = O.pcoa(long, 2)
    val, vec = np.linalg.eigh(gower(d))
    assert np.allclose(o.eigenvalues, val[::-1][:2])
    got = {r["id"]: r["axis1"] for r in o.scores.collect()}
    assert np.allclose(np.abs([got[k] for k in ids]), np.abs(vec[:, -1]) * np.sqrt(val[-1]), atol=1e-6)
