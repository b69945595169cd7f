"""The spatial step and ordinations without pairs, against dense matrices and the forms on all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import distance as D, ordination as O
from tarn.operators.gram import full_factorial, var

from dense import gower, hat, square


def frame(spark, x):
    return spark.createDataFrame([(f"p{k:03d}", *map(float, p)) for k, p in enumerate(x)], "id string, " + ", ".join(f"x{a} double" for a in range(x.shape[1]))).repartition(4)


def bottleneck(x):
    """Longest edge of the spanning tree, growing it from the first point."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near, longest, out = d[0].copy(), 0.0, set(range(1, len(x)))
    while out:
        k = min(out, key=lambda j: near[j])
        longest = max(longest, near[k])
        out.remove(k)
        near = np.minimum(near, d[k])
    return longest


def made(kind):
    rng = np.random.default_rng(5)
    if kind == "even":
        return rng.uniform(0, 1, (300, 2))
    if kind == "clusters":  # two dense ones far apart, a lone point, copies, a point at zero twice
        return np.vstack([rng.normal(0, 1e-4, (300, 3)), rng.normal(50, 1e-3, (200, 3)), [[1000, 0, 0]] * 3, [[0.0, 0.0, -0.0], [0.0, 0.0, 0.0]]])
    if kind == "line":
        return np.cumsum(rng.integers(1, 30, (80, 1)), axis=0) / 8
    return rng.integers(0, 6, (60, 4)) / 2


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "lattice"])
def test_spanning_threshold(spark, kind):
    x = made(kind)
    got = D.spanning_threshold(frame(spark, x), "id", [f"x{a}" for a in range(x.shape[1])])
    assert got == pytest.approx(bottleneck(x), rel=1e-12)


def test_components_in_spark_give_the_same_threshold(spark):
    x = made("lattice")[:25]
    assert D.spanning_threshold(frame(spark, x), "id", ["x0", "x1", "x2", "x3"], gathered=0) == pytest.approx(bottleneck(x), rel=1e-12)


def test_spanning_threshold_of_few_points(spark):
    assert D.spanning_threshold(frame(spark, np.zeros((3, 2))), "id", ["x0", "x1"]) == 0.0
    assert D.spanning_threshold(frame(spark, np.zeros((1, 2))).limit(0), "id", ["x0", "x1"]) == 0.0
    with pytest.raises(ValueError):
        D.spanning_threshold(frame(spark, np.array([[0.0, np.nan], [1.0, 1.0]])), "id", ["x0", "x1"])


def test_ways_out_make_no_pair_within_a_component(spark):
    x = made("clusters")
    points = spark.createDataFrame([(k, [float(v) for v in p], int(k < 300)) for k, p in enumerate(x[:500])], "id long, x array<double>, c int")
    ways = D._ways_out(points, 100.0, 3).collect()
    d = np.sqrt(((x[:300, None] - x[None, 300:500]) ** 2).sum(-1)).min()
    assert {r.c: r.to for r in ways} == {0: 1, 1: 0} and all(r.d == pytest.approx(d) for r in ways)


def test_near_pairs_give_the_spatial_vector(spark):
    x = np.random.default_rng(2).uniform(0, 3, (60, 2))
    points = frame(spark, x)
    near, t = D.near_within_tree(points, "id", ["x0", "x1"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert near.count() == (np.triu(d <= t, 1)).sum() < 60 * 59 / 4
    o = O.spatial_vector_near(points.select("id"), near, 4 * t, 2)
    m = np.where(d > t, 4 * t, d)
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    val, vec = np.linalg.eigh(z.T @ z / 59)
    assert np.allclose(o.eigenvalues, val[::-1][:2]) and o.trace == 60
    rows = {r["id"]: r["axis1"] for r in o.scores.collect()}
    assert np.allclose(np.abs([rows[f"p{k:03d}"] for k in range(60)]), np.abs(vec[:, -1]))
    old = {r["id"]: r["axis1"] for r in O.spatial_vector(D.truncate(D.euclidean(points, "id", ["x0", "x1"]), t), 2).scores.collect()}
    assert rows == pytest.approx(old)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=(20, 30)) * (rng.random((20, 30)) < 0.4)
    rows = [(f"s{i:02d}", f"k{j}", float(y[i, j])) for i in range(20) for j in range(30) if y[i, j] or j == 0]
    return y, spark.createDataFrame(rows, "sample string, feature string, value double").cache()


def test_pcoa_of_cells(cells):
    y, df = cells
    o = O.pcoa_cells(df, "sample", "feature", "value", 3)
    g = (y - y.mean(0)) @ (y - y.mean(0)).T
    val, vec = np.linalg.eigh(g)
    assert np.allclose(o.eigenvalues, val[::-1][:3]) and np.isclose(o.trace, np.trace(g))
    rows = {r["id"]: [r["axis1"], r["axis2"]] for r in o.scores.collect()}
    got = np.array([rows[f"s{i:02d}"] for i in range(20)])
    assert np.allclose(np.abs(got), np.abs(vec[:, ::-1][:, :2] * np.sqrt(val[::-1][:2])))


def test_dpcoa_of_cells_equals_that_of_distances(spark, cells):
    y, df = cells
    shares = df.select(F.col("sample").alias("sample_id"), F.col("feature").alias("branch"), (1 + F.length("feature")).cast("double").alias("length"), F.abs("value").alias("p"))
    weights = spark.createDataFrame([(f"s{i:02d}", float(i % 5 + 1)) for i in range(20)], "id string, w double")
    one, two = O.dpcoa_cells(shares, weights, 2), O.dpcoa(D.dpcoa_distance(shares), weights, 2)
    assert np.allclose(one.eigenvalues, two.eigenvalues) and np.isclose(one.trace, two.trace)
    a, b = ({r["id"]: r["axis1"] for r in o.scores.collect()} for o in (one, two))
    assert a == pytest.approx(b)


def test_constrained_space_of_cells_equals_that_of_distances(spark, cells):
    y, df = cells
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 2)) + y[:, :2]
    env = spark.createDataFrame([(f"s{i:02d}", *map(float, x[i]), None if i == 7 else 1.0) for i in range(20)], "id string, a double, b double, c double")
    use = [i for i in range(20) if i != 7]
    terms = full_factorial([var("a"), var("b")]) + [var("c")]
    d = np.sqrt(((y[use][:, None] - y[use][None]) ** 2).sum(-1))
    space = O.constrained_space_cells(df, "sample", "feature", "value", env, terms)
    g, m = gower(d), O.dbrda(space, ["a", "b", "a:b"])
    design = np.column_stack([x[use], x[use, 0] * x[use, 1]])
    h = hat(design - design.mean(0))
    assert space.n == 19 and np.isclose(space.trace, np.trace(g)) and np.isclose(m.ss_constrained, np.trace(h @ g))
    assert np.allclose(m.eigenvalues, np.linalg.eigvalsh(h @ g @ h)[::-1][:3])
    u = {r["id"]: r["cap1"] for r in O.constraint_scores(m, 1).collect()}
    u = np.array([u[f"s{i:02d}"] for i in use])
    s = {r["id"]: r["cap1"] for r in O.site_scores(m, 1).collect()}
    assert np.allclose([s[f"s{i:02d}"] for i in use], g @ u / m.eigenvalues[0] * np.trace(g) ** 0.25)
    assert square  # the dense helpers are shared


def test_inflation_from_a_gram(spark):
    x = np.random.default_rng(1).normal(size=(40, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double, c double").withColumn("twice", F.col("a") * 2)
    got = O.vif_of(df, [var(c) for c in ("a", "b", "twice", "c")])
    assert got == pytest.approx(dict(zip("abc", np.diag(np.linalg.inv(np.corrcoef(x.T))))))


def test_the_driver_keeps_components_once_they_are_few(spark, monkeypatch):
    """More places than the driver keeps components: only the first rounds merge in Spark."""
    x = np.random.default_rng(4).normal(size=(60, 2))
    merged, rounds = D._merged, []
    monkeypatch.setattr(D, "_merged", lambda picks: (rounds.append(1), merged(picks))[1])
    got = D.spanning_threshold(frame(spark, x), "id", ["x0", "x1"], gathered=59)
    assert got == pytest.approx(bottleneck(x), rel=1e-12) and len(rounds) == 1


def test_tiles_give_the_tree_of_all_pairs(spark, monkeypatch):
    """Many small tiles, few pairs at once: no more ways leave a tile than its forest has, and the tree stays the same."""
    monkeypatch.setattr(D, "TILE", 40)
    monkeypatch.setattr(D, "MET", 50)
    forests, sizes = D._forests, []
    monkeypatch.setattr(D, "_forests", lambda *a: (lambda df: sizes.append(df.count()) or df)(forests(*a)))
    x = np.random.default_rng(6).uniform(-1, 1, (400, 2)) * [1, 3]
    x[:350] /= 10
    assert D.spanning_threshold(frame(spark, x), "id", ["x0", "x1"]) == pytest.approx(bottleneck(x), rel=1e-12)
    assert max(sizes) <= 9 * 399


def test_a_forest_is_the_shortest():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300) + 0
    d, i, j = rng.integers(1, 6, 300).astype(float), np.arange(300), np.arange(300) + 1
    a, b, d, i, j = (v[a != b] for v in (a, b, d, i, j))
    best, nodes, into = D._forest(a, b, d, i, j)
    label, total = dict(zip(nodes, nodes)), 0.0
    for k in np.lexsort((j, i, d)):
        if label[a[k]] != label[b[k]]:
            old, total = label[b[k]], total + d[k]
            label = {n: label[a[k]] if v == old else v for n, v in label.items()}
    assert d[best].sum() == total and len(best) == len(nodes) - len(set(label.values()))
    assert len(set(zip(into, label.values()))) == len(set(into)) == len(set(label.values()))


def test_places_need_no_order_lines(spark, monkeypatch):
    from test_queries import SF

    from tarn.plans import QUERIES
    from tarn.plans.bindings import Views

    views = Views(spark, SF)
    assert views.priced.exceptAll(views.master.select(*views.priced.columns)).isEmpty() and views.priced.count() == views.master.count()
    seen = []
    monkeypatch.setattr(views, "table", lambda name, f=views.table: seen.append(name) or f(name))
    views.__dict__.pop("priced")
    QUERIES["d8_customers_threshold"].on_views(views)
    assert "customer" in seen and "lineitem" not in seen
