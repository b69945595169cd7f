import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import tails
from tarn.operators import cluster, hypothesis as H, linmod as L, order_stats as S, tables as T
from tarn.operators import gram as G

RNG = np.random.default_rng(11)
N = 60
X = RNG.normal(size=(N, 3))
Y = 1 + 2 * X[:, 0] - 0.5 * X[:, 1] + RNG.normal(size=N) * 0.7
GROUP = np.array(["a", "b", "c"])[np.arange(N) % 3]
COLS = "k int, y double, x1 double, x2 double, x3 double, g string"


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, float(Y[i]), *map(float, X[i]), str(GROUP[i])) for i in range(N)]
    return spark.createDataFrame(rows, COLS).cache()


def dense_fit(y, x):
    d = np.column_stack([np.ones(len(y)), x])
    b, *_ = np.linalg.lstsq(d, y, rcond=None)
    rss = ((y - d @ b) ** 2).sum()
    cov = np.linalg.inv(d.T @ d) * rss / (len(y) - d.shape[1])
    return b, np.sqrt(np.diag(cov)), rss


@pytest.fixture(scope="module", autouse=True)
def terms(spark):
    global TERMS
    TERMS = [G.var("x1"), G.var("x2"), G.var("x3")]


def test_tails_against_published_values():
    assert math.isclose(tails.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(tails.f_upper(4.964602744, 1, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(tails.chi2_upper(3.841458821, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(tails.chi2_upper(18.30703805, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(tails.normal_upper(1.959963985), 0.025, rel_tol=1e-7)
    assert math.isclose(tails.t_quantile(0.975, 10), 2.228138852, rel_tol=1e-8)


def test_normal_quantile_column(spark):
    ps = [1e-12, 1e-4, 0.025, 0.3, 0.5, 0.9, 0.975, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(tails.normal_quantile("p")).collect()]
    assert all(math.isclose(tails.normal_upper(-z), p, rel_tol=1e-9) for z, p in zip(got, ps))


def test_ols_summary(df, spark):
    m = L.ols(df, G.var("y"), TERMS)
    b, se, rss = dense_fit(Y, X)
    rows = m.coefficients(spark).collect()
    assert np.allclose([r["estimate"] for r in rows], b) and np.allclose([r["std_error"] for r in rows], se)
    s = m.summary(spark).first()
    r2 = 1 - rss / ((Y - Y.mean()) ** 2).sum()
    assert np.isclose(s["rss"], rss) and np.isclose(s["r2"], r2) and s["df_residual"] == 56
    assert np.isclose(s["f"], r2 / 3 / ((1 - r2) / 56)) and s["p"] < 1e-6
    assert np.isclose(s["aic"], N * np.log(rss / N) + 8)


def test_exact_line_and_alias(spark):
    d = spark.createDataFrame([(float(i), 1 + 2.0 * i, 3.0 * i) for i in range(6)], "x double, y double, x2 double")
    m = L.ols(d, G.var("y"), [G.var("x"), G.var("x2")])
    assert np.allclose(m.fit.coef, [1, 2]) and m.fit.aliased == ["x2"]


def test_missing_rows_are_dropped_and_infinite_ones_refused(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.0), (None, 9.0), (4.0, float("nan"))], "x double, y double")
    assert L.ols(d, G.var("y"), [G.var("x")]).fit.n == 3
    with pytest.raises(ValueError):
        L.ols(d.union(spark.createDataFrame([(1.0, float("-inf"))], "x double, y double")), G.var("y"), [G.var("x")])


def test_wide_gram_equals_narrow(df, monkeypatch):
    cols = {"y": F.col("y"), "x1": F.col("x1"), "x2": F.col("x2"), "x3": F.col("x3")}
    one = G.gram(df, cols)
    monkeypatch.setattr(G, "WIDE", 2)
    two = G.gram(df, cols)
    assert two.n == N and np.allclose(one.m, two.m) and np.allclose(one.mean, two.mean)
    by = {r["g"]: r for r in G.gram_rows(df, cols, ["g"]).collect()}
    for k in "abc":
        sub = np.column_stack([Y, X])[GROUP == k]
        want = np.cov(sub.T) * (len(sub) - 1)
        assert np.allclose(G.unpack(list(cols), by[k]["n"], by[k]["mean"], by[k]["m"]).m, want)


def test_factor_and_interaction_terms(df):
    g = G.factor(df, "g")
    m = L.ols(df, G.var("y"), [G.var("x1"), g, G.interact(G.var("x1"), g)])
    d = np.column_stack([X[:, 0], GROUP == "b", GROUP == "c", X[:, 0] * (GROUP == "b"), X[:, 0] * (GROUP == "c")])
    b, _, rss = dense_fit(Y, d)
    assert np.allclose(m.fit.coef, b) and np.isclose(m.fit.rss, rss)
    assert m.fit.names == ["x1", "gb", "gc", "x1:gb", "x1:gc"]


def aic(cols):
    rss = dense_fit(Y, X[:, cols])[2] if cols else ((Y - Y.mean()) ** 2).sum()
    return N * np.log(rss / N) + 2 * (len(cols) + 1)


def test_step_aic(df):
    chosen, path = L.step_aic(L.ols(df, G.var("y"), TERMS))
    best = min((aic([i for i in range(3) if k >> i & 1]), k) for k in range(8))
    assert np.isclose(chosen.fit.aic, best[0]) and path[0][0] == "start"
    assert all(a[2] > b[2] for a, b in zip(path, path[1:]))


def test_step_keeps_marginality(df):
    inter = G.interact(TERMS[0], TERMS[1])
    m = L.ols(df, G.var("y"), [*TERMS, inter])
    assert not L._droppable(TERMS[0], m.terms) and L._droppable(TERMS[2], m.terms)
    chosen, _ = L.step_aic(m)
    names = {t.name for t in chosen.terms}
    assert "x1:x2" not in names or {"x1", "x2"} <= names


def test_anova_and_reset(df):
    big = L.ols(df, G.var("y"), TERMS)
    small = L.refit(big, TERMS[:1])
    a = L.anova_nested(small, big)
    r1, r0 = dense_fit(Y, X)[2], dense_fit(Y, X[:, :1])[2]
    assert np.isclose(a["f"], (r0 - r1) / 2 / (r1 / 56)) and 0 <= a["p"] <= 1
    with pytest.raises(ValueError):
        L.anova_nested(small, L.refit(big, TERMS[1:2]))
    t = L.reset_test(small, df)
    r2 = dense_fit(Y, np.column_stack([X[:, 0], X[:, 0] ** 2, X[:, 0] ** 3]))[2]
    assert np.isclose(t["f"], (r0 - r2) / 2 / (r2 / 56))


def test_breusch_pagan(df):
    m = L.ols(df, G.var("y"), TERMS)
    d = np.column_stack([np.ones(N), X])
    fit = d @ m.fit.coef
    e2 = (Y - fit) ** 2
    got = L.breusch_pagan(m, df)
    assert np.isclose(got["statistic"], N * np.corrcoef(e2, fit)[0, 1] ** 2)


def test_shapiro_wilk(spark, df):
    # published example values of the test: 11 weights of men, W = 0.79, p = 0.0067 (Shapiro and Wilk 1965)
    men = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]
    r = H.shapiro_wilk(spark.createDataFrame([(v,) for v in men], "v double"), "v").first()
    assert abs(r["W"] - 0.79) < 0.005 and abs(r["p"] - 0.0067) < 0.0005
    by = H.shapiro_wilk(df, "y", ["g"]).collect()
    assert len(by) == 3 and all(r["n"] == 20 and 0.8 < r["W"] <= 1 for r in by)
    three = H.shapiro_wilk(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v").first()
    assert np.isclose(three["W"], 1) and np.isclose(three["p"], 1)
    with pytest.raises(ValueError):
        H.shapiro_wilk(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v")


@pytest.fixture(scope="module")
def two(spark):
    rows = [(float(v), "p") for v in (1, 2, 3, 4)] + [(float(v), "q") for v in (3, 4, 5, 6)]
    return spark.createDataFrame(rows, "v double, g string")


def test_two_groups_by_hand(two):
    t = H.two_group_test(two, {"v": F.col("v")}, "g").first()
    assert t["estimate"] == 2 and np.isclose(t["t"], 2 / math.sqrt(5 / 3 / 2)) and t["df"] == 6
    assert np.isclose(t["p"], tails.t_two_sided(t["t"], 6))
    lev = H.levene(two, {"v": F.col("v")}, "g").first()
    assert lev["F"] == 0 and lev["p"] == 1
    r = H.rank_sum(two, "v", "g").first()
    # ranks of p: 1, 2, 3.5, 5.5 -> W = 12 - 10
    assert r["W"] == 2 and r["method"] == "normal"
    sd = math.sqrt(16 / 12 * (9 - 12 / 56))
    assert np.isclose(r["p"], 2 * tails.normal_upper((8 - 2 - 0.5) / sd))


def test_rank_sum_exact(spark):
    rows = [(1.0, "p"), (2.0, "p"), (4.0, "p"), (3.0, "q"), (5.0, "q"), (6.0, "q"), (7.0, "q")]
    r = H.rank_sum(spark.createDataFrame(rows, "v double, g string"), "v", "g").first()
    # W = 1; of 35 subsets two have W <= 1
    assert r["method"] == "exact" and r["W"] == 1 and np.isclose(r["p"], 4 / 35)


def test_levene_dense(df):
    got = {r["variable"]: r for r in H.levene(df, {"y": F.col("y"), "x1": F.col("x1")}, "g").collect()}
    z = np.abs(Y - np.array([np.median(Y[GROUP == k]) for k in GROUP]))
    means = np.array([z[GROUP == k].mean() for k in "abc"])
    f = 20 * ((means - z.mean()) ** 2).sum() / 2 / (sum(((z[GROUP == k] - m) ** 2).sum() for k, m in zip("abc", means)) / 57)
    assert np.isclose(got["y"]["F"], f) and set(got) == {"y", "x1"}


def test_order_statistics_against_numpy(df, monkeypatch):
    for size in (100_000, 7):
        monkeypatch.setattr(S, "VALUES_PER_BUCKET", size)
        rounded = df.withColumn("v", F.round("x1", 1))
        rows = S.summary_by(rounded, "v", ["g"]).collect()
        for r in rows:
            v = np.round(X[GROUP == r["g"], 0], 1)
            assert np.allclose([r["min"], r["q1"], r["median"], r["q3"], r["max"]], np.quantile(v, [0, 0.25, 0.5, 0.75, 1]))
            assert np.isclose(r["mean"], v.mean())
        v = np.round(X[:, 0], 1)
        for r in S.avg_rank(rounded, "v").collect():
            assert r["rank"] == (v < r["v"]).sum() + ((v == r["v"]).sum() + 1) / 2


def test_corr_predict_partial_qq_histogram(df, spark):
    c = {(r["x"], r["y"]): r for r in L.corr_matrix(df, [G.var("y"), *TERMS]).collect()}
    assert np.isclose(c[("x1", "y")]["r"], np.corrcoef(X[:, 0], Y)[0, 1]) and len(c) == 12
    m = L.ols(df, G.var("y"), TERMS[:1])
    b, _, rss = dense_fit(Y, X[:, :1])
    p = {r["k"]: r for r in L.predict(m, df, ["k"]).collect()}
    xm = X[:, 0] - X[:, 0].mean()
    half = tails.t_quantile(0.975, 58) * np.sqrt(rss / 58 * (1 / N + xm**2 / (xm**2).sum()))
    assert np.allclose([p[i]["upper"] - p[i]["fit"] for i in range(N)], half)
    part = L.partial_residuals(L.ols(df, G.var("y"), TERMS), df, ["k"]).collect()
    assert len(part) == 3 * N
    sub = [r for r in part if r["term"] == "x1"]
    assert np.isclose(np.polyfit([r["x"] for r in sub], [r["partial"] for r in sub], 1)[0], dense_fit(Y, X)[0][1])
    qq = L.qq_points(df, "y").orderBy("sample").collect()
    assert len(qq) == N and np.isclose(qq[0]["theoretical"], -qq[-1]["theoretical"])
    line = L.qq_line(df, "y")
    assert np.isclose(line["slope"], np.subtract(*np.quantile(Y, [0.75, 0.25])) / 1.3489795)
    h = T.histogram(df, "y", 7).orderBy("bin").collect()
    want, edges = np.histogram(Y, 7)
    got = np.zeros(7)
    for r in h:
        got[r["bin"]] = r["count"]
    assert (got == want).all() and np.isclose(sum(r["density"] * (r["right"] - r["left"]) for r in h), 1)


def test_models_per_group(df, spark):
    rows = L.model_per_group(df, G.var("y"), TERMS[:2], ["g"]).collect()
    for k in "abc":
        b, se, rss = dense_fit(Y[GROUP == k], X[GROUP == k][:, :2])
        mine = {r["term"]: r for r in rows if r["g"] == k}
        assert np.allclose([mine[t]["estimate"] for t in ("(Intercept)", "x1", "x2")], b)
        assert np.isclose(mine["x1"]["rss"], rss) and np.isclose(mine["x1"]["std_error"], se[1])
    coefs = L.model_per_group(df, G.var("y"), TERMS, ["g"], stepwise=True)
    res = L.group_residuals(df, G.var("y"), TERMS, ["g"], coefs)
    sums = {r["g"]: r["s"] for r in res.groupBy("g").agg(F.sum("residual").alias("s")).collect()}
    assert all(abs(v) < 1e-9 for v in sums.values())
    assert L.breusch_pagan_by(res, ["g"]).count() == 3


def test_nested_f_reset_and_qq_per_group(df, spark):
    rows = df.select("k", "y", "x1", "x2", "x3", "g").collect()
    rows = [tuple(r) for r in rows] + [(r[0], *r[1:5], None) for r in rows if r[5] == "a"]
    rows += [(900 + i, float(i), 1.0 + i, float("inf"), 2.0, "inf") for i in range(9)] + [(950 + i, float(i), 1.0, 2.0, 3.0 * i, "few") for i in range(2)]
    # x2 repeats x1 in this group
    rows += [(970 + i, float(Y[i]), float(X[i, 0]), float(X[i, 0]), float(X[i, 2]), "same") for i in range(20)]
    data = spark.createDataFrame(rows, COLS)
    nested = {r["g"]: r for r in L.anova_nested_by(data, G.var("y"), TERMS[:1], TERMS, ["g"]).collect()}
    reset = {r["g"]: r for r in L.reset_test_by(data, G.var("y"), TERMS, ["g"]).collect()}
    assert set(nested) == set(reset) == {"a", "b", "c", None, "inf", "few", "same"}
    for k in ("a", "b", "c", "same"):
        own = data.filter(F.col("g") == k)
        big = L.ols(own, G.var("y"), TERMS)
        for mine, single in ((nested[k], L.anova_nested(L.refit(big, TERMS[:1]), big)), (reset[k], L.reset_test(big, own))):
            assert all(mine[c] == pytest.approx(single[c], rel=1e-7) for c in ("df1", "df2", "f", "p"))
    x = X[GROUP == "a"]
    small, large = dense_fit(Y[GROUP == "a"], x)[2], dense_fit(Y[GROUP == "a"], np.column_stack([x, x ** 2, x ** 3]))[2]
    assert reset["a"]["f"] == pytest.approx((small - large) / 6 / (large / (20 - 10)))
    assert nested[None]["f"] == pytest.approx(nested["a"]["f"]) and nested["same"]["df1"] == 1
    assert all(t[k][c] is None for t in (nested, reset) for k in ("inf", "few") for c in ("df1", "df2", "f", "p"))
    with pytest.raises(ValueError):
        L.anova_nested_by(data, G.var("y"), TERMS[:2], TERMS[1:], ["g"])
    points = sorted((r["sample"], r["theoretical"]) for r in L.qq_points(data, "y", ["g"]).filter("g = 'b'").collect())
    assert points == sorted((r["sample"], r["theoretical"]) for r in L.qq_points(data.filter("g = 'b'"), "y").collect())


def test_glm_score_equations(spark):
    x = np.linspace(0.5, 4, 40)
    y = np.exp(0.3 + 0.8 * np.log(x)) + RNG.normal(size=40) * 0.05
    d = spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y double, x double")
    m = L.glm_log_link(d, "y", F.ln("x"))
    mu = np.exp(m.intercept + m.coefficients[0] * np.log(x))
    assert abs(((y - mu) * mu).sum()) < 1e-4 and abs(((y - mu) * mu * np.log(x)).sum()) < 1e-4


def test_kmeans_works_its_input_out_once(spark):
    """What is behind the rows, such as joins, is not repeated for the search and the labels."""
    worked = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            worked.add(len(b))
            yield b

    rows = spark.range(60).selectExpr("cast(id % 3 * 100 + id % 7 as double) AS s").repartition(1).mapInPandas(mark, "s double").repartition(2)
    sizes = cluster.kmeans(rows, ["s"], 3).groupBy("cluster").count().collect()
    assert sorted((r[0], r[1]) for r in sizes) == [(1, 20), (2, 20), (3, 20)]
    assert worked.value == 60


def test_kmeans_and_pca(spark, df):
    rows = [(float(i % 2 * 10 + i * 0.01), float(i)) for i in range(20)]
    k = cluster.kmeans(spark.createDataFrame(rows, "s double, r double").select("s", (F.col("r") * 0).alias("r")), ["s", "r"], 2)
    got = {(r["cluster"], r["s"] > 5) for r in k.collect()}
    assert got == {(1, False), (2, True)}
    p = cluster.pca(df, ["y", "x1", "x2", "x3"])
    m = np.column_stack([Y, X])
    val = np.linalg.eigvalsh(np.corrcoef(m.T))[::-1]
    assert np.allclose(p.eigenvalues, val) and np.isclose(p.share.sum(), 1)
    sc = p.scores(df, ["k"], 2).collect()
    assert np.isclose(np.var([r["pc1"] for r in sc], ddof=1), val[0])


def test_step_limits_raise(df):
    with pytest.raises(RuntimeError):
        L.step_aic(refit_to_none(df), scope=TERMS, limit=0)


def refit_to_none(df):
    return L.refit(L.ols(df, G.var("y"), TERMS), [])


def test_models_keep_null_and_infinite_groups(spark):
    rows = [(None, float(i), 2.0 * i + i % 3) for i in range(8)] + [("b", float(i), 1.0 - i + i % 2) for i in range(8)]
    rows += [("c", 1.0, 2.0), ("c", 2.0, float("inf")), ("c", 3.0, 1.0)]
    data = spark.createDataFrame(rows, "`a b` string, x double, y double")
    fits = L.model_per_group(data, G.var("y"), [G.var("x")], ["a b"])
    got = {(r["a b"], r.term): r.estimate for r in fits.collect()}
    assert {k for k, _ in got} == {None, "b", "c"}
    assert got[("c", "x")] is None and got[(None, "x")] == pytest.approx(np.polyfit(range(8), [2.0 * i + i % 3 for i in range(8)], 1)[0])
    left = L.group_residuals(data, G.var("y"), [G.var("x")], ["a b"], fits)
    assert {r["a b"]: r["count"] for r in left.filter("residual IS NOT NULL").groupBy("a b").count().collect()} == {None: 8, "b": 8}
    assert left.count() == 19


def test_shapiro_wilk_of_any_size_and_of_the_null_group(spark):
    values = [0.3, 1.2, 1.9, 2.2, 2.8, 3.9, 5.1, 9.0]
    data = spark.createDataFrame([(k, v) for k in (None, "a") for v in values] + [("few", 1.0)], "g string, v double")
    by = {r.g: r for r in H.shapiro_wilk(data, "v", ["g"]).collect()}
    assert by[None].W == pytest.approx(by["a"].W) and by["few"].W is None
    # 30,000 values in four heaps: more ranks of one value than are made at a time
    many = spark.range(30_000).selectExpr("cast(CASE WHEN id < 15000 THEN 0 ELSE id % 4 END AS double) AS v")
    r = H.shapiro_wilk(many, "v").first()
    x = np.sort([0.0 if i < 15_000 else float(i % 4) for i in range(30_000)])
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (30_000.25)) for i in range(1, 30_001)])
    # at this size the weights are the normal scores themselves but for the ends
    rough = (m @ x) ** 2 / (m @ m) / ((x - x.mean()) ** 2).sum()
    assert r.n == 30_000 and not r.p_in_range and r.W == pytest.approx(rough, abs=2e-3)


def test_infinite_values_in_quantiles_and_histograms(spark):
    inf = float("inf")
    data = spark.createDataFrame([(v,) for v in (-inf, 1.0, 2.0, inf)], "v double")
    r = S.summary_by(data, "v").first()
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"]) == (-inf, -inf, 1.5, inf, inf)
    with pytest.raises(ValueError):
        T.histogram(data, "v", 3)
