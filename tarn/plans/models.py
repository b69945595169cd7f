"""Queries for linear models, tests, clustering and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails
from ..operators import cluster, gram as G, hypothesis as H, linmod as L, order_stats as S, tables as T
from ..session import cut_lineage
from .registry import check, query

# --- closed forms in SQL ------------------------------------------------------------------------

# centred sums of y = price, a = qty, b = balance over the complete cases
SUMS = """SELECT count(*) AS n, avg(price) AS my, avg(qty) AS ma, avg(balance) AS mb, covar_pop(price, price) * count(*) AS yy,
    covar_pop(qty, qty) * count(*) AS aa, covar_pop(balance, balance) * count(*) AS bb, covar_pop(qty, balance) * count(*) AS ab,
    covar_pop(qty, price) * count(*) AS ay, covar_pop(balance, price) * count(*) AS b_y {by} FROM v_full {group}"""
SOLVED = """SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS ba, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS b_b FROM ({sums})"""
RSS = """SELECT *, yy - ba * ay - b_b * b_y AS rss2, yy - ay * ay / aa AS rss_a, yy - b_y * b_y / bb AS rss_b FROM ({solved})"""


def _two(by: str = "") -> str:
    sums = SUMS.format(by=f", {by}" if by else "", group=f"GROUP BY {by}" if by else "")
    return RSS.format(solved=SOLVED.format(sums=sums))


COEFS = """SELECT {by} term, estimate, std_error, estimate / std_error AS t FROM (
    SELECT {by} '(Intercept)' AS term, my - ba * ma - b_b * mb AS estimate,
      sqrt(rss2 / (n - 3) * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / (aa * bb - ab * ab))) AS std_error FROM ({two})
    UNION ALL SELECT {by} 'qty', ba, sqrt(rss2 / (n - 3) * bb / (aa * bb - ab * ab)) FROM ({two})
    UNION ALL SELECT {by} 'balance', b_b, sqrt(rss2 / (n - 3) * aa / (aa * bb - ab * ab)) FROM ({two}))"""

FITTED = f"""SELECT v.*, my - ba * ma - b_b * mb + ba * qty + b_b * balance AS fitted, price - (my - ba * ma - b_b * mb + ba * qty + b_b * balance) AS residual,
    ba, b_b, ma, mb, n FROM v_full v, ({_two()})"""


def _terms():
    return [G.var("qty"), G.var("balance")]


def _fit(v):
    return L.ols(v.master, G.var("price"), _terms())


def _one_row(v, values: dict):
    return v.spark.createDataFrame([tuple(float(x) for x in values.values())], ", ".join(f"{k} double" for k in values))


# --- aggregates for statistics ------------------------------------------------------------------


@query("a15_gram", check(f"""SELECT n, a, b, s FROM (SELECT n, unnest(['price', 'price', 'price', 'qty', 'qty', 'balance']) AS a,
    unnest(['price', 'qty', 'balance', 'qty', 'balance', 'balance']) AS b, unnest([yy, ay, b_y, aa, ab, bb]) AS s FROM ({_two()}))""", "s", "n a b", digits=2), digits=2)
def _(v):
    g = G.gram(v.master, G.columns_of([G.var("price"), *_terms()]))
    rows = [(g.n, a, b, float(g.m[i, j])) for i, a in enumerate(g.names) for j, b in enumerate(g.names) if i <= j]
    return v.spark.createDataFrame(rows, "n long, a string, b string, s double")


@query("a15_gram_by_group", check(f"SELECT segment, n, aa, ab, ay FROM ({_two('segment')})", "aa ab ay", "segment n", digits=3), digits=3)
def _(v):
    rows = G.gram_rows(v.master, G.columns_of([G.var("price"), *_terms()]), ["segment"])
    at = lambda k: F.get("m", F.lit(k))
    return rows.select("segment", "n", at(3).alias("aa"), at(4).alias("ab"), at(1).alias("ay"))


SUMMARY = """SELECT {by}, min(x) AS "min", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3,
    max(x) AS "max", avg(x) AS mean, count(x) AS n FROM {src} GROUP BY {by}"""


@query("a14_summary_by", check(SUMMARY.format(by="nation", src="(SELECT nation, price AS x FROM v_full)"), 'min q1 median q3 max mean', "nation n"))
def _(v):
    full = v.master.filter("price is not null and qty is not null")
    return S.summary_by(full, "price", ["nation"])


@query("w3_avg_rank", check("""SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rank,
    count(*) OVER (PARTITION BY l_extendedprice) AS cnt FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_extendedprice) = 1""", "l_extendedprice rank", "cnt"))
def _(v):
    """Mid-ranks of all line prices, without a sort of the whole table in one task."""
    return S.avg_rank(v.table("lineitem"), "l_extendedprice").select("l_extendedprice", "cnt", "rank")


@query("w4_order_statistics", check("""SELECT l_returnflag, l_quantity, count(*) AS cnt, CAST(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) + 1 AS BIGINT) AS lo,
    CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""", "l_quantity", "l_returnflag cnt lo n"))
def _(v):
    return S.positions(v.table("lineitem"), "l_quantity", ["l_returnflag"])


@query("w7_abs_dev_from_group_median", check("""SELECT k, nation, abs(price - m) AS z FROM v_full JOIN (SELECT nation, quantile_cont(price, 0.5) AS m FROM v_full GROUP BY 1) USING (nation)""", "z", "k nation"))
def _(v):
    full = v.master.filter("price is not null and qty is not null").select("k", "nation", "price")
    return H.abs_dev_from_group_median(full, "price", ["nation"]).select("k", "nation", "z")


# --- models -------------------------------------------------------------------------------------


@query("m1_ols", check(COEFS.format(by="", two=_two()), "estimate std_error t", "term"))
def _(v):
    return _fit(v).coefficients(v.spark).drop("p")


@query("m1_ols_summary", check(f"""SELECT n, n - 3 AS df_residual, 1 - rss2 / yy AS r2, 1 - rss2 / yy * (n - 1) / (n - 3) AS adj_r2, sqrt(rss2 / (n - 3)) AS sigma,
    (yy - rss2) / 2 / (rss2 / (n - 3)) AS f FROM ({_two()})""", "r2 adj_r2 sigma f", "n df_residual"))
def _(v):
    return _fit(v).summary(v.spark).select("n", F.col("df_residual").cast("long").alias("df_residual"), "r2", "adj_r2", "sigma", "f")


@query("m1_ols_with_p")
def _(v):
    """Coefficients with their p-values."""
    return _fit(v).coefficients(v.spark)


@query("m2_terms", check("""SELECT segment, avg(price) AS fitted FROM v_full GROUP BY segment""", "fitted", "segment"))
def _(v):
    """A categorical term: the fitted value of a level is its mean."""
    full = v.master.filter("price is not null and qty is not null")
    m = L.ols(full, G.var("price"), [G.factor(full, "segment")])
    levels = dict(zip(["(Intercept)", *m.fit.names], m.fit.coef))
    base = full.agg(F.min("segment")).first()[0]
    rows = [(base, float(levels["(Intercept)"]))] + [(n[len("segment"):], float(levels["(Intercept)"] + b)) for n, b in levels.items() if n != "(Intercept)"]
    return v.spark.createDataFrame(rows, "segment string, fitted double")


@query("m2_interaction", check("""SELECT segment, regr_slope(price, qty) AS slope, regr_intercept(price, qty) AS intercept FROM v_full GROUP BY 1""", "slope intercept", "segment"))
def _(v):
    """Full crossing of a factor with a covariate gives each level its own line."""
    full = v.master.filter("price is not null and qty is not null")
    seg, qty = G.factor(full, "segment"), G.var("qty")
    m = L.ols(full, G.var("price"), G.full_factorial([qty, seg]))
    c = dict(zip(["(Intercept)", *m.fit.names], map(float, m.fit.coef)))
    base = full.agg(F.min("segment")).first()[0]
    rows = [(base, c["qty"], c["(Intercept)"])]
    rows += [(n[len("segment"):], c["qty"] + c[f"qty:{n}"], c["(Intercept)"] + c[n]) for n in seg.column_names]
    return v.spark.createDataFrame(rows, "segment string, slope double, intercept double")


STEPPED = f"""SELECT terms, aic FROM (SELECT unnest(['', 'qty', 'balance', 'qty+balance']) AS terms, unnest([n * ln(yy / n) + 2, n * ln(rss_a / n) + 4,
    n * ln(rss_b / n) + 4, n * ln(rss2 / n) + 6]) AS aic FROM ({_two()})) ORDER BY aic LIMIT 1"""


@query("m3_step_aic", check(STEPPED, "aic", "terms"))
def _(v):
    model, _path = L.step_aic(_fit(v))
    return v.spark.createDataFrame([("+".join(t.name for t in model.terms), float(model.fit.aic))], "terms string, aic double")


@query("m3_step_path")
def _(v):
    """Steps of a search over three covariates and their interactions."""
    terms = G.full_factorial([G.var("qty"), G.var("balance"), G.var("disc")])
    _model, path = L.step_aic(L.ols(v.master, G.var("price"), terms))
    return v.spark.createDataFrame([(i, *p) for i, p in enumerate(path)], "step int, action string, term string, aic double")


@query("m4_anova_nested", check(f"SELECT 1.0 AS df1, n - 3.0 AS df2, (rss_a - rss2) / (rss2 / (n - 3)) AS f FROM ({_two()})", "df1 df2 f"))
def _(v):
    big = _fit(v)
    a = L.anova_nested(L.refit(big, _terms()[:1]), big)
    return _one_row(v, {k: a[k] for k in ("df1", "df2", "f")})


@query("m5_breusch_pagan", check(f"SELECT count(*) * corr(residual ** 2, fitted) ** 2 AS statistic FROM ({FITTED})", "statistic"))
def _(v):
    return _one_row(v, {"statistic": L.breusch_pagan(_fit(v), v.master)["statistic"]})


POWER = """SELECT x, y, n, x - mx AS c1, (x * x - m2) AS c2 FROM (SELECT qty AS x, price AS y FROM v_full), (SELECT count(*) AS n, avg(qty) AS mx, avg(qty * qty) AS m2 FROM v_full)"""


@query("m6_reset_test", check(f"""SELECT (yy - s1y * s1y / s11 - rss) / (rss / (n - 3)) AS f FROM (SELECT *, yy - (s1y * s1y * s22 - 2 * s1y * s2y * s12 + s2y * s2y * s11) / (s11 * s22 - s12 * s12) AS rss
    FROM (SELECT count(*) AS n, covar_pop(y, y) * count(*) AS yy, covar_pop(c1, c1) * count(*) AS s11, covar_pop(c2, c2) * count(*) AS s22,
    covar_pop(c1, c2) * count(*) AS s12, covar_pop(c1, y) * count(*) AS s1y, covar_pop(c2, y) * count(*) AS s2y FROM ({POWER})))""", "f", digits=5), digits=5)
def _(v):
    """One regressor and its square."""
    full = v.master.filter("price is not null and qty is not null")
    m = L.ols(full, G.var("price"), [G.var("qty")])
    return _one_row(v, {"f": L.reset_test(m, full, powers=(2,))["f"]})


@query("m6_reset_test_two_powers")
def _(v):
    m = _fit(v)
    return _one_row(v, L.reset_test(m, v.master))


@query("m7_shapiro_wilk")
def _(v):
    """W and p of balances per nation; groups of less than three rows give NULL."""
    return H.shapiro_wilk(v.master, "balance", ["nation"])


@query("m7_shapiro_wilk_residuals")
def _(v):
    return H.shapiro_wilk(_fit(v).residuals(v.master, ["nation"]), "residual", ["nation"])


TWO = "(SELECT *, CASE WHEN region = 'ASIA' THEN 'Group_1' ELSE 'Group_2' END AS grp FROM v_master)"
LONG = f"""(SELECT 'price' AS variable, grp, price AS y FROM {TWO} WHERE price IS NOT NULL UNION ALL SELECT 'balance', grp, balance FROM {TWO}
    UNION ALL SELECT 'qty', grp, qty FROM {TWO} WHERE qty IS NOT NULL)"""


def _grouped(v):
    return T.split_by(v.master, F.col("region") == "ASIA", "Group_1", "Group_2", "grp")


def _variables():
    return {n: F.col(n) for n in ("price", "balance", "qty")}


@query("m8_levene", check(f"""SELECT variable, sum(n * (m - g) ** 2) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))) AS "F", CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM (
    SELECT variable, grp, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM (SELECT variable, grp, abs(y - med) AS z FROM {LONG}
      JOIN (SELECT variable, grp, quantile_cont(y, 0.5) AS med FROM {LONG} GROUP BY 1, 2) USING (variable, grp)) GROUP BY 1, 2)
    JOIN (SELECT variable, avg(abs(y - med)) AS g FROM {LONG} JOIN (SELECT variable, grp, quantile_cont(y, 0.5) AS med FROM {LONG} GROUP BY 1, 2)
      USING (variable, grp) GROUP BY 1) USING (variable) GROUP BY variable""", '"F"', "variable df2"))
def _(v):
    return H.levene(_grouped(v), _variables(), "grp").select("variable", "df2", "F")


@query("m9_two_group_test", check(f"""SELECT variable, m1 AS intercept, m2 - m1 AS estimate, (m2 - m1) / sqrt((s1 + s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t,
    n1 + n2 - 2 AS df FROM (SELECT variable, avg(CASE WHEN grp = 'Group_1' THEN y END) AS m1, avg(CASE WHEN grp = 'Group_2' THEN y END) AS m2,
    count(CASE WHEN grp = 'Group_1' THEN y END) AS n1, count(CASE WHEN grp = 'Group_2' THEN y END) AS n2,
    var_pop(CASE WHEN grp = 'Group_1' THEN y END) * count(CASE WHEN grp = 'Group_1' THEN y END) AS s1,
    var_pop(CASE WHEN grp = 'Group_2' THEN y END) * count(CASE WHEN grp = 'Group_2' THEN y END) AS s2 FROM {LONG} GROUP BY 1)""", "intercept estimate t", "variable df"))
def _(v):
    return H.two_group_test(_grouped(v), _variables(), "grp").select("variable", "df", "intercept", "estimate", "t")


@query("m9_two_group_test_with_p")
def _(v):
    return H.two_group_test(_grouped(v), _variables(), "grp")


@query("m10_rank_sum", check("""SELECT sum(CASE WHEN side = 'A' THEN r END) - count(CASE WHEN side = 'A' THEN 1 END) * (count(CASE WHEN side = 'A' THEN 1 END) + 1) / 2.0 AS "W",
    count(CASE WHEN side = 'A' THEN 1 END) AS m, count(CASE WHEN side = 'B' THEN 1 END) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS side,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem)""", '"W"', "m n"))
def _(v):
    two = T.split_by(v.table("lineitem"), F.col("l_returnflag") == "A", "A", "B", "side")
    return H.rank_sum(two, "l_extendedprice", "side").select("W", "m", "n")


@query("m11_corr_matrix", check("""SELECT x, y, r, slope FROM (SELECT unnest(['qty', 'balance', 'qty', 'price', 'balance', 'price']) AS x, unnest(['price', 'price', 'balance', 'qty', 'qty', 'balance']) AS y,
    unnest([corr(price, qty), corr(price, balance), corr(balance, qty), corr(qty, price), corr(qty, balance), corr(balance, price)]) AS r,
    unnest([regr_slope(price, qty), regr_slope(price, balance), regr_slope(balance, qty), regr_slope(qty, price), regr_slope(qty, balance), regr_slope(balance, price)]) AS slope FROM v_full)""", "r slope", "x y"))
def _(v):
    return L.corr_matrix(v.master, [G.var("price"), *_terms()])


@query("m12_glm_log_link")
def _(v):
    """Gaussian model with logarithmic link of price on log quantity."""
    m = L.glm_log_link(v.master.filter("price > 0"), "price", F.ln(F.col("qty") + 1))
    return _one_row(v, {"intercept": m.intercept, "slope": m.coefficients[0], "deviance": m.summary.deviance})


@query("m13_predict", check(f"SELECT k, fitted AS fit FROM ({FITTED})", "fit", "k"))
def _(v):
    full = v.master.filter("price is not null")
    return L.predict(_fit(v), full, ["k"]).select("k", "fit")


@query("m13_predict_band")
def _(v):
    return L.predict(_fit(v), v.master, ["k"])


@query("m14_partial_residuals", check(f"""SELECT k, 'qty' AS term, qty AS x, ba * (qty - ma) + residual AS partial FROM ({FITTED})
    UNION ALL SELECT k, 'balance', balance, b_b * (balance - mb) + residual FROM ({FITTED})""", "x partial", "k term"))
def _(v):
    return L.partial_residuals(_fit(v), v.master, ["k"])


@query("m15_qq_points")
def _(v):
    return L.qq_points(_fit(v).residuals(v.master, ["k"]), "residual")


@query("m15_qq_line", check(f"""SELECT (q3 - q1) / (2 * 0.6744897501960817) AS slope, q1 + (q3 - q1) / 2 AS intercept FROM (SELECT quantile_cont(residual, 0.25) AS q1,
    quantile_cont(residual, 0.75) AS q3 FROM ({FITTED}))""", "slope intercept"))
def _(v):
    return _one_row(v, L.qq_line(_fit(v).residuals(v.master, ["k"]), "residual"))


@query("m16_histogram", check("""SELECT CAST(least(floor((x - lo) / w), 19) AS INTEGER) AS bin, count(*) AS "count", any_value(lo + least(floor((x - lo) / w), 19) * w) AS "left",
    count(*) / (any_value(n) * any_value(w)) AS density FROM (SELECT l_extendedprice / 997 AS x FROM lineitem),
    (SELECT min(l_extendedprice / 997) AS lo, (max(l_extendedprice / 997) - min(l_extendedprice / 997)) / 20 AS w, count(*) AS n FROM lineitem) GROUP BY 1""", '"left" density', 'bin "count"'))
def _(v):
    return T.histogram(v.table("lineitem").select((F.col("l_extendedprice") / 997).alias("x")), "x", 20).drop("right")


@query("m17_kmeans")
def _(v):
    """Cluster sizes and centres for two and three clusters, labelled by rising first centre."""
    full = cut_lineage(v.master.filter("price is not null and qty is not null").select("k", "price", "qty"))
    out = None
    for k in (2, 3):
        part = cluster.kmeans(full, ["price", "qty"], k, order_by="price").groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"), F.avg("qty").alias("qty")).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@query("m17_model_per_cluster")
def _(v):
    """Stepwise model of every cluster, from one pass over the clustered rows."""
    full = v.master.filter("price is not null and qty is not null")
    parts = cluster.kmeans(full, ["balance", "qty"], 3, order_by="qty")
    return L.model_per_group(parts, G.var("price"), [*_terms(), G.var("disc")], ["cluster"], stepwise=True)


@query("m18_pca", check("SELECT component, eigenvalue, eigenvalue / 2 AS share FROM (SELECT unnest([1, 2]) AS component, unnest([1 + abs(corr(price, qty)), 1 - abs(corr(price, qty))]) AS eigenvalue FROM v_full)", "eigenvalue share", "component"))
def _(v):
    return cluster.pca(v.master.filter("qty is not null"), ["price", "qty"]).table(v.spark)


@query("m18_pca_scores", check("""SELECT k, (zp + zq) / sqrt(2) AS pc1 FROM (SELECT k, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS zp,
    (qty - avg(qty) OVER ()) / stddev_samp(qty) OVER () * sign(corr(price, qty) OVER ()) AS zq FROM v_full)""", "pc1", "k"))
def _(v):
    full = v.master.filter("qty is not null")
    return cluster.pca(full, ["price", "qty"]).scores(full, ["k"], 1)


@query("m18_pca_six_variables")
def _(v):
    full = v.master.withColumns({"price2": F.sqrt("price"), "ln_qty": F.log1p("qty")})
    return cluster.pca(full, ["balance", "price", "qty", "disc", "price2", "ln_qty"]).loading_table(v.spark)


@query("m19_model_per_group", check(COEFS.format(by="segment,", two=_two("segment")), "estimate std_error t", "segment term"))
def _(v):
    out = L.model_per_group(v.master, G.var("price"), _terms(), ["segment"])
    return out.select("segment", "term", "estimate", "std_error", "t")


@query("m19_breusch_pagan_per_group", check(f"""SELECT segment, count(*) * corr(e * e, fitted) ** 2 AS statistic FROM (SELECT v.segment, my - ba * ma - b_b * mb + ba * qty + b_b * balance AS fitted,
    price - (my - ba * ma - b_b * mb + ba * qty + b_b * balance) AS e FROM v_full v JOIN ({_two('segment')}) c ON v.segment = c.segment) GROUP BY 1""", "statistic", "segment"))
def _(v):
    coefs = L.model_per_group(v.master, G.var("price"), _terms(), ["segment"])
    res = L.group_residuals(v.master, G.var("price"), _terms(), ["segment"], coefs)
    return L.breusch_pagan_by(res, ["segment"]).drop("p")


# nested models and RESET per group, from the same sums (tails of F are checked against the regularised beta function by pytest)
@query("m19_anova_per_group", check(f"SELECT segment, 1.0 AS df1, n - 3.0 AS df2, (rss_a - rss2) / (rss2 / (n - 3)) AS f FROM ({_two('segment')})", "df1 df2 f", "segment"))
def _(v):
    out = L.anova_nested_by(v.master, G.var("price"), _terms()[:1], _terms(), ["segment"])
    return out.select("segment", F.col("df1").cast("double").alias("df1"), F.col("df2").cast("double").alias("df2"), "f")


# residual sums of price on qty, then on qty and its square: the square's part that qty leaves over is a regressor of its own
RESET_BY = """SELECT segment, 1.0 AS df1, n - 3.0 AS df2, (yy - ay * ay / aa - rss) / (rss / (n - 3)) AS f FROM (SELECT *,
    yy - ay * ay / aa - (qy - aq * ay / aa) ** 2 / (qq - aq * aq / aa) AS rss FROM (SELECT segment, count(*) AS n, covar_pop(qty, qty) * count(*) AS aa,
    covar_pop(price, price) * count(*) AS yy, covar_pop(qty, price) * count(*) AS ay, covar_pop(q2, q2) * count(*) AS qq,
    covar_pop(qty, q2) * count(*) AS aq, covar_pop(q2, price) * count(*) AS qy FROM (SELECT *, qty * qty AS q2 FROM v_full) GROUP BY segment))"""


@query("m19_reset_per_group", check(RESET_BY, "df1 df2 f", "segment", digits=5), digits=5)
def _(v):
    out = L.reset_test_by(v.master, G.var("price"), _terms()[:1], ["segment"], powers=(2,))
    return out.select("segment", F.col("df1").cast("double").alias("df1"), F.col("df2").cast("double").alias("df2"), "f")


@query("m19_qq_per_group", check("""SELECT segment, sample, cnt, (mean_rank - a) / (n + 1 - 2 * a) AS position FROM (SELECT segment, residual AS sample, count(*) AS cnt, any_value(n) AS n,
    avg(r) AS mean_rank, CASE WHEN any_value(n) <= 10 THEN 0.375 ELSE 0.5 END AS a FROM (SELECT segment, price AS residual, row_number() OVER (PARTITION BY segment ORDER BY price) AS r,
    count(*) OVER (PARTITION BY segment) AS n FROM v_full) GROUP BY segment, residual)""", "sample position", "segment cnt"))
def _(v):
    """The positions that the points' quantiles stand for: the normal distribution function of each quantile."""
    full = v.master.filter("price is not null and qty is not null").select("segment", "price")
    points = L.qq_points(full, "price", ["segment"])
    return points.select("segment", "sample", "cnt", (1 - tails.p_column("normal", "theoretical")).alias("position"))
