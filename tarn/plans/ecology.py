"""Queries for community tables, diversity, distances and ordinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import distance as D
from ..operators import ordination as O
from ..operators import permute as P
from ..operators.gram import full_factorial, var
from ..operators.tables import freq_table
from ..operators.tree import interval_proportions, tree_closure, tree_intervals
from .power import leading
from .registry import check, query

CELLS = 'feature_id sample_id "count"'


# --- sums ---------------------------------------------------------------------------------------


@query("a3_sum_by_feature", check('SELECT feature_id, sum("count") AS total FROM v_counts GROUP BY 1', "total", "feature_id"))
def _(v):
    return C.sum_by_feature(v.counts)


@query("a3_sum_by_sample", check('SELECT sample_id, sum("count") AS total FROM v_counts GROUP BY 1', "total", "sample_id"))
def _(v):
    return C.sum_by_sample(v.counts)


PREVALENCE = """SELECT feature_id, count(*) AS "Prevalence", sum("count") AS "TotalAbundance" FROM v_counts GROUP BY 1"""


@query("a4_prevalence", check(f'SELECT p.*, "Phylum", "Class", "Genus" FROM ({PREVALENCE}) p LEFT JOIN v_tax USING (feature_id)', "TotalAbundance", 'feature_id "Prevalence" "Phylum" "Class" "Genus"'))
def _(v):
    return C.prevalence(v.stored_counts, v.tax)


@query("a5_sum_by_group", check("""SELECT "Phylum", sum("count") AS total FROM v_counts JOIN v_tax USING (feature_id) WHERE "Phylum" IS NOT NULL GROUP BY 1""", "total", '"Phylum"'))
def _(v):
    return C.sum_by_group(v.counts, v.tax, "Phylum")


@query("a6_prevalence_by_phylum", check(f"""SELECT "Phylum", avg("Prevalence") AS mean_prevalence, CAST(sum("Prevalence") AS BIGINT) AS sum_prevalence
    FROM ({PREVALENCE}) LEFT JOIN v_tax USING (feature_id) GROUP BY 1""", "mean_prevalence", '"Phylum" sum_prevalence'))
def _(v):
    return C.prevalence_by(C.prevalence(v.stored_counts, v.tax))


@query("a7_freq_table", check('SELECT "Phylum", count(*) AS n FROM v_tax GROUP BY 1', "", '"Phylum" n'))
def _(v):
    return freq_table(v.tax, "Phylum")


@query("a8_distinct", check('SELECT DISTINCT "Genus" FROM v_tax', "", '"Genus"'))
def _(v):
    return v.tax.select("Genus").distinct()


@query("a8_count_distinct", check('SELECT count(DISTINCT "Genus") AS genera, count(DISTINCT "Class") AS classes FROM v_tax', "", "genera classes"))
def _(v):
    return v.tax.agg(F.count_distinct("Genus").alias("genera"), F.count_distinct("Class").alias("classes"))


LINEAGE = 't."Phylum" IS NOT DISTINCT FROM h."Phylum" AND t."Class" = h."Class" AND t."Genus" = h."Genus"'


@query("a9_agglomerate", check(f"""SELECT h.feature_id, c.sample_id, sum(c."count") AS "count" FROM v_counts c JOIN v_tax t ON c.feature_id = t.feature_id
    JOIN (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY "Phylum", "Class", "Genus" ORDER BY total DESC, feature_id) AS r FROM v_tax x
      JOIN (SELECT feature_id, sum("count") AS total FROM v_counts GROUP BY 1) USING (feature_id) WHERE "Genus" IS NOT NULL) WHERE r = 1) h ON {LINEAGE}
    GROUP BY 1, 2""", "", CELLS))
def _(v):
    return C.agglomerate(v.community, "Genus").counts


@query("a10_abundance_by", check("""SELECT region, "Class", sum("count") AS abundance FROM v_counts LEFT JOIN v_tax USING (feature_id) LEFT JOIN v_env USING (sample_id) GROUP BY 1, 2""", "abundance", 'region "Class"'))
def _(v):
    return C.abundance_by(v.counts, v.tax, "Class", v.env, "region")


RICH_SUMS = """SELECT sample_id, CAST(count(*) AS DOUBLE) AS s, sum(x) AS n, sum(x * ln(x)) AS xlx, sum(x * x) AS xx, CAST(count(CASE WHEN x = 1 THEN 1 END) AS DOUBLE) AS f1,
    CAST(count(CASE WHEN x = 2 THEN 1 END) AS DOUBLE) AS f2, CAST(count(CASE WHEN x <= 10 THEN 1 END) AS DOUBLE) AS sr, coalesce(sum(CASE WHEN x <= 10 THEN x END), 0) AS nr,
    coalesce(sum(CASE WHEN x <= 10 THEN x * (x - 1) END), 0) AS ii FROM (SELECT sample_id, "count" AS x FROM v_counts) GROUP BY 1"""


@query("a11_richness", check(f"""SELECT sample_id, s AS "Observed", s + f1 * (f1 - 1) / (2 * (f2 + 1)) AS "Chao1",
    s - sr + sr / (1 - f1 / nr) + f1 / (1 - f1 / nr) * greatest(sr / (1 - f1 / nr) * ii / (nr * (nr - 1)) - 1, 0) AS "ACE",
    ln(n) - xlx / n AS "Shannon", 1 - xx / (n * n) AS "Simpson", n * n / xx AS "InvSimpson" FROM ({RICH_SUMS})""", "Observed Chao1 ACE Shannon Simpson InvSimpson", "sample_id"))
def _(v):
    return C.richness(v.counts, ["Observed", "Chao1", "ACE", "Shannon", "Simpson", "InvSimpson"])


@query("a11_fisher_alpha")
def _(v):
    return C.richness(v.counts, ["Observed", "Fisher"])


@query("w1_relative_abundance", check('SELECT feature_id, sample_id, 100 * "count" / sum("count") OVER (PARTITION BY sample_id) AS "count" FROM v_counts', '"count"', "feature_id sample_id"))
def _(v):
    return C.relative_abundance(v.stored_counts, 100)


@query("w2_rank_in_sample", check("""SELECT feature_id, sample_id, "count", rank() OVER (PARTITION BY sample_id ORDER BY "count" DESC) AS rank FROM v_counts""", "", CELLS + " rank"))
def _(v):
    return C.rank_in_sample(v.stored_counts)


@query("w5_standardize", check("SELECT k, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS price, (balance - avg(balance) OVER ()) / stddev_samp(balance) OVER () AS balance FROM v_master", "price balance", "k"))
def _(v):
    return O.standardize(v.master.select("k", "price", "balance"), ["price", "balance"])


BOTH = "(SELECT i, j, d FROM {d} UNION ALL SELECT j, i, d FROM {d} UNION ALL SELECT sample_id, sample_id, 0 FROM v_env)"
CENTRED = """SELECT i, j, a - avg(a) OVER (PARTITION BY i) - avg(a) OVER (PARTITION BY j) + avg(a) OVER () AS g FROM (SELECT i, j, {a} AS a FROM {both})"""


def _gower(view: str, root: bool = False) -> str:
    return CENTRED.format(a="-0.5 * d" if root else "-0.5 * d * d", both=BOTH.format(d=view))


@query("w6_double_center", check(_gower("v_euclid"), "g", "i j"))
def _(v):
    return O.double_center(_euclid(v))


# --- distances ----------------------------------------------------------------------------------


def _euclid(v):
    return D.euclidean(v.xy, "sample_id", ["lat", "lon"])


@query("d1_euclidean", check("SELECT * FROM v_euclid", "d", "i j"))
def _(v):
    return _euclid(v)


@query("d2_distance_of_distances", check(f"""SELECT a.i AS i, b.i AS j, sqrt(sum((a.d - b.d) ** 2)) AS d FROM {BOTH.format(d='v_wuf')} a JOIN {BOTH.format(d='v_wuf')} b
    ON a.j = b.j AND a.i < b.i GROUP BY 1, 2""", "d", "i j"))
def _(v):
    return D.distance_of_distances(v.wunifrac)


@query("d3_bray_curtis", check("""SELECT n.i, n.j, 1 - 2 * s / (a.t + b.t) AS d FROM (SELECT a.sample_id AS i, b.sample_id AS j, sum(least(ln(1 + a."count"), ln(1 + b."count"))) AS s
    FROM v_counts a JOIN v_counts b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2) n
    JOIN (SELECT sample_id, sum(ln(1 + "count")) AS t FROM v_counts GROUP BY 1) a ON a.sample_id = n.i
    JOIN (SELECT sample_id, sum(ln(1 + "count")) AS t FROM v_counts GROUP BY 1) b ON b.sample_id = n.j""", "d", "i j"))
def _(v):
    return D.bray_curtis(C.log_transform_counts(v.counts))


# customers with their near partners' number and the smallest customer that such links lead to; near is by the overlap of the cells of
# two customers, and the totals are over all of a customer's cells; a distance a billionth above the limit is at it, as sums are added in any order
NEAR = """WITH RECURSIVE cells AS MATERIALIZED ({cells}), sums AS MATERIALIZED (SELECT sample_id, sum(w) AS t FROM cells WHERE sample_id IS NOT NULL GROUP BY 1),
    found AS MATERIALIZED (SELECT i, j FROM (SELECT n.i, n.j, {d} AS d FROM (SELECT a.sample_id AS i, b.sample_id AS j, sum(least(a.w, b.w)) AS s
      FROM cells a JOIN cells b ON a.key = b.key AND a.sample_id < b.sample_id GROUP BY 1, 2) n
      JOIN sums a ON a.sample_id = n.i JOIN sums b ON b.sample_id = n.j) WHERE d <= {within} + 1e-9),
    near AS MATERIALIZED (SELECT i, j FROM found UNION ALL SELECT j, i FROM found),
    classes(node, class) USING KEY (node) AS (SELECT sample_id, sample_id FROM sums UNION SELECT n.j, min(c.class) FROM classes c JOIN near n ON c.node = n.i
      JOIN recurring.classes r ON r.node = n.j WHERE c.class < r.class GROUP BY n.j)
    SELECT sample_id, class AS class_id, count(j) AS links FROM sums JOIN classes ON node = sample_id LEFT JOIN near ON i = sample_id GROUP BY 1, 2"""
# the near pairs themselves
PAIRS = """SELECT i, j, d FROM (SELECT n.i, n.j, {d} AS d FROM (SELECT a.sample_id AS i, b.sample_id AS j, sum(least(a.w, b.w)) AS s
    FROM ({cells}) a JOIN ({cells}) b ON a.key = b.key AND a.sample_id < b.sample_id GROUP BY 1, 2) n
    JOIN (SELECT sample_id, sum(w) AS t FROM ({cells}) GROUP BY 1) a ON a.sample_id = n.i
    JOIN (SELECT sample_id, sum(w) AS t FROM ({cells}) GROUP BY 1) b ON b.sample_id = n.j) WHERE d <= {within} + 1e-9"""
BOTH, EITHER = "greatest(1 - 2 * s / (a.t + b.t), 0)", "1 - s / (a.t + b.t - s)"


@query("d3_near_customers", check(NEAR.format(d=BOTH, within=0.9, cells='SELECT sample_id, feature_id AS key, ln(1 + "count") AS w FROM v_units'), "", "sample_id class_id links"))
def _(v):
    """Customers with the number of others at most 0.9 apart by the parts they ordered, and their class."""
    return D.bray_curtis(C.log_transform_counts(v.customer_counts), within=0.9, links=True)


@query("d3_near_customers_by_brand", check(NEAR.format(d=BOTH, within=0.12, cells="""SELECT sample_id, "Class" AS key, ln(1 + sum("count")) AS w
    FROM v_units JOIN v_tax USING (feature_id) GROUP BY 1, 2"""), "", "sample_id class_id links"))
def _(v):
    """Customers with the number of others at most 0.12 apart by the brands they ordered, and their class: few keys that nearly all of them hold."""
    brand = v.tax.select("feature_id", F.col("Class").alias("brand"))
    counts = v.customer_counts.join(brand, "feature_id").groupBy("sample_id", F.col("brand").alias("feature_id")).agg(F.sum("count").alias("count"))
    return D.bray_curtis(C.log_transform_counts(counts), within=0.12, links=True)


@query("d6_near_customers", check(PAIRS.format(d=BOTH, within=0.75, cells="SELECT sample_id, branch AS key, length * p AS w FROM v_parts"), "d", "i j"))
def _(v):
    """Customers at most 0.75 apart by weighted UniFrac."""
    return D.unifrac(v.customer_shares, within=0.75)


@query("d7_near_customers", check(PAIRS.format(d=EITHER, within=0.85, cells="SELECT sample_id, branch AS key, length AS w FROM v_parts"), "d", "i j"))
def _(v):
    """Customers at most 0.85 apart by unweighted UniFrac."""
    return D.unifrac(v.customer_shares, weighted=False, within=0.85)


@query("d4_tree_closure", check("""WITH RECURSIVE up AS (SELECT node AS tip, node AS branch, parent, length FROM v_tree WHERE is_tip
    UNION ALL SELECT up.tip, t.node, t.parent, t.length FROM up JOIN v_tree t ON up.parent = t.node) SELECT tip, branch, length FROM up""", "length", "tip branch"))
def _(v):
    return tree_closure(v.tree)


@query("d5_branch_proportions", check("SELECT * FROM v_share", "length p", "sample_id branch"))
def _(v):
    return v.shares


# below the k-th inner node of the deep tree are all parts from k on
DEEP = """WITH c AS (SELECT CAST(substr(feature_id, 2) AS BIGINT) AS k, sample_id, "count" AS x FROM v_counts), t AS (SELECT sample_id, sum(x) AS t FROM c GROUP BY 1),
    s AS (SELECT k, sample_id, coalesce(x, 0) AS x, sum(coalesce(x, 0)) OVER (PARTITION BY sample_id ORDER BY k DESC) AS below
      FROM (SELECT DISTINCT p_partkey AS k FROM part) CROSS JOIN t LEFT JOIN c USING (k, sample_id))
    SELECT s.sample_id, 'I' || k AS branch, 1.0 AS length, below / t AS p FROM s JOIN t USING (sample_id) WHERE below > 0
    UNION ALL SELECT s.sample_id, 'P' || k, k % 5, x / t FROM s JOIN t USING (sample_id) WHERE x > 0"""


@query("d5_deep_tree", check(DEEP, "length p", "sample_id branch"))
def _(v):
    """Branch proportions of a tree with as many levels as parts."""
    return interval_proportions(v.stored_counts, tree_intervals(v.deep_tree))


@query("d4_tips_below", check("""SELECT branch AS node, length, count(*) AS tips FROM v_closure GROUP BY 1, 2""", "length", "node tips"))
def _(v):
    """How many tips stand below every branch."""
    return v.intervals.select("node", "length", "tips")


@query("d6_unifrac_weighted", check("SELECT * FROM v_wuf", "d", "i j"))
def _(v):
    return v.wunifrac


PRESENT = "(SELECT sample_id, branch, any_value(length) AS length FROM v_counts JOIN v_closure ON feature_id = tip GROUP BY 1, 2)"
UNWEIGHTED = f"""SELECT n.i, n.j, 1 - s / (a.t + b.t - s) AS d FROM (SELECT a.sample_id AS i, b.sample_id AS j, sum(a.length) AS s FROM {PRESENT} a JOIN {PRESENT} b
    ON a.branch = b.branch AND a.sample_id < b.sample_id GROUP BY 1, 2) n JOIN (SELECT sample_id, sum(length) AS t FROM {PRESENT} GROUP BY 1) a ON a.sample_id = n.i
    JOIN (SELECT sample_id, sum(length) AS t FROM {PRESENT} GROUP BY 1) b ON b.sample_id = n.j"""


@query("d7_unifrac_unweighted", check(UNWEIGHTED, "d", "i j"))
def _(v):
    return D.unifrac(v.shares, weighted=False)


MST = f"""WITH RECURSIVE sym AS (SELECT i, j, d FROM v_euclid UNION ALL SELECT j, i, d FROM v_euclid),
    tree AS (SELECT 0 AS step, [(SELECT min(sample_id) FROM v_env)] AS inside, CAST(0 AS DOUBLE) AS edge
      UNION ALL SELECT step + 1, list_append(inside, (SELECT arg_min(s.j, s.d) FROM sym s WHERE list_contains(tree.inside, s.i) AND NOT list_contains(tree.inside, s.j))),
        (SELECT min(s.d) FROM sym s WHERE list_contains(tree.inside, s.i) AND NOT list_contains(tree.inside, s.j))
      FROM tree WHERE len(inside) < (SELECT count(*) FROM v_env))
    SELECT max(edge) AS threshold FROM tree"""


@query("d8_mst_threshold", check(MST, "threshold"))
def _(v):
    return v.spark.createDataFrame([(D.spanning_threshold(v.xy, "sample_id", ["lat", "lon"]),)], "threshold double")


@query("d8_near_pairs", check(f"SELECT i, j, d, threshold FROM v_euclid, ({MST}) WHERE d <= threshold * (1 + 1e-12)", "d threshold", "i j"))
def _(v):
    """The pairs that the truncation leaves as they are; all others are one constant."""
    near, t = D.near_within_tree(v.xy, "sample_id", ["lat", "lon"])
    return near.withColumn("threshold", F.lit(t))


@query("d8_customers_threshold")
def _(v):
    """The spanning tree's longest edge with the customers as sites."""
    return v.spark.createDataFrame([(D.spanning_threshold(v.priced.filter("price IS NOT NULL"), "k", ["balance", "price"]),)], "threshold double")


@query("d8_truncate", check(f"SELECT i, j, CASE WHEN d > threshold THEN 4 * threshold ELSE d END AS d FROM v_euclid, ({MST})", "d", "i j"))
def _(v):
    return D.truncate(_euclid(v), D.spanning_threshold(v.xy, "sample_id", ["lat", "lon"]))


# --- ordinations --------------------------------------------------------------------------------


def _axes(v, o: O.Ordination):
    rows = [(i + 1, float(x), float(x / o.trace)) for i, x in enumerate(o.eigenvalues)]
    return v.spark.createDataFrame(rows, "axis int, eigenvalue double, share double")


TRUNCATED = f"SELECT i, j, CASE WHEN d > threshold * (1 + 1e-12) THEN 4 * threshold ELSE d END AS d FROM v_euclid, ({MST})"
COLUMNS = f"""SELECT i, k, (d - avg(d) OVER (PARTITION BY i)) / stddev_samp(d) OVER (PARTITION BY i) AS z FROM (
    SELECT i, j AS k, d FROM ({TRUNCATED}) UNION ALL SELECT j, i, d FROM ({TRUNCATED}) UNION ALL SELECT sample_id, sample_id, 0 FROM v_env)"""
SPATIAL = leading(f"SELECT a.i AS i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS x FROM ({COLUMNS}) a JOIN ({COLUMNS}) b ON a.k = b.k GROUP BY 1, 2")


@query("d9_spatial_vector", check(f"SELECT id, v AS axis1, value / count(*) OVER () AS share FROM ({SPATIAL})", "axis1 share", "id"))
def _(v):
    """First loading of the scaled components of the truncated distances, per site."""
    near, t = D.near_within_tree(v.xy, "sample_id", ["lat", "lon"])
    o = O.spatial_vector_near(v.xy.select(F.col("sample_id").alias("id")), near, 4 * t)
    return o.scores.select("id", "axis1").withColumn("share", F.lit(float(o.share[0])))


@query("d10_pcoa", check("""SELECT CAST(1 AS INTEGER) AS axis, l1 AS eigenvalue, l1 / (a + b) AS share FROM (SELECT a, b, (a + b) / 2 + sqrt((a - b) ** 2 / 4 + c * c) AS l1 FROM
    (SELECT var_pop(lat) * count(*) AS a, var_pop(lon) * count(*) AS b, covar_pop(lat, lon) * count(*) AS c FROM v_xy))
    UNION ALL SELECT 2, l2, l2 / (a + b) FROM (SELECT a, b, (a + b) / 2 - sqrt((a - b) ** 2 / 4 + c * c) AS l2 FROM
    (SELECT var_pop(lat) * count(*) AS a, var_pop(lon) * count(*) AS b, covar_pop(lat, lon) * count(*) AS c FROM v_xy))""", "eigenvalue share", "axis"))
def _(v):
    """Principal coordinates of plane distances: the eigenvalues are those of the coordinates' scatter."""
    cells = v.xy.select("sample_id", F.expr("stack(2, 'lat', lat, 'lon', lon) AS (axis, x)"))
    return _axes(v, O.pcoa_cells(cells, "sample_id", "axis", "x", 2))


@query("d10_pcoa_bray_scores")
def _(v):
    return O.pcoa(D.bray_curtis(C.log_transform_counts(v.counts)), 2).scores


@query("d11_dpcoa_distance", check("""SELECT i, j, sqrt(s) AS d FROM (SELECT a.sample_id AS i, b.sample_id AS j, ta.q + tb.q - 2 * sum(a.length * a.p * b.p) AS s FROM v_share a JOIN v_share b
    ON a.branch = b.branch AND a.sample_id < b.sample_id JOIN (SELECT sample_id, sum(length * p * p) AS q FROM v_share GROUP BY 1) ta ON ta.sample_id = a.sample_id
    JOIN (SELECT sample_id, sum(length * p * p) AS q FROM v_share GROUP BY 1) tb ON tb.sample_id = b.sample_id GROUP BY 1, 2, ta.q, tb.q)""", "d", "i j"))
def _(v):
    return D.dpcoa_distance(v.shares)


WEIGHTED = """SELECT a.sample_id AS i, b.sample_id AS j, sum(sqrt(a.w * b.w) * a.y * b.y) AS x FROM {y} a JOIN {y} b ON a.branch = b.branch GROUP BY 1, 2""".format(
    y="""(SELECT sample_id, branch, w, sqrt(length) * (coalesce(p, 0) - sum(w * coalesce(p, 0)) OVER (PARTITION BY branch)) AS y FROM
      (SELECT sample_id, sum("count") / sum(sum("count")) OVER () AS w FROM v_counts GROUP BY 1) CROSS JOIN (SELECT DISTINCT branch, length FROM v_share)
      LEFT JOIN (SELECT sample_id, branch, p FROM v_share) USING (sample_id, branch))""")


@query("d11_dpcoa_axes", check(f"SELECT CAST(axis AS INTEGER) AS axis, value AS eigenvalue, value / trace AS share FROM ({leading(WEIGHTED, 2, vectors=False)})", "eigenvalue share", "axis", digits=8), digits=8)
def _(v):
    """Eigenvalues of double principal coordinates with the samples weighted by their totals."""
    weights = C.sum_by_sample(v.stored_counts).select(F.col("sample_id").alias("id"), F.col("total").alias("w"))
    return _axes(v, O.dpcoa_cells(v.shares, weights, 2))


DPCOA = """SELECT sxgx / sxx AS ss, total, n, sxgx / sxx / total AS r2 FROM (SELECT sum(q * q) AS sxgx, sum(ss - s * s / n) AS total, max(n) AS n FROM
      (SELECT branch, sum(sqrt(length) * p * x) AS q, sum(sqrt(length) * p) AS s, sum(length * p * p) AS ss, (SELECT count(*) FROM v_env) AS n
        FROM v_share JOIN (SELECT sample_id, balance - avg(balance) OVER () AS x FROM v_env) USING (sample_id) GROUP BY 1)),
    (SELECT var_pop(balance) * count(*) AS sxx FROM v_env)"""


@query("d12_dbrda_from_cells", check(f"""SELECT total / (n - 1) AS total, ss / (n - 1) AS constrained, r2, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, ss / ((total - ss) / (n - 2)) AS f
    FROM ({DPCOA})""", "total constrained r2 adj_r2 f", digits=8), digits=8)
def _(v):
    """Redundancy analysis on the distances of double principal coordinates, none of which is made."""
    cells = v.shares.withColumn("y", F.sqrt("length") * F.col("p"))
    m = O.dbrda(O.constrained_space_cells(cells, "sample_id", "branch", "y", v.env, [var("balance")], "sample_id"), ["balance"])
    row = (m.inertia["total"], m.inertia["constrained"], m.r2, m.adj_r2, m.f)
    return v.spark.createDataFrame([tuple(map(float, row))], "total double, constrained double, r2 double, adj_r2 double, f double")


def _space(v, names=("balance", "price", "qty"), d=None):
    d = v.wunifrac if d is None else d
    return O.constrained_space(d, v.env, [var(n) for n in names], key="sample_id")


X1 = "(SELECT sample_id, balance - avg(balance) OVER () AS x FROM v_env)"
ONE = f"""SELECT sxgx / sxx AS ss, total, n, sxgx / sxx / total AS r2 FROM (SELECT sum(-d * a.x * b.x) AS sxgx FROM v_wuf JOIN {X1} a ON a.sample_id = i
    JOIN {X1} b ON b.sample_id = j), (SELECT sum(x * x) AS sxx, count(*) AS n FROM {X1}), (SELECT sum(d) / (SELECT count(*) FROM v_env) AS total FROM v_wuf)"""


@query("d12_dbrda", check(f"""SELECT total / (n - 1) AS total, ss / (n - 1) AS constrained, (total - ss) / (n - 1) AS unconstrained, r2,
    1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, ss / ((total - ss) / (n - 2)) AS f FROM ({ONE})""", "total constrained unconstrained r2 adj_r2 f", digits=8), digits=8)
def _(v):
    """Distance-based redundancy analysis on one variable."""
    m = O.dbrda(_space(v, ["balance"]), ["balance"])
    i = m.inertia
    row = (i["total"], i["constrained"], i["unconstrained"], m.r2, m.adj_r2, m.f)
    return v.spark.createDataFrame([tuple(map(float, row))], "total double, constrained double, unconstrained double, r2 double, adj_r2 double, f double")


# two centred variables x, z: the sums behind partial models, inflation and variance partitioning
TWO_SUMS = """SELECT n, total, xx, zz, xz, gxx, gzz, gxz, gxx / xx AS sx, gzz / zz AS sz, (gxx * zz - 2 * gxz * xz + gzz * xx) / (xx * zz - xz * xz) AS sxz FROM
    (SELECT sum(-d * a.x * b.x) AS gxx, sum(-d * a.z * b.z) AS gzz, sum(-d * (a.x * b.z + a.z * b.x) / 2) AS gxz, sum(d) AS sd FROM v_wuf
      JOIN {x} a ON a.sample_id = i JOIN {x} b ON b.sample_id = j),
    (SELECT count(*) AS n, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz FROM {x}), (SELECT sum(d) / (SELECT count(*) FROM v_env) AS total FROM v_wuf)""".format(
    x="(SELECT sample_id, balance - avg(balance) OVER () AS x, price - avg(price) OVER () AS z FROM v_env)")


@query("d13_dbrda_partial", check(f"""SELECT sz / (n - 1) AS conditioned, (sxz - sz) / (n - 1) AS constrained, (sxz - sz) / ((total - sxz) / (n - 3)) AS f FROM ({TWO_SUMS})""", "conditioned constrained f", digits=8), digits=8)
def _(v):
    m = O.dbrda(_space(v, ["balance", "price"]), ["balance"], ["price"])
    return v.spark.createDataFrame([(float(m.inertia["conditioned"]), float(m.inertia["constrained"]), float(m.f))], "conditioned double, constrained double, f double")


@query("d14_adj_r2", check(f"SELECT 1 - (1 - sxz / total) * (n - 1) / (n - 3) AS adj_r2 FROM ({TWO_SUMS})", "adj_r2"))
def _(v):
    m = O.dbrda(_space(v, ["balance", "price"]), ["balance", "price"])
    return v.spark.createDataFrame([(float(m.adj_r2),)], "adj_r2 double")


@query("d15_vif", check("SELECT unnest(['balance', 'price']) AS variable, unnest([1 / (1 - corr(balance, price) ** 2), 1 / (1 - corr(balance, price) ** 2)]) AS vif FROM v_env", "vif", "variable"))
def _(v):
    return v.spark.createDataFrame([(k, float(x)) for k, x in O.vif_of(v.env, [var("balance"), var("price")]).items()], "variable string, vif double")


@query("d16_permutation_test")
def _(v):
    s = _space(v)
    return P.permutation_test(O.dbrda(s, ["balance", "price", "qty"]), v.spark, 999)


@query("d16_observed_f", check(f"SELECT 'Model' AS term, sxz / 2 / ((total - sxz) / (n - 3)) AS f FROM ({TWO_SUMS})", "f", "term"))
def _(v):
    s = _space(v, ["balance", "price"])
    return P.permutation_test(O.dbrda(s, ["balance", "price"]), v.spark, 99).filter("term = 'Model'").select("term", "f")


@query("d16_permutation_test_partial")
def _(v):
    s = _space(v)
    return P.permutation_test(O.dbrda(s, ["balance"], ["price", "qty"]), v.spark, 999)


@query("d17_permutation_test_terms", check(f"""SELECT unnest(['balance', 'price']) AS term, unnest([sx / ((total - sxz) / (n - 3)), (sxz - sx) / ((total - sxz) / (n - 3))]) AS f FROM ({TWO_SUMS})""", "f", "term"))
def _(v):
    s = _space(v, ["balance", "price"])
    return P.permutation_test(O.dbrda(s, ["balance", "price"]), v.spark, 999, by="terms").filter("term <> 'Residual'").select("term", "f")


@query("d18_permutation_test_axes")
def _(v):
    s = _space(v)
    return P.permutation_test(O.dbrda(s, ["balance", "price", "qty"]), v.spark, 999, by="axis")


@query("d19_ordistep")
def _(v):
    """Selection among three variables and their products; an empty choice gives one row."""
    d = v.wunifrac
    s = O.constrained_space(d, v.env, full_factorial([var("balance"), var("price"), var("qty")]), key="sample_id")
    chosen, _log = P.ordistep(s, v.spark, n=999)
    return v.spark.createDataFrame([(len(chosen), "+".join(chosen))], "terms int, model string")


@query("d20_varpart", check(f"""SELECT ab - b AS unique_first, a + b - ab AS shared, ab - a AS unique_second, 1 - ab AS residual FROM (
    SELECT 1 - (1 - sx / total) * (n - 1) / (n - 2) AS a, 1 - (1 - sz / total) * (n - 1) / (n - 2) AS b, 1 - (1 - sxz / total) * (n - 1) / (n - 3) AS ab FROM ({TWO_SUMS}))""", "unique_first shared unique_second residual", digits=8), digits=8)
def _(v):
    out = O.varpart(_space(v, ["balance", "price"]), ["balance"], ["price"])
    return v.spark.createDataFrame([tuple(map(float, out.values()))], ", ".join(f"{k} double" for k in out))


@query("d21_eigen_table", check(f"""SELECT CAST(1 AS INTEGER) AS axis, ss / (n - 1) AS eigenvalue, r2 AS of_total, 1.0 AS of_fitted, 1.0 AS cum_fitted FROM ({ONE})""", "eigenvalue of_total of_fitted cum_fitted", "axis", digits=8), digits=8)
def _(v):
    m = O.dbrda(_space(v, ["balance"]), ["balance"])
    return O.eigen_table(m, v.spark).select("axis", "eigenvalue", "of_total", "of_fitted", "cum_fitted")


@query("d21_eigen_table_three")
def _(v):
    return O.eigen_table(O.dbrda(_space(v), ["balance", "price", "qty"]), v.spark)


SCORES = f"""SELECT w.sample_id, region, (gu - avg(gu) OVER ()) / norm * total ** 0.25 / ss AS cap1 FROM (SELECT sample_id, sum(gx) AS gu FROM (
      SELECT i AS sample_id, -0.5 * d * x AS gx FROM v_wuf JOIN {X1} q ON q.sample_id = j UNION ALL SELECT j, -0.5 * d * x FROM v_wuf JOIN {X1} q ON q.sample_id = i) GROUP BY 1) w
    JOIN v_env e ON e.sample_id = w.sample_id, ({ONE}), (SELECT sqrt(sum(x * x)) AS norm FROM {X1})"""


@query("d22_site_scores", check(SCORES, "cap1", "sample_id region"))
def _(v):
    """Scores joined to a name key."""
    m = O.dbrda(_space(v, ["balance"]), ["balance"])
    return O.site_scores(m, 1).join(v.env.select(F.col("sample_id").alias("id"), "region"), "id").withColumnRenamed("id", "sample_id")


@query("d22_biplot")
def _(v):
    return O.biplot(O.dbrda(_space(v), ["balance", "price", "qty"]), v.spark)


@query("d23_log_transform_counts", check('SELECT feature_id, sample_id, ln(1 + "count") AS "count" FROM v_counts', '"count"', "feature_id sample_id"))
def _(v):
    return C.log_transform_counts(v.counts)


@query("d24_env_transform", check("""SELECT k, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS lnqty, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS sqrtp, (c - avg(c) OVER ()) / stddev_samp(c) OVER () AS logd
    FROM (SELECT k, ln(qty + 1) AS a, sqrt(price) AS b, ln(disc + 1) ** 2 AS c FROM v_master)""", "lnqty sqrtp logd", "k"))
def _(v):
    recipe = {"lnqty": F.ln(F.col("qty") + 1), "sqrtp": F.sqrt("price"), "logd": F.pow(F.ln(F.col("disc") + 1), F.lit(2))}
    return O.env_transform(v.master, recipe, ["k"])
