"""Hand-checked community fixtures: counts, lineages, tree, diversity, both UniFracs."""

import math

import pytest
from pyspark.sql import functions as F

from tarn.operators import community as C, distance as D
from tarn.operators.tree import branch_proportions, tree_closure

CELLS = [("f1", "s1", 4.0), ("f2", "s1", 4.0), ("f3", "s1", 2.0), ("f1", "s2", 5.0), ("f2", "s2", 5.0), ("f1", "s3", 1.0), ("f4", "s3", 1.0)]


@pytest.fixture(scope="module")
def com(spark):
    counts = spark.createDataFrame(CELLS, "feature_id string, sample_id string, count double")
    tax = spark.createDataFrame(
        [("f1", "P1", "F1", "G"), ("f2", "P1", "F1", "G"), ("f3", "P2", "F2", "G"), ("f4", None, "F3", None), ("f9", "P3", "F3", "H")],
        "feature_id string, Phylum string, Family string, Genus string")
    tree = spark.createDataFrame(
        [("x", "root", 1.0, False), ("y", "root", 1.0, False), ("f1", "x", 1.0, True), ("f2", "x", 1.0, True), ("f3", "y", 1.0, True),
         ("f4", "y", 1.0, True)], "node string, parent string, length double, is_tip boolean")
    samples = spark.createDataFrame([("s1", "L1"), ("s2", "L2"), ("s3", "L1"), ("s8", "L8")], "sample_id string, lake string")
    return C.Community(counts, tax, tree, samples)


def cells(df):
    return {(r["feature_id"], r["sample_id"]): r["count"] for r in df.collect()}


def ids(df):
    return {r["feature_id"] for r in df.collect()}


def test_align_load_and_shape(com, spark, tmp_path):
    a = C.align(com)
    assert a.samples.count() == 3 and ids(a.taxonomy) == {"f1", "f2", "f3", "f4"}
    b = C.load_community(spark, C.store_community(com, str(tmp_path / "c")))
    assert cells(b.counts) == cells(com.counts)
    wide = com.counts.groupBy("feature_id").pivot("sample_id").agg(F.sum("count")).na.fill(0.0)
    assert cells(C.wide_to_long(wide)) == cells(com.counts)
    assert C.rank_names(com.taxonomy) == ["Phylum", "Family", "Genus"] and C.n_samples(com.counts) == 3
    assert C.melt(a).count() == 7


def test_filters_divide_by_samples_not_rows(com):
    assert ids(C.filter_features(com.counts, 3, 0.5)) == {"f1", "f2"}
    assert ids(C.filter_features(com.counts, 3, 0.5, total_samples=4)) == set()
    assert ids(C.filter_features_by_total(com.counts, 9)) == {"f1"}
    assert ids(C.filter_prevalence(com.counts, 0.5)) == {"f1", "f2"}
    assert ids(C.filter_prevalence(com.counts, 0.3, com.taxonomy.filter("Phylum = 'P2'"), total_samples=3)) == {"f3"}
    depth = C.filter_samples_by_depth(com.counts, 5)
    assert {r["sample_id"] for r in depth.collect()} == {"s1", "s2"}
    assert {r["sample_id"] for r in C.subset_samples(com, F.col("lake") == "L1").counts.collect()} == {"s1", "s3"}
    assert ids(C.subset_taxa(com, F.col("Phylum") == "P1").counts) == {"f1", "f2"}


def test_top_fraction_keeps_ties_at_the_cut(com):
    # 4 features, p = 0.25: the cut is each sample's largest count; f1 and f2 tie in s1 and s2
    assert ids(C.filter_top_fraction(com.counts, 0.25, 2)) == {"f1", "f2"}
    # p = 0.75 in s2 reaches the absent features: its cut is zero, and absent features are at it
    got = ids(C.filter_top_fraction(com.counts, 0.75, 3))
    want = brute_top(CELLS, 0.75, 3)
    assert got == want


def brute_top(rows, p, need):
    features, samples = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    value = {(f, s): v for f, s, v in rows}
    k = math.ceil(len(features) * p)
    hits = dict.fromkeys(features, 0)
    for s in samples:
        x = sorted((value.get((f, s), 0.0) for f in features), reverse=True)
        for f in features:
            hits[f] += value.get((f, s), 0.0) >= x[k - 1]
    return {f for f in features if hits[f] >= need}


def test_top_features_and_groups_break_ties_by_name(com):
    assert [r["feature_id"] for r in C.top_features(com.counts, 3).collect()] == ["f1", "f2", "f3"]
    assert [r["Phylum"] for r in C.top_groups(com.counts, com.taxonomy, "Phylum", 2).collect()] == ["P1", "P2"]
    assert ids(C.keep_top_groups(com, "Phylum", 1).counts) == {"f1", "f2"}


def test_sums_and_prevalence(com):
    prev = {r["feature_id"]: (r["Prevalence"], r["TotalAbundance"]) for r in C.prevalence(com.counts).collect()}
    assert prev == {"f1": (3, 10.0), "f2": (2, 9.0), "f3": (1, 2.0), "f4": (1, 1.0)}
    by = {r["Phylum"]: (r["mean_prevalence"], r["sum_prevalence"]) for r in C.prevalence_by(C.prevalence(com.counts, com.taxonomy)).collect()}
    assert by == {"P1": (2.5, 5), "P2": (1.0, 1), None: (1.0, 1)}
    assert {r["Phylum"]: r["total"] for r in C.sum_by_group(com.counts, com.taxonomy, "Phylum").collect()} == {"P1": 19.0, "P2": 2.0}


def test_agglomerate_uses_the_whole_lineage(com):
    out = C.agglomerate(com, "Genus")
    assert cells(out.counts) == {("f1", "s1"): 8.0, ("f1", "s2"): 10.0, ("f1", "s3"): 1.0, ("f3", "s1"): 2.0}


def test_relative_abundance_and_ranks(com):
    rel = C.relative_abundance(com.counts, 100)
    sums = {r["sample_id"]: r["s"] for r in rel.groupBy("sample_id").agg(F.sum("count").alias("s")).collect()}
    assert all(math.isclose(v, 100) for v in sums.values())
    rank = {(r["feature_id"], r["sample_id"]): r["rank"] for r in C.rank_in_sample(com.counts).collect()}
    assert rank[("f1", "s1")] == 1 and rank[("f2", "s1")] == 1 and rank[("f3", "s1")] == 3
    prepared = C.prepare(com, k=1, keep_sample=F.col("lake") == "L1")
    assert math.isclose(cells(prepared.counts)[("f1", "s3")], 100)


def test_richness(spark):
    x = [1.0, 1.0, 1.0, 2.0, 2.0, 5.0, 12.0, 30.0]
    df = spark.createDataFrame([(f"f{i}", "s", v) for i, v in enumerate(x)] + [("g", "t", 4.0)], "feature_id string, sample_id string, count double")
    got = {r["sample_id"]: r for r in C.richness(df).collect()}
    r, n = got["s"], sum(x)
    p = [v / n for v in x]
    assert r["Observed"] == 8 and math.isclose(r["Chao1"], 8 + 3 * 2 / (2 * 3))
    assert math.isclose(r["Shannon"], -sum(q * math.log(q) for q in p))
    assert math.isclose(r["Simpson"], 1 - sum(q * q for q in p)) and math.isclose(r["InvSimpson"], 1 / sum(q * q for q in p))
    # rare: 1 1 1 2 2 5, 12 individuals; coverage 1 - 3/12
    cov = 1 - 3 / 12
    gamma = max(6 / cov * (2 * 2 + 5 * 4) / (12 * 11) - 1, 0)
    assert math.isclose(r["ACE"], 2 + 6 / cov + 3 / cov * gamma)
    a = r["Fisher"]
    assert math.isclose(a * math.log(1 + n / a), 8, rel_tol=1e-9)
    assert got["t"]["Shannon"] == 0 and got["t"]["Chao1"] == 1


def test_closure_and_unifrac_by_hand(com):
    closure = tree_closure(com.tree)
    assert {(r["tip"], r["branch"]) for r in closure.collect()} == {
        ("f1", "f1"), ("f1", "x"), ("f2", "f2"), ("f2", "x"), ("f3", "f3"), ("f3", "y"), ("f4", "f4"), ("f4", "y")}
    shares = branch_proportions(com.counts, closure)
    p = {(r["sample_id"], r["branch"]): r["p"] for r in shares.collect()}
    assert math.isclose(p[("s1", "x")], 0.8) and math.isclose(p[("s3", "y")], 0.5)
    w = {(r["i"], r["j"]): r["d"] for r in D.unifrac(shares).collect()}
    # s1 f .4 .4 .2, x .8 y .2; s2 f .5 .5, x 1: |diff| = .1 + .1 + .2 + .2 + .2 over 4
    assert math.isclose(w[("s1", "s2")], 0.8 / 4)
    raw = {(r["i"], r["j"]): r["d"] for r in D.unifrac(shares, normalized=False).collect()}
    assert math.isclose(raw[("s1", "s2")], 0.8)
    u = {(r["i"], r["j"]): r["d"] for r in D.unifrac(shares, weighted=False).collect()}
    # s1 has f1 f2 x f3 y, s2 f1 f2 x: 2 of 5 unshared
    assert math.isclose(u[("s1", "s2")], 2 / 5)
    d = {(r["i"], r["j"]): r["d"] for r in D.dpcoa_distance(shares).collect()}
    assert math.isclose(d[("s1", "s2")] ** 2, 0.01 + 0.01 + 0.04 + 0.04 + 0.04)


def test_deep_tree_and_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}", 1.0, i == 0) for i in range(20)]
    got = tree_closure(spark.createDataFrame(chain, "node string, parent string, length double, is_tip boolean"))
    assert got.count() == 20 and got.agg(F.sum("length")).first()[0] == 20


def test_bray_curtis(com):
    d = {(r["i"], r["j"]): r["d"] for r in D.bray_curtis(com.counts).collect()}
    assert math.isclose(d[("s1", "s2")], 1 - 2 * 8 / 20) and math.isclose(d[("s2", "s3")], 1 - 2 * 1 / 12)
    apart = com.counts.filter("feature_id = 'f4' or (feature_id = 'f3')")
    assert [r["d"] for r in D.bray_curtis(apart).collect()] == [1.0]


def test_one_hot_feature_and_sample_change_nothing(spark):
    """A feature that every sample holds, and a sample that holds every feature."""
    rows = [("hot", f"s{j}", float(j + 1)) for j in range(40)] + [(f"f{i}", "s0", 1.0 + i % 3) for i in range(300)]
    rows += [(f"f{i}", f"s{1 + i % 39}", 2.0) for i in range(300)]
    df = spark.createDataFrame(rows, "feature_id string, sample_id string, count double")
    got = {(r["i"], r["j"]): r["d"] for r in D.bray_curtis(df).collect()}
    cell, total = {}, {}
    for f, s, v in rows:
        cell.setdefault(s, {})[f] = v
        total[s] = total.get(s, 0) + v
    names = sorted(cell)
    assert len(got) == 40 * 39 // 2
    for a in names:
        for b in names:
            if a < b:
                shared = sum(min(v, cell[b].get(f, 0)) for f, v in cell[a].items())
                assert math.isclose(got[(a, b)], 1 - 2 * shared / (total[a] + total[b]), abs_tol=1e-12)
    assert ids(C.filter_top_fraction(df, 0.2, 5)) == brute_top(rows, 0.2, 5)
