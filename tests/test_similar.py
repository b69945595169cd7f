"""Near pairs by overlap, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import distance as D, similar


def brute(cells, within, unweighted=False):
    """Pairs at most ``within`` apart, from dense vectors."""
    items, keys = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    x = np.zeros((len(items), len(keys)))
    for i, k, v in cells:
        x[items.index(i), keys.index(k)] = v
    out = {}
    for a in range(len(items)):
        for b in range(a + 1, len(items)):
            s, t = np.minimum(x[a], x[b]).sum(), x[a].sum() + x[b].sum()
            d = 1 - s / (t - s) if unweighted else 1 - 2 * s / t
            if d <= within + 1e-12:
                out[items[a], items[b]] = d
    return out


def counts(spark, cells):
    return spark.createDataFrame(cells, "sample_id string, feature_id string, count double").repartition(4)


def made(seed):
    """Families of near copies, sizes over three orders, a feature in every sample and a sample with a third of all cells."""
    rng = np.random.default_rng(seed)
    cells = []
    for family in range(12):
        base = {f"k{k}": float(rng.integers(1, 40)) * 10 ** rng.integers(0, 3) for k in rng.choice(200, 15, replace=False)}
        for member in range(4):
            own = {k: float(max(1, round(v * rng.uniform(0.8, 1.25)))) for k, v in base.items() if rng.random() > 0.1}
            cells += [(f"s{family}_{member}", k, v) for k, v in own.items()] + [(f"s{family}_{member}", "all", 5.0)]
    cells += [("wide", f"k{k}", float(1 + k % 7)) for k in range(200)] + [("copy", f"k{k}", float(1 + k % 7)) for k in range(200)]
    return cells + [("lone", "nobody", 3.0), ("hot1", "all", 1.0), ("hot2", "all", 1.0)]


def found(df):
    rows = df.collect()
    got = {(r.i, r.j): r.d for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("within", [0.0, 0.2, 0.5, 0.95])
def test_bray_curtis_within(spark, within):
    cells = made(3)
    got, want = found(D.bray_curtis(counts(spark, cells), within=within)), brute(cells, within)
    assert ("copy", "wide") in got and ("hot1", "hot2") in got
    assert got == pytest.approx(want, abs=1e-12)


def test_hot_groups_in_blocks_and_by_shuffle(spark, monkeypatch):
    cells = made(4)
    want = brute(cells, 0.6)
    monkeypatch.setattr(similar, "BLOCK", 3)
    monkeypatch.setattr(similar, "HEAVY", 8)
    assert found(D.bray_curtis(counts(spark, cells), within=0.6)) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("weighted", [True, False])
def test_unifrac_within(spark, weighted):
    cells = made(5)
    shares = counts(spark, cells).select("sample_id", F.col("feature_id").alias("branch"), F.lit(2.0).alias("length"), F.col("count").alias("p"))
    want = brute([(i, k, 2.0 * (v if weighted else 1.0)) for i, k, v in cells], 0.5, unweighted=not weighted)
    got = found(D.unifrac(shares, weighted=weighted, within=0.5))
    assert len(want) > 20
    assert got == pytest.approx(want, abs=1e-12)
    whole = found(D.unifrac(shares, weighted=weighted).filter("d <= 0.5"))
    assert got == pytest.approx(whole, abs=1e-12)


def test_absent_cells_and_empty_tables(spark):
    cells = [("a", "x", 2.0), ("b", "x", 2.0), ("c", "x", None), ("d", "x", 0.0), ("e", "x", float("nan")), ("f", "x", float("inf")),
             (None, "x", 2.0), ("a", None, 9.0), ("g", "x", -1.0)]
    df = counts(spark, cells).withColumn("item", F.lit(1)).withColumn("rest", F.lit(2))
    assert found(D.bray_curtis(df, within=0.5)) == {("a", "b"): 0.0}
    assert D.bray_curtis(df.limit(0), within=0.5).collect() == []


def test_limits_are_checked(spark):
    df = counts(spark, made(6)[:5])
    shares = df.select("sample_id", F.col("feature_id").alias("branch"), F.lit(1.0).alias("length"), F.col("count").alias("p"))
    for bad in (1.0, -0.1):
        with pytest.raises(ValueError):
            D.bray_curtis(df, within=bad)
    with pytest.raises(ValueError):
        D.unifrac(shares, normalized=False, within=0.5)
    with pytest.raises(ValueError):
        similar.overlap_pairs(df, "sample_id", "feature_id", "count", 0.6)


def test_far_pairs_are_no_candidates(spark):
    cells = made(7)
    src = counts(spark, cells).toDF("item", "key", "value")
    n = similar._candidates(similar._prefixes(src, 0.45), 0.45).count()
    assert len(brute(cells, 0.1)) <= n <= 200  # of 1378 pairs, nearly all of which share a key
