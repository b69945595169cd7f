"""Near pairs block by block: every pair is there with its distance, and none is stored on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similar import brute, counts, found, made

from tarn.operators import distance as D, links
from tarn.plans import ORACLES


def shares(spark, cells):
    return counts(spark, cells).select("sample_id", F.col("feature_id").alias("branch"), F.lit(2.0).alias("length"), F.col("count").alias("p"))


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("within", [0.0, 0.5, 0.95])
def test_pairs_of_many_blocks(spark, monkeypatch, weighted, within):
    for name, value in (("ITEMS", 9), ("CELLS", 150), ("STRIP", 4)):
        monkeypatch.setattr(links, name, value)
    cells = made(5)
    want = brute([(i, k, 2.0 * (v if weighted else 1.0)) for i, k, v in cells], within, unweighted=not weighted)
    assert found(D.unifrac(shares(spark, cells), weighted=weighted, within=within)) == pytest.approx(want, abs=1e-12)


def test_no_pair_is_stored(spark, monkeypatch):
    """300 samples on one branch: what is stored has a row for a cell or a block, not one for each of the 44,850 pairs."""
    sizes = []
    monkeypatch.setattr(links, "store", lambda df, f=links.store: (lambda s: sizes.append(s.count()) or s)(f(df)))
    monkeypatch.setattr(links, "ITEMS", 60)
    cells = spark.range(300).select(F.col("id").alias("sample_id"), F.lit("b").alias("branch"), F.lit(1.0).alias("length"), F.lit(1.0).alias("p"))
    got = D.unifrac(cells, within=0.5)
    assert got.filter("i < j AND d = 0").select("i", "j").distinct().count() == got.count() == 300 * 299 // 2
    assert max(sizes) <= 300


def test_a_distance_at_the_limit_is_near(spark):
    """0.1 + 0.2 is a little above 0.3, whatever the order of the branches."""
    cells = [("a", "x", 0.1), ("a", "y", 0.2), ("a", "z", 0.7), ("b", "x", 0.1), ("b", "y", 0.2), ("b", "w", 0.7), (None, "x", 1.0), ("c", None, 1.0)]
    assert found(D.unifrac(shares(spark, cells), within=0.7)) == {("a", "b"): pytest.approx(0.7)}
    assert found(D.unifrac(shares(spark, cells).limit(0), within=0.7)) == {}


@pytest.mark.parametrize("name", ["d6_near_customers", "d7_near_customers"])
def test_queries_give_the_pairs(name):
    """Every near pair with its distance, not only their numbers by customer."""
    assert "SELECT i, j, round(CAST(d AS DOUBLE), 6)" in ORACLES[name] and "links" not in ORACLES[name]


def test_overlaps_leave_out_no_near_pair(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((40, 6)) < 0.5, rng.integers(1, 9, (40, 6)), 0).astype(float)
    x = x[np.argsort(x.sum(axis=1), kind="stable")]
    who, key = np.nonzero(x)
    by_key = np.lexsort((who, key))
    block = links._Block(x.sum(axis=1), key[by_key], who[by_key], x[who[by_key], key[by_key]])
    for strip, dense in ((7, 0.25), (128, 2.0), (7, 0.0)):
        monkeypatch.setattr(links, "STRIP", strip)
        monkeypatch.setattr(links, "DENSE", dense)
        d = np.full((40, 40), 9.0)
        for rows, columns, some in links._distances(block, block, D._bray_curtis, 0.3):
            d[rows, columns] = some
        want = 1 - 2 * np.minimum(x[:, None], x[None]).sum(axis=2) / np.maximum(x.sum(axis=1)[:, None] + x.sum(axis=1), 1e-9)
        near = want <= 0.4
        assert near.sum() > 100 and np.allclose(d[near], want[near]) and (d[~near] > 0.4).all()
