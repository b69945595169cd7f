"""Numbers of near partners and classes, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similar import brute, counts, made

from tarn.operators import distance as D, links


def expected(cells, within, unweighted=False):
    """(class, links) of every item, from the pairs."""
    items = sorted({c[0] for c in cells})
    label, n = {i: i for i in items}, dict.fromkeys(items, 0)
    pairs = brute(cells, within, unweighted)
    for a, b in pairs:
        n[a], n[b] = n[a] + 1, n[b] + 1
    for _ in items:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (label[i], n[i]) for i in items}


def found(df):
    rows = df.collect()
    got = {r.sample_id: (r.class_id, r.links) for r in rows}
    assert len(got) == len(rows) and df.columns == ["sample_id", "class_id", "links"]
    return got


@pytest.mark.parametrize(("within", "items"), [(0.0, 20), (0.3, 7), (0.95, 7), (0.95, 4096)])
def test_links_of_bray_curtis(spark, monkeypatch, within, items):
    cells = made(3)
    monkeypatch.setattr(links, "ITEMS", items)
    got = found(D.bray_curtis(counts(spark, cells), within=within, links=True))
    assert got == expected(cells, within)
    assert {got["copy"][0], got["wide"][0]} == {"copy"}


@pytest.mark.parametrize("within", [0.0, 0.3, 0.95])
@pytest.mark.parametrize(("outer", "dense"), [(1000, 0.25), (3, 0.25), (0, 2.0), (10, 0.0)])
def test_near_items_of_two_blocks(monkeypatch, within, outer, dense):
    cells = made(3)
    for name, value in (("OUTER", outer), ("DENSE", dense), ("STRIP", 3), ("MET", 50)):
        monkeypatch.setattr(links, name, value)
    (a, x), (b, y) = (block([c for c in cells if (hash_of(c[0]) % 3 == 0) is side]) for side in (True, False))
    near = links._near(x, y, D._bray_curtis, within, (1 - within) / 2)
    pairs = {tuple(sorted((a[i], b[j]))) for i, j in np.argwhere(near)}
    assert pairs == {p for p in brute(cells, within) if (hash_of(p[0]) % 3 == 0) != (hash_of(p[1]) % 3 == 0)}


def hash_of(name):
    return sum(map(ord, name))


def block(cells):
    items = sorted({c[0] for c in cells}, key=lambda i: sum(c[2] for c in cells if c[0] == i))
    rows = sorted((hash(c[1]), items.index(c[0]), c[2]) for c in cells)
    key, who, value = (np.array(a) for a in zip(*rows))
    return items, links._Block(np.bincount(who, value), key, who, value)


@pytest.mark.parametrize("weighted", [True, False])
def test_links_of_unifrac(spark, monkeypatch, weighted):
    monkeypatch.setattr(links, "ITEMS", 9)
    monkeypatch.setattr(links, "CELLS", 150)
    cells = made(5)
    shares = counts(spark, cells).select("sample_id", F.col("feature_id").alias("branch"), F.lit(2.0).alias("length"), F.col("count").alias("p"))
    want = expected([(i, k, 2.0 * (v if weighted else 1.0)) for i, k, v in cells], 0.5, unweighted=not weighted)
    assert found(D.unifrac(shares, weighted=weighted, within=0.5, links=True)) == want


def test_no_candidate_pair_is_written(spark, monkeypatch):
    """300 items, all near each other: what leaves the tasks grows with the blocks, not with the 44,850 pairs."""
    sizes = []
    monkeypatch.setattr(links, "components", lambda df, f=links.components: sizes.append(df.count()) or f(df))
    monkeypatch.setattr(links, "ITEMS", 60)
    counts_ = spark.range(300).select(F.col("id").cast("string").alias("sample_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("feature_id"), F.lit(1.0).alias("count"))
    got = found(D.bray_curtis(counts_, within=0.5, links=True))
    assert set(got.values()) == {("0", 299)}
    assert sizes[0] <= 50  # one link for two blocks


def test_absent_cells_and_empty_tables(spark):
    cells = [("a", "x", 2.0), ("b", "x", 2.0), ("c", "x", None), ("d", "x", 0.0), ("e", "x", float("nan")), ("f", "x", float("inf")),
             (None, "x", 2.0), ("a", None, 9.0), ("g", "x", -1.0)]
    df = counts(spark, cells).withColumn("item", F.lit(1)).withColumn("links", F.lit(2))
    assert found(D.bray_curtis(df, within=0.5, links=True)) == {i: ("a", 1) if i in "ab" else (i, 0) for i in "abcdefg"}
    assert D.bray_curtis(df.limit(0), within=0.5, links=True).collect() == []
    with pytest.raises(ValueError):
        D.bray_curtis(df, links=True)
    with pytest.raises(ValueError):
        D.unifrac(df, links=True)


def test_forests_connect_what_matrices_connect():
    rng = np.random.default_rng(1)
    for density in (0.02, 0.1, 0.9):
        near = rng.random((30, 40)) < density
        whole = np.zeros((70, 70), dtype=bool)
        whole[:30, 30:] = near
        rows, columns = links._forest(near)
        tree = np.zeros_like(whole)
        tree[rows, columns + 30] = True
        assert len(rows) < 70 and near[rows, columns].all()
        assert (links._labels(tree | tree.T) == links._labels(whole | whole.T)).all()
        left, right = rng.integers(0, 5, 30), rng.integers(0, 6, 40)
        some = {(left[a], right[b]) for a, b in np.argwhere(near)}
        pairs = np.zeros((11, 11), dtype=bool)
        for a, b in some:
            pairs[a, b + 5] = True
        few = np.zeros_like(pairs)
        a, b = links._contracted(near, left, right)
        few[a, b + 5] = True
        assert set(zip(a, b)) <= some
        assert (links._labels(few | few.T) == links._labels(pairs | pairs.T)).all()
