"""Whitening against dense eigenvectors and whole-number sums."""

import math

import numpy as np
import pytest

from tarn.llm import whitening

SCHEMA = "embedding array<float>, vec_id long, n int, x string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(v, i, 3, "x") for i, v in rows], SCHEMA).repartition(parts)


def usable(rows):
    good = [(i, v) for i, v in rows if v and not any(c is None or not math.isfinite(c) for c in v)]
    size = max({len(v) for _, v in good}, key=lambda k: (sum(len(v) == k for _, v in good), k), default=0)
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good if len(v) == size]


def compare(got, rows, components=32):
    kept = usable(rows)
    x, n = np.array([v for _, v in kept], dtype=object), len(kept)
    sums = x.sum(axis=0)
    c = (n * x - sums).astype(float) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, int((e > 1e-20 * e[0]).sum()) if e[0] > 0 else 0, n - 1)
    by = {}
    for r in got.collect():
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    deviation = {}
    for i, v in kept:
        deviation.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(v, sums.tolist(), strict=True)))
    white = np.zeros((n, k))
    for m in range(1, k + 1):
        assert sum(len(v) for v in by[m].values()) == n
        for i, rs in by[m].items():
            assert sorted(r.deviation for r in rs) == sorted(deviation[i]) and rs[0].n == n
        assert by[m][kept[0][0]][0].explained == pytest.approx(e[m - 1] / e.sum(), rel=1e-9)
        if len(deviation) == n:
            white[:, m - 1] = [by[m][i][0].whitened for i, _ in kept]
    if len(deviation) == n and k:
        cov = (white - white.mean(axis=0)).T @ (white - white.mean(axis=0)) / n
        assert np.abs(cov - np.eye(k)).max() < 1e-8
        assert by[1][kept[0][0]][0].identity_error < 1e-8
        for m in range(k):  # projections on a unit eigenvector, where eigenvalues are apart
            near = min(abs(e[m] - e[j]) for j in range(len(e)) if j != m) if len(e) > 1 else e[0]
            if near > 1e-3 * e[0]:
                mine, theirs = white[:, m], c @ axes[:, m] / np.sqrt(e[m])
                assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8


@pytest.mark.parametrize("entries, components", [(40, 32), (12, 32), (64, 5)])
def test_whiten(spark, entries, components):
    rnd = np.random.default_rng(entries)
    values = (rnd.standard_normal((300, entries)) * np.linspace(3, 0.2, entries)).astype(np.float32).tolist()
    rows = list(enumerate(values)) + [(1000, None), (1001, []), (1002, [None] * entries), (1003, [math.nan, *values[0][1:]]), (1004, [math.inf, *values[0][1:]]), (1005, [1.0, 2.0])]
    compare(whitening.whiten(frame(spark, rows), components=components), rows, components)


def test_repeated_rows_few_directions_and_equal_variances(spark):
    rnd = np.random.default_rng(1)
    low = (rnd.integers(-40, 40, (200, 3)) @ rnd.integers(-3, 4, (3, 20)) / 64).tolist()
    rows = [(k % 150, v) for k, v in enumerate(low * 2)] + [(None, low[0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 3 * 401 and max(r.identity_error for r in got) < 1e-8
    cube = [[float(b >> k & 1) for k in range(6)] for b in range(64)]  # all six variances are equal: a search from one start sees one
    compare(whitening.whiten(frame(spark, list(enumerate(cube)))), list(enumerate(cube)))
    few = [(k, rnd.standard_normal(30).astype(np.float32).tolist()) for k in range(5)]
    compare(whitening.whiten(frame(spark, few)), few)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]):
        got = whitening.whiten(frame(spark, rows))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_and_sums(spark):
    rows = [(k, [float(k * 2**44), 1.0]) for k in range(9)]
    got = whitening.whiten(frame(spark, rows)).collect()
    x = [64 * k * 2**44 + 10**6 for k in range(9)]
    exact = [(9 * v - sum(x)) ** 2 for v in x]
    assert {r.vec_id: r.deviation for r in got if r.component == 1} == {k: v if v < 2**63 else None for k, v in enumerate(exact)}


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 2)
    rnd = np.random.default_rng(3)
    rows = list(enumerate(rnd.standard_normal((100, 5)).astype(np.float32).tolist()))
    compare(whitening.whiten(frame(spark, rows, 20)), rows)
