"""Variograms of sampled pairs and of cells against all pairs."""

import numpy as np
import pandas as pd
import pytest

from gramlake.operators import joins, pairs

EDGES = [0.0, 0.1, 0.2, 0.4, 0.8]


def frame(spark, n, seed=0):
    """A smooth field with noise, on points of which half lie in a corner; three of them at one place, two with missing numbers."""
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, 1)) < 0.5, r.random((n, 2)) * 0.2, r.random((n, 2)))
    x[:3] = x[0]
    v = np.sin(4 * x[:, 0]) + x[:, 1] + r.normal(0, 0.1, n) + 50
    df = pd.DataFrame({"pid": np.arange(n), "x": x[:, 0], "y": x[:, 1], "v": v})
    return spark.createDataFrame(df).unionByName(spark.createDataFrame([(n, None, 0.5, 1.0), (n + 1, 0.5, 0.5, float("nan"))], "pid long, x double, y double, v double")), x, v


def plainly(x, v):
    i, j = np.triu_indices(len(v), 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    g = (v[i] - v[j]) ** 2 / 2
    at = [(d > lo) & (d <= hi) for lo, hi in zip(EDGES, EDGES[1:], strict=False)]
    return {k: (m.sum(), d[m].mean(), g[m].mean(), np.sqrt((d[m] ** 2).mean())) for k, m in enumerate(at)}


@pytest.mark.parametrize("n", [60, 61])
def test_all_shifts_are_all_pairs(spark, n):
    df, x, v = frame(spark, n)
    got = {r.bin: r for r in pairs.sampled_variogram(df, ["x", "y"], "v", EDGES, 10**9).collect()}
    for k, (count, distance, gamma, _) in plainly(x, v).items():
        assert (got[k].sampled, got[k].pairs) == (count, pytest.approx(count))
        assert (got[k].distance, got[k].gamma) == (pytest.approx(distance), pytest.approx(gamma))


def test_sampled_counts_are_unbiased(spark):
    df, x, v = frame(spark, 300)
    want = plainly(x, v)
    runs = [{r.bin: r for r in pairs.sampled_variogram(df, ["x", "y"], "v", EDGES, 3000, seed=str(k)).collect()} for k in range(6)]
    for k, (count, _, gamma, _) in want.items():
        assert np.mean([r[k].pairs for r in runs]) == pytest.approx(count, rel=0.1)
        assert np.mean([r[k].gamma for r in runs]) == pytest.approx(gamma, rel=0.15)


@pytest.mark.parametrize("levels", [0, 3, 6])
def test_cells_bound_the_counts(spark, levels):
    df, x, v = frame(spark, 250, 1)
    got = {r.bin: r for r in pairs.cell_variogram(df, ["x", "y"], "v", EDGES, levels).collect()}
    for k, (count, *_) in plainly(x, v).items():
        assert got[k].least <= count <= got[k].most and got[k].least <= got[k].pairs <= got[k].most
    if levels == 6:
        for k, (count, _, gamma, rms) in list(plainly(x, v).items())[1:]:
            assert got[k].pairs == pytest.approx(count, rel=0.03)
            assert got[k].gamma == pytest.approx(gamma, rel=0.03) and got[k].distance == pytest.approx(rms, rel=0.02)


def test_variograms_of_nothing(spark):
    df, *_ = frame(spark, 5)
    for rows in (df.limit(0), df.where("pid = 0")):
        assert pairs.sampled_variogram(rows, ["x", "y"], "v", EDGES, 100).collect() == []
        assert pairs.cell_variogram(rows, ["x", "y"], "v", EDGES).collect() == []


def _brute_variogram(rows, edges, robust=False, direction=None, tolerance=22.5):
    rows = [r for r in rows if None not in r[:3]]
    ids, xy = np.array([r[0] for r in rows]), np.array([r[1:3] for r in rows], float)
    v, there = np.array([r[3] or 0.0 for r in rows]), np.array([r[3] is not None for r in rows])
    i, j = np.triu_indices(len(rows), 1)
    i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
    step = xy[j] - xy[i]
    d = np.sqrt((step**2).sum(1))
    along = np.ones(len(d), bool)
    if direction is not None:
        along = np.abs(step @ direction) / np.linalg.norm(direction) >= d * np.cos(np.radians(tolerance)) * (1 - 1e-12)
    out = {}
    for k in range(len(edges) - 1):
        m = (d > edges[k]) & (d <= edges[k + 1]) & along
        both = m & there[i] & there[j]
        g = np.abs(v[i[both]] - v[j[both]])
        n = m.sum()
        if n:
            out[k] = (n, d[m].mean(), 0.5 * np.sqrt(g).mean() ** 4 / (0.457 + 0.494 / n + 0.045 / n / n) if robust else (0.5 * g**2).mean())
    return out


def test_variogram_measures_crowded_cells_as_arrays(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(k, *map(float, r.normal(size=2) * 0.1), float(r.normal())) for k in range(900)]
    rows += [(900 + k, *rows[7][1:3], None if k % 3 else 2.0) for k in range(300)]  # at one place, most without a value
    rows += [(5, 0.3, 0.3, 1.0), (None, 0.1, 0.1, 1.0), (2000, None, 0.1, 1.0), (2001, 1.4, 1.4, 3.0), (2002, 1.5, 1.4, 4.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, v double")
    edges = [0.0, 0.1, 0.3, 0.6]
    joined, old = [], joins.pairs_within
    monkeypatch.setattr(joins, "pairs_within", lambda *a: joined.append(old(*a)) or joined[-1])
    monkeypatch.setattr(joins, "BLOCK_ROWS", 150)
    monkeypatch.setattr(joins, "DENSE_PAIRS", 200)
    for options in ({}, {"robust": True}, {"direction": [1.0, 2.0]}):
        got = {x["bin"]: (x["pairs"], x["distance"], x["gamma"]) for x in joins.variogram(points, ["x", "y"], "v", edges, **options).collect()}
        want = _brute_variogram(rows, edges, **options)
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:], rtol=1e-9) for k in want)
    assert joined[0].count() < 2000  # of some 700,000
