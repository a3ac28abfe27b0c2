"""Quantile regression with errors and Kriging on inducing points against dense forms."""

import numpy as np
import pandas as pd
import pytest

from gramlake.operators import scalable
from gramlake.operators.additive import quantile_exact


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.8])
def test_quantile_is_exact_with_few_near_rows(spark, monkeypatch, tau):
    monkeypatch.setattr(scalable, "NEAR_ROWS", 150)
    r = np.random.default_rng(1)
    x = r.normal(3, 2, (900, 2))
    y = 1 + x @ [2.0, -1.0] + r.normal(0, 1, 900) * (1 + np.abs(x[:, 0]))
    df = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})
    got = scalable.quantile_large(spark.createDataFrame(df).unionByName(spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, y double")), ["a", "b"], "y", tau)
    want = quantile_exact(x, y, tau)
    loss = lambda c: (lambda e: (e * (tau - (e < 0))).sum())(y - c[0] - x @ c[1:])
    assert got["exact"] and got["n"] == 900
    assert loss(np.array(got["coef"])) == pytest.approx(loss(want), rel=1e-9)
    # errors against a bootstrap of exact fits
    runs = [quantile_exact(x[i], y[i], tau) for i in (r.integers(0, 900, 900) for _ in range(60))]
    assert np.array(got["se"]) == pytest.approx(np.std(runs, axis=0), rel=0.5)


def test_quantile_of_tied_rows(spark):
    df = spark.createDataFrame([(float(k % 2), float(k % 3)) for k in range(600)], "x double, y double")
    m = scalable.quantile_large(df, ["x"], "y", 0.6)
    assert m["coef"] == pytest.approx([1.0, 0.0], abs=1e-6)
    with pytest.raises(ValueError):
        scalable.quantile_large(df.limit(0), ["x"], "y", 0.5)


def field(n=400):
    r = np.random.default_rng(3)
    x = r.random((n, 2))
    return x, np.sin(5 * x[:, 0]) + x[:, 1] ** 2 + r.normal(0, 0.1, n)


def test_fitc_equals_its_dense_form(spark):
    x, y = field()
    z, lengths, sill, noise = x[:25], np.array([0.3, 0.6]), 1.5, 0.02
    k = lambda a, b: sill * np.exp(-(((a[:, None] - b[None]) / lengths) ** 2).sum(-1) / 2)
    df = spark.createDataFrame(pd.DataFrame({"qid": range(len(x)), "u": x[:, 0], "w": x[:, 1], "v": y})).repartition(5)
    m = scalable.sparse_gp(df, ["u", "w"], "v", lengths=lengths, sill=sill, noise=noise, centres=z)
    q = k(x, z) @ np.linalg.solve(k(z, z) + 1e-10 * sill * np.eye(25), k(z, x))
    cov = q + np.diag(sill - np.diag(q) + noise)
    e = y - y.mean()
    assert m["loglik"] == pytest.approx(-0.5 * (e @ np.linalg.solve(cov, e) + np.linalg.slogdet(cov)[1] + len(e) * np.log(2 * np.pi)), rel=1e-5)
    at = np.random.default_rng(5).random((30, 2))
    cross = k(at, z) @ np.linalg.solve(k(z, z) + 1e-10 * sill * np.eye(25), k(z, x))
    got = scalable.sparse_predict(m, spark.createDataFrame(pd.DataFrame({"qid": range(30), "u": at[:, 0], "w": at[:, 1]}))).toPandas().sort_values("qid")
    assert got["mean"].to_numpy() == pytest.approx(y.mean() + cross @ np.linalg.solve(cov, e), rel=1e-4, abs=1e-5)
    assert got["variance"].to_numpy() == pytest.approx(sill - np.einsum("ij,ji->i", cross, np.linalg.solve(cov, cross.T)), rel=1e-3, abs=1e-5)


def test_centres_cover_and_fit(spark):
    x, y = field(1000)
    df = spark.createDataFrame(pd.DataFrame({"qid": range(len(x)), "u": x[:, 0], "w": x[:, 1], "v": y})).repartition(6)
    z = scalable.greedy_centres(df, ["u", "w"], 40, "squared_exponential", [0.3, 0.3])
    assert 30 <= len(z) <= 40 and len(np.unique(z, axis=0)) == len(z)
    k = np.exp(-(((x[:, None] - z[None]) / 0.3) ** 2).sum(-1) / 2)
    left = 1 - np.einsum("ij,ji->i", k, np.linalg.solve(np.exp(-(((z[:, None] - z[None]) / 0.3) ** 2).sum(-1) / 2) + 1e-10 * np.eye(len(z)), k.T))
    random = np.random.default_rng(0).choice(len(x), len(z), replace=False)
    kr = np.exp(-(((x[:, None] - x[random][None]) / 0.3) ** 2).sum(-1) / 2)
    lr = 1 - np.einsum("ij,ji->i", kr, np.linalg.solve(np.exp(-(((x[random][:, None] - x[random][None]) / 0.3) ** 2).sum(-1) / 2) + 1e-10 * np.eye(len(z)), kr.T))
    assert left.max() < lr.max()
    m = scalable.sparse_gp(df, ["u", "w"], "v", 40, lengths=0.3, noise=0.01)
    got = scalable.sparse_predict(m, df).toPandas().sort_values("qid")["mean"].to_numpy()
    assert np.sqrt(np.mean((got - np.sin(5 * x[:, 0]) - x[:, 1] ** 2) ** 2)) < 0.04
    same = spark.createDataFrame([(1.0, 2.0)] * 50, "u double, w double")
    assert len(scalable.greedy_centres(same, ["u", "w"], 5, "squared_exponential", [1.0, 1.0])) == 1


def test_level_losses_take_the_lower_vertex(spark):
    """Where a share falls between two rows, the quantile is the lower one, as for a column; also beside far rows."""
    from gramlake.operators.scalable import quantile_large

    for n in (8, 4000):
        x = np.repeat([0.0, 1.0], n)
        y = np.concatenate([np.arange(n), 100 + 2.0 * np.arange(n)])
        low, high = n // 4 - 1, 100 + 2.0 * (n // 4 - 1)
        if n == 8:
            assert np.allclose(quantile_exact(x, y, 0.25), [low, high - low])
        m = quantile_large(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), ["x"], "y", 0.25)
        assert m["exact"] and np.allclose(m["coef"], [low, high - low])


def test_quantile_process_takes_groups_of_any_size(spark):
    from gramlake.operators.additive import quantile_process

    r = np.random.default_rng(2)
    p = pd.DataFrame({"g": [0] * 5001 + [1] * 301 + [None] * 51, "x": r.integers(0, 3, 5353), "y": r.normal(size=5353)})
    rows = [(None if g != g else int(g), int(x), float(y)) for g, x, y in p.itertuples(index=False)]
    got = {(k.g, k.tau): k.coef for k in quantile_process(spark.createDataFrame(rows, "g long, x long, y double"), "g", ["x"], "y", [0.3, 0.5]).collect()}
    assert set(got) == {(g, t) for g in (0, 1, None) for t in (0.3, 0.5)}
    for (g, t), coef in got.items():
        own = p[p.g.isna()] if g is None else p[p.g == g]
        e = own.y - coef[0] - coef[1] * own.x
        # subgradient conditions: the rows below and on the line hold the share, in all and along x
        for z in (np.ones(len(e)), own.x.to_numpy(float)):
            slope = (z * (t - (e < -1e-9)))[np.abs(e) > 1e-9].sum()
            assert abs(slope) <= np.abs(z[np.abs(e) <= 1e-9]).sum() + 1e-9
