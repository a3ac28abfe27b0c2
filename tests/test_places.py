"""Kriging of many rows at few places."""

import math

import numpy as np
import pandas as pd

from gramlake.operators.models import KERNELS, kriging, kriging_fit


def test_places_stand_for_all_their_rows():
    r = np.random.default_rng(4)
    x, y, g = r.integers(0, 9, (120, 1)).astype(float), r.normal(size=120), 0.1
    places, at = np.unique(x, axis=0, return_inverse=True)
    at = at.ravel()
    n = np.bincount(at)
    mean = np.bincount(at, y) / n
    got = kriging_fit(places, mean, "exponential", 3.0, g, n, float(((y - mean[at]) ** 2).sum()))
    want = kriging_fit(x, y, "exponential", 3.0, g)
    assert math.isclose(got["reml"], want["reml"], rel_tol=1e-9) and math.isclose(got["sigma2"], want["sigma2"], rel_tol=1e-9) and math.isclose(got["mean"], want["mean"], rel_tol=1e-9)
    q = np.array([[2.3], [11.0]])
    k = lambda p: KERNELS["exponential"](np.abs(q - p.T) / 3.0)
    assert np.allclose(k(places) @ got["alpha"], k(x) @ want["alpha"])
    assert np.allclose(np.einsum("ij,jk,ik->i", k(places), got["inv"], k(places)), np.einsum("ij,jk,ik->i", k(x), want["inv"], k(x)))


def test_kriging_takes_more_rows_than_a_dense_fit(spark):
    r = np.random.default_rng(5)
    p = pd.DataFrame({"g": 1, "x": r.integers(0, 7, 5000).astype(float), "y": r.normal(size=5000)})
    q = spark.createDataFrame([(1, 0, 2.5)], "g long, qid long, x double")
    (row,) = kriging(spark.createDataFrame(p), q, "g", ["x"], "y", nugget=0.1).collect()
    assert abs(row["mean"]) < 0.2 and row["variance"] > 0
