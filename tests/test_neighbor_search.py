"""Neighbour searches that go to the workers as one matrix, and sets of earlier points."""

import numpy as np
import pandas as pd

from gramlake.operators import joins, spatial


def test_nearest_breaks_ties_by_id_and_holds_a_bounded_matrix(spark, monkeypatch):
    monkeypatch.setattr(joins, "MATRIX", 700)  # two queries at once
    r = np.random.default_rng(8)
    x = r.integers(0, 6, (300, 2)).astype(float)  # many ties
    q = r.integers(0, 6, (30, 2)).astype(float)
    f = lambda v, key: spark.createDataFrame(pd.DataFrame({key: np.arange(len(v)), "a": v[:, 0], "b": v[:, 1]}))
    got = joins.nearest(f(q, "qid"), f(x, "pid"), ["a", "b"], 7).toPandas().sort_values(["qid", "rank"])
    d2 = ((q[:, None] - x[None]) ** 2).sum(-1)
    assert (got["pid"].to_numpy().reshape(30, 7) == np.argsort(d2, axis=1, kind="stable")[:, :7]).all()
    assert (got["rank"].to_numpy().reshape(30, 7) == np.arange(1, 8)).all()


def test_neighbor_sets_keep_every_point(spark):
    """Whatever the hash: the first points, and those that come before any other, have sets without neighbours."""
    for n in range(2, 9):
        points = spark.createDataFrame([(100 * n + k, float(k), float(-k)) for k in range(n)], "id long, a double, b double")
        sets = spatial.neighbor_sets(points, "id", ["a", "b"], 2).collect()
        assert sorted(r["id"] for r in sets) == [100 * n + k for k in range(n)]
