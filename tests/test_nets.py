"""Nested nets: apart and covering at every level."""

import numpy as np
import pandas as pd
import pytest

from gramlake.operators import nets


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_levels_are_apart_and_cover(spark, dims):
    r = np.random.default_rng(dims)
    x = np.where(r.random((400, 1)) < 0.7, r.random((400, dims)) * 0.05, r.random((400, dims)))
    x[50:90] = x[50]
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(400), **{f"c{j}": x[:, j] for j in range(dims)}}))
    df = df.unionByName(spark.createDataFrame([(999, *[None] * dims)], df.schema))
    got = nets.nested_nets(df.repartition(3), "k", [f"c{j}" for j in range(dims)], 5).toPandas().sort_values("k")
    assert got["k"].tolist() == list(range(400)) and got["level"].iloc[51:90].eq(6).all()
    level, diagonal = got["level"].to_numpy(), np.sqrt(((x.max(0) - x.min(0)) ** 2).sum())
    for k in range(6):
        net = x[level <= k]
        d = np.sqrt(((net[:, None] - net[None]) ** 2).sum(-1)) + 9 * np.eye(len(net))
        assert d.min() > diagonal / 2**k * (1 - 1e-9)
        assert np.sqrt(((x[:, None] - net[None]) ** 2).sum(-1)).min(1).max() <= diagonal / 2**k * (1 + 1e-9)
    again = nets.nested_nets(df.repartition(7), "k", [f"c{j}" for j in range(dims)], 5).toPandas().sort_values("k")
    assert (again["level"].to_numpy() == level).all()


def test_nets_of_little(spark):
    one = spark.createDataFrame([(4, 1.0), (3, 1.0)], "k long, c0 double")
    assert sorted((r.k, r.level) for r in nets.nested_nets(one, "k", ["c0"], 2).collect()) == [(3, 0), (4, 3)]
    assert nets.nested_nets(one.limit(0), "k", ["c0"], 2).collect() == []
