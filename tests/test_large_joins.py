"""Mesh and box joins whose plans must not depend on the size of a compressed file."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramlake.operators import joins, mesh


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mesh_joins_broadcast_nothing(spark, tmp_path):
    p, c = mesh.box_mesh(spark, (3, 2, 2))
    p.write.parquet(f"{tmp_path}/p")
    c.write.parquet(f"{tmp_path}/c")
    p, c = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/c")
    for df in (mesh.volumes(c, p), mesh.split_volumes(mesh.as_polyhedra(c), p), mesh.centroids(c, p), mesh.tetrahedra(c, p)[1]):
        assert "Broadcast" not in plan(df)
    assert mesh.split_volumes(mesh.as_polyhedra(c), p).agg(F.round(F.sum("volume"), 9)).first()[0] == 1.0


def test_boundary_deals_faces_before_it_sorts_them(spark):
    _, c = mesh.box_mesh(spark, (3, 2, 2))
    df = mesh.boundary(c)
    text = plan(df)
    assert text.count("Exchange") == 1 and text.rindex("SortAggregate") < text.index("Exchange")
    assert df.count() == 2 * (3 * 2 + 3 * 2 + 2 * 2)


def test_batch_overlaps_equal_clip():
    r = np.random.default_rng(3)
    a = [np.round(r.uniform(0, 4, (n, 2)), 1) for n in r.integers(3, 6, 300)]
    angle = [np.sort(r.uniform(0, 2 * np.pi, n)) for n in r.integers(3, 7, 300)]
    b = [2 + np.stack([np.cos(t), np.sin(t)], 1) * 1.5 for t in angle]
    got = mesh.overlap_areas(mesh.padded(pd.Series([x.ravel() for x in a])), mesh.padded(pd.Series([x.ravel() for x in b])))
    want = [abs(mesh.moments(mesh.clip(x, y))[0]) for x, y in zip(a, b, strict=True)]
    assert np.allclose(got, want, atol=1e-12) and (np.array(want) > 0).sum() > 100 and (np.array(want) == 0).any()


@pytest.mark.parametrize("rows", (7, 4096))
def test_hot_cells_of_a_box_join_are_split(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "BLOCK_ROWS", rows)
    box = lambda n, k: spark.range(n).select("id", (F.col("id") % k).cast("double").alias("x_lo"), (F.col("id") % k + 1.5).alias("x_hi"))
    got = joins.box_pairs(box(90, 7), box(60, 9), ["x"], [4.0]).collect()
    want = [(i, j) for i in range(90) for j in range(60) if i % 7 <= j % 9 + 1.5 and j % 9 <= i % 7 + 1.5]
    assert sorted(map(tuple, got)) == want
