"""Polyhedra: faces, volumes and centres of mass whichever way faces turn, and the least-squares field that must converge."""

import pytest
from pyspark.sql import functions as F

from gramlake.operators import elements, mesh


def test_boxes_as_polyhedra_keep_faces_and_volumes(spark):
    p, c = mesh.box_mesh(spark, (3, 2, 2), (3.0, 2.0, 1.0))
    poly = mesh.as_polyhedra(c)
    assert sorted(poly.columns) == ["cid", "layer", "nodes", "stream", "type"] and {r.type for r in poly.collect()} == {42}
    key = lambda df: sorted((r.cid, tuple(sorted(r.nodes))) for r in mesh.boundary(df).collect())
    assert key(poly) == key(c)
    turned = poly.withColumn("stream", F.transform("stream", lambda f, k: F.when(k % 2 == 0, F.reverse(f)).otherwise(f)))
    for cells in (c, poly, turned):
        got = {r.cid: r for r in mesh.split_volumes(cells, p).collect()}
        want = {r.cid: r for r in mesh.centroids(c, p).collect()}
        assert len(got) == 12 and all(r.volume == pytest.approx(0.5) and (r.x, r.y, r.z) == pytest.approx((want[k].x, want[k].y, want[k].z)) for k, r in got.items())
    every, tets = mesh.tetrahedra(turned, p)
    assert tets.count() == 12 * 12 and every.count() == p.count() + 12
    assert mesh.volumes(tets, every).agg(F.min("volume"), F.sum("volume")).first() == (pytest.approx(0.5 / 12), pytest.approx(6.0))


def test_mixed_cells(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "pid long, x double, y double, z double")
    rows = [(7, 10, [0, 1, 2, 3], None), (8, 42, [0, 1, 2, 3], [[0, 1, 2], [0, 1, 3], [3, 2, 1], [0, 2, 3]]), (9, 42, [0, 1], []), (10, 5, [0, 1, 2], None)]
    cells = spark.createDataFrame(rows, "cid long, type int, nodes array<long>, stream array<array<long>>")
    assert sorted((r.cid, round(r.volume, 9)) for r in mesh.split_volumes(cells, points).collect()) == [(7, round(1 / 6, 9)), (8, round(1 / 6, 9))]
    assert mesh.split_volumes(cells.limit(0), points).collect() == []


def test_nodal_field_raises_before_it_is_converged(spark):
    p, c = mesh.plane_mesh(spark, 4, 4)
    cells = c.withColumn("q", (F.col("cid") % 5).cast("double"))
    with pytest.raises(RuntimeError):
        elements.consistent_flux(cells, p, "q", rounds=2)
