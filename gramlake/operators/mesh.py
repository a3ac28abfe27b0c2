"""Meshes as tables: points (pid, x, y, z) and cells (cid, type, nodes). Faces, measures, surfaces, overlap transfer, layered profiles."""

from __future__ import annotations


from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.session import table

#: Local node numbers of the faces of VTK cells, outward: tetrahedron 10, hexahedron 12, wedge 13, pyramid 14.
FACES = {
    10: ((0, 1, 3), (1, 2, 3), (2, 0, 3), (0, 2, 1)),
    12: ((0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)),
    13: ((0, 1, 2), (3, 5, 4), (0, 3, 4, 1), (1, 4, 5, 2), (2, 5, 3, 0)),
    14: ((0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)),
}
DIMENSION = {3: 1, 5: 2, 7: 2, 9: 2, 10: 3, 12: 3, 13: 3, 14: 3, 42: 3}
#: A polyhedron's type. Its faces stand in the column stream, an array of node lists. A cell has fewer faces than FACES_MOST.
POLYHEDRON, FACES_MOST = 42, 1024


def box_mesh(spark: SparkSession, n: Sequence[int], size: Sequence[float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Points and hexahedra of a structured box, planned from row numbers."""
    nx, ny, nz = n
    p = spark.range((nx + 1) * (ny + 1) * (nz + 1)).withColumnRenamed("id", "pid")
    i, j, k = F.col("pid") % (nx + 1), F.floor(F.col("pid") / (nx + 1)) % (ny + 1), F.floor(F.col("pid") / ((nx + 1) * (ny + 1)))
    points = p.select("pid", (i * (size[0] / nx)).alias("x"), (j * (size[1] / ny)).alias("y"), (k * (size[2] / nz)).alias("z"))
    c = spark.range(nx * ny * nz).withColumnRenamed("id", "cid")
    i, j, k = F.col("cid") % nx, F.floor(F.col("cid") / nx) % ny, F.floor(F.col("cid") / (nx * ny))
    at = lambda a, b, d: ((i + a) + (nx + 1) * ((j + b) + (ny + 1) * (k + d))).cast("long")
    nodes = F.array(at(0, 0, 0), at(1, 0, 0), at(1, 1, 0), at(0, 1, 0), at(0, 0, 1), at(1, 0, 1), at(1, 1, 1), at(0, 1, 1))
    return points, c.select("cid", F.lit(12).alias("type"), nodes.alias("nodes"), k.cast("int").alias("layer"))


def plane_mesh(spark: SparkSession, nx: int, ny: int, size: Sequence[float] = (1.0, 1.0), triangles: bool = True) -> tuple[DataFrame, DataFrame]:
    """Points and triangles (or quadrilaterals) of a rectangle."""
    p = spark.range((nx + 1) * (ny + 1)).withColumnRenamed("id", "pid")
    points = p.select("pid", (F.col("pid") % (nx + 1) * (size[0] / nx)).alias("x"), (F.floor(F.col("pid") / (nx + 1)) * (size[1] / ny)).alias("y"), F.lit(0.0).alias("z"))
    c = spark.range(nx * ny).withColumnRenamed("id", "q")
    a = (F.col("q") % nx + (nx + 1) * F.floor(F.col("q") / nx)).cast("long")
    corner = [a, a + 1, a + nx + 2, a + nx + 1]
    if not triangles:
        return points, c.select(F.col("q").alias("cid"), F.lit(9).alias("type"), F.array(*corner).alias("nodes"))
    both = F.posexplode(F.array(F.array(corner[0], corner[1], corner[2]), F.array(corner[0], corner[2], corner[3]))).alias("t", "nodes")
    return points, c.select("q", both).select((F.col("q") * 2 + F.col("t")).alias("cid"), F.lit(5).alias("type"), "nodes")


def faces(cells: DataFrame) -> DataFrame:
    """(cid, face, nodes, key): faces of three-dimensional cells; key is the sorted nodes, equal for both sides. Polyhedra
    have theirs in a column stream."""
    lists = F.when(F.col("type") == POLYHEDRON, F.col("stream")) if "stream" in cells.columns else F.lit(None).cast("array<array<long>>")
    for kind, local in FACES.items():
        lists = F.when(F.col("type") == kind, F.array(*[F.array(*[F.get("nodes", F.lit(k)) for k in f]) for f in local])).otherwise(lists)
    out = cells.select(*[c for c in cells.columns if c not in ("nodes", "stream")], F.posexplode(lists).alias("face", "nodes"))
    return out.withColumn("key", F.array_sort("nodes"))


def boundary(cells: DataFrame) -> DataFrame:
    """Faces that one cell has: the count rides on the aggregate that finds them, and nothing joins back. Faces are dealt by
    their key first: an aggregate of what a task reads would sort all of its faces and save at most half of them."""
    f = faces(cells).repartition("key")
    return f.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct("cid", "face", "nodes")).alias("f")).where("n = 1").select("f.cid", "f.face", "f.nodes")


def interface(cells: DataFrame, label: str) -> DataFrame:
    """(cid, face, nodes, other): faces between two labels, from the side of the lesser one."""
    f = faces(cells)
    sides = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "cid", "face", "nodes")))  # two entries at most
    g = f.groupBy("key").agg(sides.alias("s")).where("size(s) = 2 AND s[0].l <> s[1].l")
    return g.select(F.col("s")[0]["cid"].alias("cid"), F.col("s")[0]["face"].alias("face"), F.col("s")[0]["nodes"].alias("nodes"), F.col("s")[1]["cid"].alias("other"))


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by shuffle and merge. Spark plans the size of exploded rows from that of the compressed file they come from and
    would broadcast meshes of any size, through the driver."""
    return left.join(right.hint("merge"), key, how)


def with_corners(cells: DataFrame, points: DataFrame) -> DataFrame:
    """cells with `at`, the array of the nodes' coordinates in node order; one join on node ids."""
    keep = cells.columns
    each = joined(cells.select("cid", F.posexplode("nodes").alias("k", "pid")), points, "pid")
    at = each.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))).alias("at"))
    return joined(cells, at, "cid").select(*keep, "at")


def _sub(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]


def _cross(u, v):
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def polygon_vector(at: Column) -> tuple[Column, Column, Column]:
    """Vector area of a polygon: half the sum of cross products around its first corner."""
    fan = F.sequence(F.lit(1), F.size(at) - 2)
    first = F.get(at, F.lit(0))

    def part(axis: int) -> Column:
        return F.aggregate(fan, F.lit(0.0), lambda acc, k: acc + 0.5 * _cross(_sub(F.get(at, k), first), _sub(F.get(at, k + 1), first))[axis])

    return part(0), part(1), part(2)


def areas(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, area) of two-dimensional cells."""
    c = with_corners(cells, points)
    x, y, z = polygon_vector(F.col("at"))
    return c.select("cid", F.sqrt(x * x + y * y + z * z).alias("area"))


def volumes(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, volume) by the divergence theorem: a third of each face's centre times its vector area."""
    f = faces(cells).select((F.col("cid") * FACES_MOST + F.col("face")).alias("cid"), F.col("cid").alias("own"), "nodes")
    f = with_corners(f, points)
    vec = polygon_vector(F.col("at"))
    n = F.size("at")
    mid = [F.aggregate(F.col("at")[k], F.lit(0.0), lambda a, v: a + v) / n for k in ("x", "y", "z")]
    part = sum((m * v for m, v in zip(mid, vec, strict=True)), F.lit(0.0)) / 3
    return f.groupBy(F.col("own").alias("cid")).agg(F.sum(part).alias("volume"))


def as_polyhedra(cells: DataFrame) -> DataFrame:
    """Three-dimensional cells of any type as polyhedra: (cid, type, nodes, stream, further columns)."""
    kept = [c for c in cells.columns if c not in ("cid", "type", "nodes", "stream")]
    stream = F.transform(F.array_sort(F.collect_list(F.struct("face", "nodes"))), lambda f: f["nodes"]).alias("stream")  # a cell's faces
    out = faces(cells).groupBy("cid").agg(stream).withColumns({"type": F.lit(POLYHEDRON), "nodes": F.array_sort(F.array_distinct(F.flatten("stream")))})
    return joined(out, cells.select("cid", *kept), "cid").select("cid", "type", "nodes", "stream", *kept)


def tetrahedra(cells: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, cells): each three-dimensional cell cut into tetrahedra between its centre and the triangles of its faces.

    A centre is the mean of a cell's nodes and has the id -1 - cid (ids of cells and points are not negative). The new
    cells (cid, type, nodes, parent) are turned to a positive volume. A face is a fan from its first node; cells must be
    seen whole from their centre.
    """
    f = faces(cells).select("cid", "face", "nodes")
    nodes = joined(f.select("cid", F.explode("nodes").alias("pid")).distinct(), points, "pid")
    centre = nodes.groupBy((-1 - F.col("cid")).alias("pid")).agg(*[F.avg(a).alias(a) for a in ("x", "y", "z")])
    every = points.select("pid", "x", "y", "z").unionByName(centre)
    fan = F.transform(F.sequence(F.lit(1), F.size("nodes") - 2), lambda k: F.array(F.get("nodes", F.lit(0)), F.get("nodes", k), F.get("nodes", k + 1), -1 - F.col("cid")))
    tets = f.where("size(nodes) > 2").select("cid", "face", F.posexplode(fan).alias("k", "nodes"))
    tets = tets.select(((F.col("cid") * FACES_MOST + F.col("face")) * FACES_MOST + F.col("k")).alias("cid"), F.lit(10).alias("type"), "nodes", F.col("cid").alias("parent"))
    at = with_corners(tets, every)
    turned = F.when(_tet(F.col("at")) < 0, F.array(*[F.get("nodes", F.lit(k)) for k in (1, 0, 2, 3)])).otherwise(F.col("nodes"))
    return every, at.select("cid", "type", turned.alias("nodes"), "parent")


def _tet(at: Column) -> Column:
    """The signed volume of four corners."""
    a, b, c, d = (F.get(at, F.lit(k)) for k in range(4))
    n = _cross(_sub(b, a), _sub(c, a))
    return sum((u * v for u, v in zip(n, _sub(d, a), strict=True)), F.lit(0.0)) / 6


def split_volumes(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, volume, x, y, z) of cells of any type, whichever way their faces turn: from the tetrahedra about their centre, with the centre of mass."""
    every, tets = tetrahedra(cells, points)
    at = with_corners(tets, every).withColumn("v", F.abs(_tet(F.col("at"))))
    mid = lambda a: F.aggregate(F.col("at")[a], F.lit(0.0), lambda s, v: s + v) / 4
    return at.groupBy(F.col("parent").alias("cid")).agg(F.sum("v").alias("volume"), *[(F.sum(F.col("v") * mid(a)) / F.sum("v")).alias(a) for a in ("x", "y", "z")])


def centroids(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, x, y, z): mean of the nodes."""
    return joined(cells.select("cid", F.explode("nodes").alias("pid")), points, "pid").groupBy("cid").agg(*[F.avg(a).alias(a) for a in ("x", "y", "z")])


def load_vector(cells: DataFrame, points: DataFrame, density: str) -> DataFrame:
    """(pid, load): a cell density integrated to the nodes, each corner of a simplex taking its share."""
    a = areas(cells, points)
    share = joined(cells, a, "cid").select(F.explode("nodes").alias("pid"), (F.col(density) * F.col("area") / F.size("nodes")).alias("v"))
    return share.groupBy("pid").agg(F.sum("v").alias("load"))


def clip(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another (counter-clockwise) one, half-plane by half-plane."""
    out = subject
    for a, b in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for k in range(len(out)):
            j = (k + 1) % len(out)
            if side[k] >= 0:
                kept.append(out[k])
            if side[k] * side[j] < 0:
                t = side[k] / (side[k] - side[j])
                kept.append(out[k] + t * (out[j] - out[k]))
        out = np.array(kept).reshape(-1, 2)
    return out


def moments(poly: np.ndarray) -> tuple[float, np.ndarray]:
    """Signed area and centroid of a polygon."""
    if len(poly) < 3:
        return 0.0, np.zeros(2)
    d = poly - poly[0]
    cross = d[1:-1, 0] * d[2:, 1] - d[1:-1, 1] * d[2:, 0]
    area = float(cross.sum() / 2)
    centre = poly[0] + ((d[1:-1] + d[2:]) * cross[:, None]).sum(0) / 6 / area if area else poly[0]
    return area, centre


def padded(polygons: pd.Series) -> np.ndarray:
    """Flat corner lists as one array (polygons, corners, 2); shorter ones repeat their first corner, which changes no area."""
    size = max(map(len, polygons))
    return np.array([[*p, *list(p[:2]) * ((size - len(p)) // 2)] for p in polygons], float).reshape(len(polygons), -1, 2)


def overlap_areas(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """Areas of the parts of polygons inside convex ones, pair by pair: `clip` and `moments` of a whole batch at once."""
    rows = np.arange(len(subject))[:, None]
    out, count = subject, np.full(len(subject), subject.shape[1])
    for j in range(convex.shape[1]):
        a, b = convex[:, j, None], convex[:, (j + 1) % convex.shape[1], None]
        at = np.arange(out.shape[1])
        after = np.where(at + 1 < count[:, None], at + 1, 0)
        side = (b[..., 0] - a[..., 0]) * (out[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (out[..., 0] - a[..., 0])
        held = at < count[:, None]
        cross = held & (side * side[rows, after] < 0)
        share = side / np.where(cross, side - side[rows, after], 1.0)
        points = np.stack([out, out + share[..., None] * (out[rows, after] - out)], 2).reshape(len(out), -1, 2)
        kept = np.stack([held & (side >= 0), cross], 2).reshape(len(out), -1)
        count = kept.sum(1)
        order = np.argsort(~kept, 1, kind="stable")[:, : max(int(count.max(initial=0)), 1)]
        out = points[rows, order]
    d = np.where((np.arange(out.shape[1]) < count[:, None])[..., None], out - out[:, :1], 0.0)
    return np.abs((d[:, 1:-1, 0] * d[:, 2:, 1] - d[:, 1:-1, 1] * d[:, 2:, 0]).sum(1) / 2)


def transfer(sources: DataFrame, targets: DataFrame, cell: float) -> DataFrame:
    """(target, plus, minus, area, missed): heat of planar source cells (cid, at, q) on target cells (cid, at), conserved.

    Candidate pairs are an equi-join of bounding boxes on a grid of the given cell size; each is clipped in its task.
    Positive and negative flux stay apart. A source's heat is shared by overlap area, so that nothing is dropped while it
    overlaps any target; sources that overlap none are rows with a null target.
    """
    box = lambda df: df.select(F.col("cid").alias("id"), *[f(F.col("at")[a]).alias(f"{a}_{m}") for a in ("x", "y") for m, f in (("lo", F.array_min), ("hi", F.array_max))])
    from gramlake.operators.joins import box_pairs

    pairs = box_pairs(box(sources), box(targets), ["x", "y"], [cell, cell])
    flat = lambda c: F.flatten(F.transform(c, lambda v: F.array(v["x"], v["y"])))
    rows = joined(joined(pairs, sources.select(F.col("cid").alias("ida"), flat(F.col("at")).alias("a")), "ida"), targets.select(F.col("cid").alias("idb"), flat(F.col("at")).alias("b")), "idb")

    def overlap(batches):
        for p in batches:
            if not len(p):
                continue
            p["overlap"] = overlap_areas(padded(p["a"]), padded(p["b"]))
            yield p.loc[p["overlap"] > 0, ["ida", "idb", "overlap"]]

    pieces = rows.select("ida", "idb", "a", "b").mapInPandas(overlap, "ida long, idb long, overlap double")
    total = pieces.groupBy("ida").agg(F.sum("overlap").alias("total"))
    vec = polygon_vector(F.col("at"))[2]
    heat = sources.select(F.col("cid").alias("ida"), F.abs(vec).alias("size"), "q")
    share = joined(joined(heat, total, "ida", "left"), pieces, "ida", "left")
    part = F.coalesce(F.col("overlap") / F.col("total"), F.lit(1.0)) * F.col("size")
    return share.groupBy(F.col("idb").alias("target")).agg(F.sum(part * F.greatest("q", F.lit(0.0))).alias("plus"), F.sum(part * F.least("q", F.lit(0.0))).alias("minus"), F.sum("overlap").alias("area"), F.count_if(F.col("overlap").isNull()).alias("missed"))


def heat_capacity(t: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear cp(T), constant outside its table."""
    out = F.lit(float(table[-1][1]))
    for (t0, c0), (t1, c1) in reversed(list(zip(table, table[1:], strict=False))):
        out = F.when(t <= t1, F.lit(float(c0)) + (t - t0) * ((c1 - c0) / (t1 - t0))).otherwise(out)
    return F.when(t <= table[0][0], F.lit(float(table[0][1]))).otherwise(out)


def heat_energy(t: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Exact integral of cp from the table's first temperature."""
    t0, c0 = table[0]
    out = F.least(t - t0, F.lit(0.0)) * c0
    for (ta, ca), (tb, cb) in zip(table, table[1:], strict=False):
        u = F.least(F.greatest(t - ta, F.lit(0.0)), F.lit(float(tb - ta)))
        out = out + u * ca + u * u * ((cb - ca) / (tb - ta) / 2)
    return out + F.greatest(t - table[-1][0], F.lit(0.0)) * table[-1][1]


def relax(state: DataFrame, proposed: str, current: str, factor: float) -> Column:
    """Relaxed fixed-point step; missing entries keep the current value."""
    return F.when(F.col(proposed).isNull() | F.isnan(proposed), F.col(current)).otherwise(F.col(current) + factor * (F.col(proposed) - F.col(current)))


# queries


#: Columns and rows of the lattices on which queries lay the rows of a table.
COLUMNS, ROWS = 20, 10


def _graded(k: Column) -> tuple[Column, Column, Column]:
    """Coordinates of a lattice node by its number: steps that grow along x and y, even ones along z."""
    nx, ny = COLUMNS + 1, ROWS + 1
    i, j, h = k % nx, F.floor(k / nx) % ny, F.floor(k / (nx * ny))
    return (i * (i + 20) * 0.05).alias("x"), (j * (j + 10) * 0.1).alias("y"), (h * 0.25).alias("z")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (cid, ..) dealt to all tasks before they become many: a small file is read by a few."""
    return rows.repartition("cid")


def _part_boxes(s, d):
    """Hexahedra where parts of some size lie on a lattice, so that the mesh has holes as the table has them."""
    part = _dealt(table(s, d, "part").where("p_size > 8").select(F.col("p_partkey").alias("cid"), (F.col("p_size") % 3).alias("label")))
    nx, ny = COLUMNS + 1, ROWS + 1
    i, j, h = F.col("cid") % COLUMNS, F.floor(F.col("cid") / COLUMNS) % ROWS, F.floor(F.col("cid") / (COLUMNS * ROWS))
    at = lambda a, b, c: ((i + a) + nx * ((j + b) + ny * (h + c))).cast("long")
    nodes = F.array(at(0, 0, 0), at(1, 0, 0), at(1, 1, 0), at(0, 1, 0), at(0, 0, 1), at(1, 0, 1), at(1, 1, 1), at(0, 1, 1))
    cells = part.select("cid", F.lit(12).alias("type"), nodes.alias("nodes"), "label")
    points = cells.select(F.explode("nodes").alias("pid")).distinct().select("pid", *_graded(F.col("pid")))
    return points, cells


def _part_plates(s, d):
    """Quadrilaterals of a plane on the same lattice, without holes' parts, and the price as their density."""
    part = _dealt(table(s, d, "part").where("p_size > 8").select(F.col("p_partkey").alias("cid"), F.col("p_retailprice").alias("q")))
    nx = COLUMNS + 1
    a = (F.col("cid") % COLUMNS + nx * F.floor(F.col("cid") / COLUMNS)).cast("long")
    cells = part.select("cid", F.lit(9).alias("type"), F.array(a, a + 1, a + nx + 1, a + nx).alias("nodes"), "q")
    i, j = F.col("pid") % nx, F.floor(F.col("pid") / nx)
    points = cells.select(F.explode("nodes").alias("pid")).distinct().select("pid", (i * (i + 20) * 0.05).alias("x"), (j * 0.5).alias("y"), F.lit(0.0).alias("z"))
    return points, cells


def _rectangles(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, *more: Column) -> DataFrame:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return df.select("cid", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("at"), *more)


def _q_boundary(s, d):
    _, c = _part_boxes(s, d)
    return boundary(c).select("cid", "face", F.array_join(F.array_sort("nodes"), ",").alias("key"))


def _q_interface(s, d):
    _, c = _part_boxes(s, d)
    return interface(c, "label").select("cid", "face", "other")


def _q_volume(s, d):
    p, c = _part_boxes(s, d)
    return volumes(c, p).select("cid", F.round("volume", 8).alias("volume"))


def _q_centroid(s, d):
    p, c = _part_boxes(s, d)
    return centroids(c, p).select("cid", *[F.round(a, 8).alias(a) for a in ("x", "y", "z")])


def _q_area(s, d):
    p, c = _part_plates(s, d)
    return areas(c, p).select("cid", F.round("area", 8).alias("area"))


def _q_load(s, d):
    p, c = _part_plates(s, d)
    return load_vector(c, p, "q").select("pid", F.round("load", 6).alias("load"))


def _q_flux(s, d):
    part = table(s, d, "part").where("p_size > 8").select(F.col("p_partkey").alias("cid"), (F.col("p_retailprice") - 1400).alias("q"))
    i, j = (F.col("cid") % 40).cast("double"), F.floor(F.col("cid") / 40).cast("double")
    plates = table(s, d, "supplier").select(F.col("s_suppkey").alias("cid"))
    u, v = F.col("cid") % 10 * 4.1, F.floor(F.col("cid") / 10) * 5.3
    out = transfer(_rectangles(part, i, i + 1, j, j + 1, F.col("q")), _rectangles(plates, u + 1.5, u + 5.6, v, v + 5.3), 4.0)
    return out.select("target", F.round("plus", 5).alias("plus"), F.round("minus", 5).alias("minus"), F.round("area", 7).alias("area"), "missed")


_CP = [(300.0, 1000.0), (800.0, 1500.0), (2000.0, 1800.0)]


def _q_energy(s, d):
    t = F.col("p_size") * 45.0 + F.col("p_retailprice") % 100 - 100
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.round(heat_capacity(t, _CP), 6).alias("cp"), F.round(heat_energy(t, _CP), 6).alias("e"))


def _houses(s, d):
    """A house a part: a box with a roof, of which faces turn one way or the other by the part's key; neighbours share no nodes."""
    part = _dealt(table(s, d, "part").select(F.col("p_partkey").alias("cid"), (F.col("p_size") / 5 + 1).alias("w"), (F.col("p_retailprice") / 500).alias("l"), (F.col("p_partkey") % 7 + 1.0).alias("h"), (F.col("p_partkey") % 3 / 2 + 0.5).alias("r")))
    corners = [(x, y, z) for y in (0, 1) for x, z in ((0, 0), (1, 0), (1, 1), (0.5, 2), (0, 1))]  # x and y in shares, z: floor, eaves, ridge
    height = {0: F.lit(0.0), 1: F.col("h"), 2: F.col("h") + F.col("r")}
    points = part.select(F.inline(F.array(*[F.struct((F.col("cid") * 10 + k).alias("pid"), (F.lit(float(x)) * F.col("w") + F.col("cid") % 50 * 20).alias("x"), (F.lit(float(y)) * F.col("l")).alias("y"), height[z].alias("z")) for k, (x, y, z) in enumerate(corners)])))
    sides = [(0, 1, 2, 3, 4), (5, 6, 7, 8, 9), *[(k, (k + 1) % 5, (k + 1) % 5 + 5, k + 5) for k in range(5)]]
    stream = F.array(*[F.array(*[(F.col("cid") * 10 + k).cast("long") for k in side]) for side in sides])
    turned = F.transform(stream, lambda f, k: F.when((F.col("cid") + k) % 3 == 0, F.reverse(f)).otherwise(f))
    return points, part.select("cid", F.lit(POLYHEDRON).alias("type"), F.flatten(stream).alias("nodes"), turned.alias("stream"))


def _q_polyhedra(s, d):
    p, c = _houses(s, d)
    return split_volumes(c, p).select("cid", F.round("volume", 6).alias("volume"), *[F.round(a, 6).alias(a) for a in ("x", "y", "z")])


def _q_as_polyhedra(s, d):
    p, c = _part_boxes(s, d)
    c = as_polyhedra(c)
    inner = interface(c, "label").groupBy("cid").agg(F.count("*").alias("faces"))
    return split_volumes(c, p).select("cid", F.round("volume", 8).alias("volume")).join(inner.hint("merge"), "cid", "left").select("cid", "volume", F.coalesce("faces", F.lit(0).cast("long")).alias("faces"))


QUERIES = {"polyhedra_volume": _q_polyhedra, "polyhedra_of_boxes": _q_as_polyhedra, "boundary_faces": _q_boundary, "interface_faces": _q_interface, "mesh_volume": _q_volume, "mesh_centroids": _q_centroid, "mesh_area": _q_area, "mesh_load_vector": _q_load, "flux_conserve": _q_flux, "material_energy": _q_energy}
_X, _Y = "({0} * ({0} + 20) * 0.05::DOUBLE)", "({0} * ({0} + 10) * 0.1::DOUBLE)"
_C = f"c AS (SELECT p_partkey AS cid, p_partkey % {COLUMNS} AS a, p_partkey // {COLUMNS} % {ROWS} AS b, p_partkey // {COLUMNS * ROWS} AS h, p_size % 3 AS label FROM part WHERE p_size > 8)"
_N = f"{_C}, f AS (SELECT * FROM (VALUES (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) v(face, u, v, w))"
_G = "(a + {0} + 21 * ((b + {1}) + 11 * (h + {2})))"
_KEY = "CASE " + " ".join(f"WHEN face = {k} THEN list_sort([{', '.join(_G.format(*c) for c in corners)}])" for k, corners in enumerate((((0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1)), ((1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1)), ((0, 0, 0), (1, 0, 0), (0, 0, 1), (1, 0, 1)), ((0, 1, 0), (1, 1, 0), (0, 1, 1), (1, 1, 1)), ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)), ((0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1))))) + " END"
_W = f"w AS (SELECT p_partkey AS cid, p_partkey % {COLUMNS} AS a, p_partkey // {COLUMNS} AS b, p_retailprice AS q FROM part WHERE p_size > 8)"
_AREA = f"({_X.format('(a + 1)')} - {_X.format('a')}) * 0.5"
SQL = {
    "polyhedra_volume": "WITH p AS (SELECT p_partkey AS cid, p_size / 5 + 1 AS w, p_retailprice / 500 AS l, p_partkey % 7 + 1.0::DOUBLE AS h, p_partkey % 3 / 2 + 0.5::DOUBLE AS r FROM part) SELECT cid, round((w * h + w * r / 2) * l, 6) AS volume, round(w / 2 + cid % 50 * 20, 6) AS x, round(l / 2, 6) AS y, round((w * h * h / 2 + w * r / 2 * (h + r / 3)) / (w * h + w * r / 2), 6) AS z FROM p",
    "polyhedra_of_boxes": f"WITH {_N}, i AS (SELECT c.cid, count(*) AS faces FROM c CROSS JOIN f JOIN c o ON o.a = c.a + u AND o.b = c.b + v AND o.h = c.h + w WHERE c.label < o.label GROUP BY 1) SELECT c.cid, round(({_X.format('(a + 1)')} - {_X.format('a')}) * ({_Y.format('(b + 1)')} - {_Y.format('b')}) * 0.25, 8) AS volume, coalesce(faces, 0) AS faces FROM c LEFT JOIN i ON c.cid = i.cid",
    "boundary_faces": f"WITH {_N} SELECT c.cid, face::INTEGER AS face, array_to_string({_KEY.replace('(a +', '(c.a +').replace('((b +', '((c.b +').replace('(h +', '(c.h +')}, ',') AS key FROM c CROSS JOIN f LEFT JOIN c o ON o.a = c.a + u AND o.b = c.b + v AND o.h = c.h + w WHERE o.cid IS NULL",
    "interface_faces": f"WITH {_N} SELECT c.cid, face::INTEGER AS face, o.cid AS other FROM c CROSS JOIN f JOIN c o ON o.a = c.a + u AND o.b = c.b + v AND o.h = c.h + w WHERE c.label < o.label",
    "mesh_volume": f"WITH {_C} SELECT cid, round(({_X.format('(a + 1)')} - {_X.format('a')}) * ({_Y.format('(b + 1)')} - {_Y.format('b')}) * 0.25, 8) AS volume FROM c",
    "mesh_centroids": f"WITH {_C} SELECT cid, round(({_X.format('(a + 1)')} + {_X.format('a')}) / 2, 8) AS x, round(({_Y.format('(b + 1)')} + {_Y.format('b')}) / 2, 8) AS y, round((h + 0.5::DOUBLE) * 0.25, 8) AS z FROM c",
    "mesh_area": f"WITH {_W} SELECT cid, round({_AREA}, 8) AS area FROM w",
    "mesh_load_vector": f"WITH {_W} SELECT a + da + 21 * (b + db) AS pid, round(sum(q * {_AREA} / 4), 6) AS load FROM w, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(da, db) GROUP BY 1",
    "flux_conserve": "WITH s AS (SELECT p_partkey AS id, (p_partkey % 40)::DOUBLE AS x, (p_partkey // 40)::DOUBLE AS y, p_retailprice - 1400 AS q FROM part WHERE p_size > 8), g AS (SELECT s_suppkey AS target, s_suppkey % 10 * 4.1::DOUBLE + 1.5 AS u, s_suppkey // 10 * 5.3::DOUBLE AS v FROM supplier), o AS (SELECT id, target, (least(x + 1, u + 4.1) - greatest(x, u)) * (least(y + 1, v + 5.3) - greatest(y, v)) AS o FROM s JOIN g ON x < u + 4.1 AND u < x + 1 AND y < v + 5.3 AND v < y + 1), k AS (SELECT *, sum(o) OVER (PARTITION BY id) AS t FROM o WHERE o > 1e-9), r AS (SELECT target, q, coalesce(o / t, 1) AS part, o FROM s LEFT JOIN k USING (id)) SELECT target, round(sum(part * greatest(q, 0)), 5) AS plus, round(sum(part * least(q, 0)), 5) AS minus, round(sum(o), 7) AS area, count(*) FILTER (o IS NULL) AS missed FROM r GROUP BY target",
    "material_energy": "WITH t AS (SELECT p_partkey AS id, p_size * 45.0::DOUBLE + p_retailprice % 100 - 100 AS t FROM part) SELECT id, round(CASE WHEN t <= 300 THEN 1000 WHEN t <= 800 THEN 1000 + (t - 300) WHEN t <= 2000 THEN 1500 + (t - 800) * 0.25 ELSE 1800 END, 6)::DOUBLE AS cp, round(CASE WHEN t <= 300 THEN (t - 300) * 1000 WHEN t <= 800 THEN (t - 300) * (2000 + (t - 300)) / 2 WHEN t <= 2000 THEN 625000 + (t - 800) * (3000 + (t - 800) * 0.25) / 2 ELSE 2605000 + (t - 2000) * 1800 END, 6)::DOUBLE AS e FROM t",
}
