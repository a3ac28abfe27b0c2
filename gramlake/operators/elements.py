"""Finite elements on mesh tables: element library, quadrature, triangulation, curved surfaces, field reconstruction and the
way back from an overlap transfer."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions import numerics
from gramlake.operators.mesh import DIMENSION, FACES, areas, box_mesh, clip, heat_capacity, heat_energy, moments, plane_mesh, polygon_vector, volumes, with_corners
from gramlake.session import saved, table

#: VTK numbers of the element types, with their dimension, nodes and the rule of their reference shape.
KINDS = {
    3: ("line", 1, 2), 5: ("triangle", 2, 3), 9: ("quad", 2, 4), 10: ("tetra", 3, 4), 12: ("hexahedron", 3, 8), 13: ("wedge", 3, 6), 14: ("pyramid", 3, 5),
    21: ("quadratic line", 1, 3), 22: ("quadratic triangle", 2, 6), 23: ("quadratic quad", 2, 8), 24: ("quadratic tetra", 3, 10), 25: ("quadratic hexahedron", 3, 20),
}
#: Edges whose middles are the further nodes of quadratic elements, in their order.
EDGES = {
    21: ((0, 1),), 22: ((0, 1), (1, 2), (2, 0)), 23: ((0, 1), (1, 2), (2, 3), (3, 0)), 24: ((0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)),
    25: ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)),
}
_CORNERS = {
    3: [[-1], [1]], 5: [[0, 0], [1, 0], [0, 1]], 9: [[-1, -1], [1, -1], [1, 1], [-1, 1]], 10: [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]],
    12: [[-1, -1, -1], [1, -1, -1], [1, 1, -1], [-1, 1, -1], [-1, -1, 1], [1, -1, 1], [1, 1, 1], [-1, 1, 1]],
    13: [[0, 0, -1], [1, 0, -1], [0, 1, -1], [0, 0, 1], [1, 0, 1], [0, 1, 1]], 14: [[-1, -1, 0], [1, -1, 0], [1, 1, 0], [-1, 1, 0], [0, 0, 1]],
}
_LINEAR = {21: 3, 22: 5, 23: 9, 24: 10, 25: 12}
_RULES = {3: numerics.line_rule, 5: numerics.triangle_rule, 9: numerics.square_rule, 10: numerics.tetra_rule, 12: numerics.cube_rule, 13: numerics.wedge_rule, 14: numerics.pyramid_rule}


@dataclass(frozen=True)
class Element:
    kind: int

    @property
    def dimension(self) -> int:
        return KINDS[self.kind][1]

    @property
    def nodes(self) -> np.ndarray:
        """Reference places of the nodes: corners, then the edges' middles."""
        c = np.array(_CORNERS[_LINEAR.get(self.kind, self.kind)], float)
        return np.vstack([c, *[(c[a] + c[b])[None] / 2 for a, b in EDGES.get(self.kind, ())]])

    def _powers(self) -> list[tuple[int, ...]]:
        base = _LINEAR.get(self.kind, self.kind)
        quad = self.kind in EDGES
        if base in (5, 10):
            n = self.dimension
            return [e for e in np.ndindex(*[3 if quad else 2] * n) if sum(e) <= (2 if quad else 1)]
        if base == 13:
            return [(a, b, c) for a, b in ((0, 0), (1, 0), (0, 1)) for c in (0, 1)]
        full = list(np.ndindex(*[3 if quad else 2] * self.dimension))
        # serendipity: at most one exponent of two
        return [e for e in full if sum(x == 2 for x in e) <= 1] if quad else full

    def shape(self, at: np.ndarray) -> np.ndarray:
        """Shape functions (points, nodes): one at their node, zero at the others."""
        at = np.asarray(at, float).reshape(-1, self.dimension)
        if self.kind == 14:
            x, y, z = at.T
            t = np.where(np.abs(1 - z) < 1e-14, 1e-14, 1 - z)
            corners = [(t + sx * x) * (t + sy * y) / (4 * t) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            return np.stack([*corners, z], 1)
        terms = lambda p: np.stack([np.prod(p ** np.array(e), 1) for e in self._powers()], 1)
        return terms(at) @ np.linalg.inv(terms(self.nodes))

    def gradient(self, at: np.ndarray) -> np.ndarray:
        """Derivatives by the reference axes (points, nodes, axes), by central differences (exact to rounding for polynomials)."""
        at = np.asarray(at, float).reshape(-1, self.dimension)
        out = []
        for k in range(self.dimension):
            h = 1e-4 * np.eye(self.dimension)[k]
            out.append((self.shape(at + h) - self.shape(at - h)) / 2e-4)
        return np.stack(out, -1)

    def rule(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        return _RULES[_LINEAR.get(self.kind, self.kind)](order)

    @property
    def faces(self) -> tuple[tuple[int, ...], ...]:
        return FACES.get(_LINEAR.get(self.kind, self.kind), ())


def element(kind: int) -> Element:
    if kind not in KINDS:
        raise ValueError(f"no element of type {kind}; there are {supported_types()}")
    return Element(kind)


def supported_types() -> list[int]:
    return sorted(KINDS)


def cell_dimension(kind: int) -> int:
    return 2 if kind == 7 else 3 if kind == 42 else KINDS[kind][1]


# tables of cells


def dimension_column(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k in [*KINDS, 7]:
        out = F.when(kind == k, cell_dimension(k)).otherwise(out)
    return out


def sizes(cells: DataFrame) -> DataFrame:
    """(cid, size, dimension): number of nodes and dimension of every cell."""
    return cells.select("cid", F.size("nodes").alias("size"), dimension_column(F.col("type")).alias("dimension"))


def cell(cells: DataFrame, cid: int) -> DataFrame:
    """(k, pid): a cell's nodes in order."""
    return cells.where(F.col("cid") == cid).select(F.posexplode("nodes").alias("k", "pid"))


def blocks(cells: DataFrame) -> dict[int, DataFrame]:
    """Cells (cid, nodes) by type."""
    return {r["type"]: cells.where(F.col("type") == r["type"]).select("cid", "nodes") for r in cells.select("type").distinct().collect()}


def from_blocks(spark: SparkSession, parts: Sequence[tuple[int, Sequence[Sequence[int]]]]) -> DataFrame:
    """Cells of (type, node lists) blocks, numbered in turn."""
    rows = [(kind, list(map(int, nodes))) for kind, block in parts for nodes in block]
    return spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(rows)], "cid long, type int, nodes array<long>")


def summary(points: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: points, cells, cells by type, bounds, total measure of the cells of the highest dimension."""
    dim = cells.agg(F.max(dimension_column(F.col("type"))).alias("d")).first()["d"]
    own = cells.where(dimension_column(F.col("type")) == dim)
    measure = (volumes(own, points).agg(F.sum("volume").alias("measure")) if dim == 3 else areas(own, points).agg(F.sum("area").alias("measure")))
    kinds = cells.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.sum("n").alias("cells"))
    box = points.agg(F.count("*").alias("points"), *[f(a).alias(f"{a}_{n}") for a in ("x", "y", "z") for n, f in (("lo", F.min), ("hi", F.max))])
    # three tables of one row each
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(box).join(one(kinds), "_one").join(one(measure), "_one").drop("_one")


def triangulated(cells: DataFrame) -> DataFrame:
    """(cid, parent, type, nodes): two-dimensional cells as fans of triangles around their first node; others are left out."""
    corner = F.when(F.col("type").isin(22, 23), F.slice("nodes", 1, (F.size("nodes") / 2).cast("int"))).otherwise(F.col("nodes"))
    fan = F.transform(F.sequence(F.lit(1), F.size(corner) - 2), lambda k: F.array(F.get(corner, F.lit(0)), F.get(corner, k), F.get(corner, k + 1)))
    flat = cells.where(F.col("type").isin(5, 7, 9, 22, 23)).select(F.col("cid").alias("parent"), F.posexplode(fan).alias("t", "nodes"))
    # ids: the parent's, and the triangle's place in its fan
    return flat.select((F.col("parent") * 64 + F.col("t")).alias("cid"), "parent", F.lit(5).alias("type"), "nodes")


def quadrature(cells: DataFrame, points: DataFrame, order: int = 2) -> DataFrame:
    """(cid, q, x, y, z, weight, shape array): quadrature points of every cell, weights in physical measure, and the shape
    functions that carry nodal values there."""
    at = with_corners(cells.where(F.col("type").isin(list(KINDS))), points)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, g in b.groupby("type"):
                e = element(int(kind))
                p, w = e.rule(order)
                n, d = e.shape(p), e.gradient(p)
                xyz = np.array([[[v["x"], v["y"], v["z"]] for v in c] for c in g["at"]], float)
                where = np.einsum("qn,cnk->cqk", n, xyz)
                jac = np.einsum("qnd,cnk->cqkd", d, xyz)
                gram = np.einsum("cqkd,cqke->cqde", jac, jac)
                size = np.sqrt(np.maximum(np.linalg.det(gram), 0)) * w
                c, q = size.shape
                yield pd.DataFrame({"cid": np.repeat(g["cid"].to_numpy(), q), "q": np.tile(np.arange(q), c), "x": where[..., 0].ravel(), "y": where[..., 1].ravel(), "z": where[..., 2].ravel(), "weight": size.ravel(), "shape": [n[k].tolist() for _ in range(c) for k in range(q)]})

    return at.select("cid", "type", "at").mapInPandas(run, "cid long, q int, x double, y double, z double, weight double, shape array<double>")


def cell_integrals(cells: DataFrame, rule: DataFrame, nodal: DataFrame, value: str) -> DataFrame:
    """(cid, integral) of nodal values (pid, value): each node's share of a cell, then one join."""
    share = rule.groupBy("cid").agg(F.collect_list(F.transform("shape", lambda v: v)).alias("_s"), F.collect_list("weight").alias("_w"))
    load = share.select("cid", F.transform(F.sequence(F.lit(0), F.size(F.col("_s")[0]) - 1), lambda k: F.aggregate(F.zip_with("_s", "_w", lambda s, w: F.get(s, k) * w), F.lit(0.0), lambda a, v: a + v)).alias("load"))
    each = cells.join(load, "cid").select("cid", F.posexplode(F.arrays_zip("nodes", "load")).alias("k", "e")).select("cid", F.col("e.nodes").alias("pid"), F.col("e.load").alias("load"))
    return each.join(nodal.select("pid", F.col(value).alias("_v")), "pid").groupBy("cid").agg(F.sum(F.col("load") * F.col("_v")).alias("integral"))


def integrate(cells: DataFrame, rule: DataFrame, nodal: DataFrame, value: str) -> DataFrame:
    return cell_integrals(cells, rule, nodal, value).agg(F.sum("integral").alias("integral"))


# generated meshes


def _sphere_points(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """Corner rows (pid, u, v, w in [-1, 1]^3 on a cube's surface) and quads (cid, nodes): shared corners have one id."""
    side = n + 1
    # a surface corner's id is its place in the whole grid of (n + 1)^3
    faces = []
    quads = spark.range(6 * n * n).withColumnRenamed("id", "cid")
    f, r = F.floor(F.col("cid") / (n * n)), F.col("cid") % (n * n)
    i, j = r % n, F.floor(r / n)
    for axis in range(3):
        for end in (0, n):
            corner = []
            for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)) if end else ((0, 0), (0, 1), (1, 1), (1, 0)):
                at = [None] * 3
                at[axis], at[(axis + 1) % 3], at[(axis + 2) % 3] = F.lit(end), i + a, j + b
                corner.append((at[0] + side * (at[1] + side * at[2])).cast("long"))
            faces.append(F.array(*corner))
    nodes = faces[0]
    for k in range(1, 6):
        nodes = F.when(f == k, faces[k]).otherwise(nodes)
    cells = quads.select("cid", F.lit(9).alias("type"), nodes.alias("nodes"))
    p = spark.range(side**3).withColumnRenamed("id", "pid")
    at = [F.col("pid") % side, F.floor(F.col("pid") / side) % side, F.floor(F.col("pid") / side**2)]
    on = F.lit(False)
    for a in at:
        on |= (a == 0) | (a == n)
    # equal angles on each face
    return p.where(on).select("pid", *[F.tan((a / n * 2 - 1) * (math.pi / 4)).alias(c) for a, c in zip(at, "uvw", strict=True)]), cells


def _on_sphere(points: DataFrame, radius: Column) -> DataFrame:
    r = F.sqrt(sum((F.col(c) ** 2 for c in "uvw"), F.lit(0.0)))
    return points.select("pid", *[(F.col(c) / r * radius).alias(a) for c, a in zip("uvw", "xyz", strict=True)])


def sphere_surface(spark: SparkSession, radius: float = 1.0, n: int = 8, triangles: bool = False) -> tuple[DataFrame, DataFrame]:
    """A sphere of a cube's six faces, n by n quads (or two triangles each), outward."""
    points, cells = _sphere_points(spark, n)
    return _on_sphere(points, F.lit(float(radius))), triangulated(cells).drop("parent") if triangles else cells


def spherical_shell(spark: SparkSession, radii: Sequence[float] = (0.9, 1.0), n: int = 6, layers: Sequence[int] = (2,)) -> tuple[DataFrame, DataFrame]:
    """Hexahedra between spheres: layers[k] of them between radii[k] and radii[k + 1], labelled by k."""
    points, cells = _sphere_points(spark, n)
    steps = [(r0 + (r1 - r0) * j / m, k) for k, (r0, r1, m) in enumerate(zip(radii, radii[1:], layers, strict=False)) for j in range(m)]
    levels = [*(r for r, _ in steps), radii[-1]]
    size = (n + 1) ** 3
    each = points.select("*", F.posexplode(F.array(*[F.lit(float(r)) for r in levels])).alias("level", "radius"))
    out = _on_sphere(each.withColumn("pid", F.col("pid") + F.col("level") * size), F.col("radius"))
    stacked = cells.select("cid", "nodes", F.posexplode(F.array(*[F.lit(k) for _, k in steps])).alias("level", "layer"))
    up = lambda by: F.transform("nodes", lambda v: v + (F.col("level") + by) * size)
    return out, stacked.select((F.col("cid") + F.col("level") * 6 * n * n).alias("cid"), F.lit(12).alias("type"), F.concat(up(0), up(1)).alias("nodes"), "layer")


def box_cells(spark: SparkSession, n: Sequence[int], size: Sequence[float] = (1.0, 1.0, 1.0), kind: str = "tetra") -> tuple[DataFrame, DataFrame]:
    """A structured box of tetrahedra (six a hexahedron around one diagonal) or wedges (two)."""
    points, cells = box_mesh(spark, n, size)
    local = {"tetra": (10, [(0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6)]), "wedge": (13, [(0, 1, 2, 4, 5, 6), (0, 2, 3, 4, 6, 7)])}
    number, parts = local[kind]
    split = F.array(*[F.array(*[F.get("nodes", F.lit(k)) for k in p]) for p in parts])
    out = cells.select("cid", "layer", F.posexplode(split).alias("t", "own"))
    return points, out.select((F.col("cid") * len(parts) + F.col("t")).alias("cid"), F.lit(number).alias("type"), F.col("own").alias("nodes"), "layer")


def orient_polyhedron(points: np.ndarray, faces: Sequence[Sequence[int]]) -> list[list[int]]:
    """The faces of a closed polyhedron turned outward: neighbours run along a shared edge in opposite ways, and the volume is
    positive."""
    faces = [list(f) for f in faces]
    edge = lambda f: list(zip(f, f[1:] + f[:1], strict=True))
    by: dict[frozenset, list[int]] = {}
    for k, f in enumerate(faces):
        for a, b in edge(f):
            by.setdefault(frozenset((a, b)), []).append(k)
    done, todo = {0}, [0]
    while todo:
        k = todo.pop()
        for a, b in edge(faces[k]):
            for other in by[frozenset((a, b))]:
                if other not in done:
                    if (a, b) in edge(faces[other]):
                        faces[other].reverse()
                    done.add(other)
                    todo.append(other)
    volume = 0.0
    for f in faces:
        for b, c in zip(f[1:], f[2:], strict=False):
            volume += np.dot(points[f[0]], np.cross(points[b], points[c]))
    return faces if volume >= 0 else [f[::-1] for f in faces]


# planar geometry with attributes


def clip_half_plane(poly: np.ndarray, attributes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a polygon where side (a value at each vertex, linear between) is not negative, attributes carried along."""
    pts, att = [], []
    n = len(poly)
    for k in range(n):
        j = (k + 1) % n
        if side[k] >= 0:
            pts.append(poly[k])
            att.append(attributes[k])
        if side[k] * side[j] < 0:
            t = side[k] / (side[k] - side[j])
            pts.append(poly[k] + t * (poly[j] - poly[k]))
            att.append(attributes[k] + t * (attributes[j] - attributes[k]))
    return np.array(pts).reshape(-1, poly.shape[1]), np.array(att).reshape(len(pts), *np.shape(attributes)[1:])


def linear_integral(poly: np.ndarray, values: np.ndarray) -> tuple[float, float]:
    """(area, integral) of a field linear on the triangles of a fan from the first vertex."""
    area = total = 0.0
    for b in range(1, len(poly) - 1):
        u, v = poly[b] - poly[0], poly[b + 1] - poly[0]
        a = (u[0] * v[1] - u[1] * v[0]) / 2
        area += a
        total += a * (values[0] + values[b] + values[b + 1]) / 3
    return area, total


def signed_parts(poly: np.ndarray, values: np.ndarray) -> tuple[float, float]:
    """Integrals of the positive and of the negative part of a linear field."""
    out = []
    for sign in (1.0, -1.0):
        p, v = clip_half_plane(poly, values, sign * values)
        out.append(linear_integral(p, v)[1] if len(p) > 2 else 0.0)
    return out[0], out[1]


def triangle_frames(corners: np.ndarray) -> dict[str, np.ndarray]:
    """Of triangles (m, 3, 3): origin, two unit axes in their plane, unit normal and area."""
    u, v = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    normal = np.cross(u, v)
    twice = np.linalg.norm(normal, axis=1)
    e1 = u / np.linalg.norm(u, axis=1)[:, None]
    normal = normal / np.maximum(twice, 1e-300)[:, None]
    return {"origin": corners[:, 0], "e1": e1, "e2": np.cross(normal, e1), "normal": normal, "area": twice / 2}


def normals(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, nx, ny, nz): unit normals of two-dimensional cells."""
    c = with_corners(cells, points)
    x, y, z = polygon_vector(F.col("at"))
    size = F.sqrt(x * x + y * y + z * z)
    return c.select("cid", (x / size).alias("nx"), (y / size).alias("ny"), (z / size).alias("nz"))


def surface_triangles(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(tid, ax..cz): corner coordinates of a surface's triangles, what a closest-point search takes."""
    c = with_corners(triangulated(cells), points)
    return c.select(F.col("cid").alias("tid"), *[F.get("at", F.lit(k))[a].alias(f"{n}{a}") for k, n in enumerate("abc") for a in "xyz"])


# fields on surfaces


def overlap_pieces(sources: DataFrame, targets: DataFrame, cell: float) -> DataFrame:
    """(source, target, overlap): areas that planar cells (cid, at) of two meshes share."""
    from gramlake.operators.joins import box_pairs

    box = lambda df: df.select(F.col("cid").alias("id"), *[f(F.col("at")[a]).alias(f"{a}_{m}") for a in ("x", "y") for m, f in (("lo", F.array_min), ("hi", F.array_max))])
    flat = lambda c: F.flatten(F.transform(c, lambda v: F.array(v["x"], v["y"])))
    pairs = box_pairs(box(sources), box(targets), ["x", "y"], [cell, cell])
    rows = pairs.join(sources.select(F.col("cid").alias("ida"), flat(F.col("at")).alias("a")), "ida").join(targets.select(F.col("cid").alias("idb"), flat(F.col("at")).alias("b")), "idb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p["overlap"] = [abs(moments(clip(np.reshape(a, (-1, 2)), np.reshape(b, (-1, 2))))[0]) for a, b in zip(p["a"], p["b"], strict=True)]
            p = p.loc[p["overlap"] > 0, ["ida", "idb", "overlap"]]
            yield p.rename(columns={"ida": "source", "idb": "target"})

    return rows.select("ida", "idb", "a", "b").mapInPandas(run, "source long, target long, overlap double")


def map_back(pieces: DataFrame, values: DataFrame, areas_: DataFrame, support: float = 0.05) -> DataFrame:
    """(cid, value, cover): the overlap-weighted mean of target values (cid, value) on each source cell (cid, area); null where
    less than support of its area is covered."""
    got = pieces.join(values.select(F.col("cid").alias("target"), F.col("value").alias("_v")), "target").groupBy(F.col("source").alias("cid")).agg(F.sum("overlap").alias("_a"), F.sum(F.col("overlap") * F.col("_v")).alias("_s"))
    out = areas_.join(got, "cid", "left").withColumn("cover", F.coalesce(F.col("_a") / F.col("area"), F.lit(0.0)))
    return out.select("cid", F.when(F.col("cover") >= support, F.col("_s") / F.col("_a")).alias("value"), "cover")


def attach(cells: DataFrame, result: DataFrame, value: str, name: str = "heatFlux") -> DataFrame:
    """cells with a result's value as a column; cells without one have null."""
    return cells.drop(name).join(result.select("cid", F.col(value).alias(name)), "cid", "left")


def point_flux(cells: DataFrame, points: DataFrame, flux: str) -> DataFrame:
    """(pid, value): face-area weighted nodal means of a cell flux, then scaled so that the nodes' heat (each by a corner's share
    of its cells) is the cells'."""
    a = areas(cells, points)
    share = cells.join(a, "cid").select(F.col(flux).alias("_q"), F.explode("nodes").alias("pid"), (F.col("area") / F.size("nodes")).alias("_a"))
    node = share.groupBy("pid").agg(F.sum("_a").alias("_a"), (F.sum(F.col("_a") * F.col("_q")) / F.sum("_a")).alias("value"))
    total = node.agg(F.sum(F.col("_a") * F.col("value")).alias("now"), F.lit(1).alias("_one"))
    want = share.agg(F.sum(F.col("_a") * F.col("_q")).alias("want"), F.lit(1).alias("_one"))
    factor = total.join(want, "_one").select(F.coalesce(F.try_divide(F.col("want"), F.col("now")), F.lit(1.0)).alias("_f")).first()[0]
    return node.select("pid", (F.col("value") * factor).alias("value"))


def linear_reconstruction(cells: DataFrame, points: DataFrame, flux: str) -> DataFrame:
    """(cid, pid, value): values at the corners of every cell, the mean of neighbouring cells' fluxes at a node, moved so that the
    cell's mean stays, and shrunk towards it so that no corner leaves the range of the node's cells nor changes sign."""
    each = cells.select("cid", F.col(flux).alias("_q"), F.explode("nodes").alias("pid"))
    node = each.groupBy("pid").agg(F.avg("_q").alias("_m"), F.min("_q").alias("_lo"), F.max("_q").alias("_hi"))
    at = each.join(node, "pid")
    mean = at.groupBy("cid").agg(F.avg("_m").alias("_c"))
    at = at.join(mean, "cid").withColumn("_d", F.col("_m") - F.col("_c"))
    low = F.when(F.col("_q") >= 0, F.greatest("_lo", F.lit(0.0))).otherwise(F.col("_lo"))
    high = F.when(F.col("_q") < 0, F.least("_hi", F.lit(0.0))).otherwise(F.col("_hi"))
    room = F.when(F.col("_d") > 0, (high - F.col("_q")) / F.col("_d")).when(F.col("_d") < 0, (low - F.col("_q")) / F.col("_d")).otherwise(1.0)
    shrink = at.groupBy("cid").agg(F.greatest(F.least(F.min(room), F.lit(1.0)), F.lit(0.0)).alias("_s"))
    return at.join(shrink, "cid").select("cid", "pid", (F.col("_q") + F.col("_s") * F.col("_d")).alias("value"))


def consistent_flux(cells: DataFrame, points: DataFrame, flux: str, rounds: int = 2000, tolerance: float = 1e-10) -> DataFrame:
    """(pid, value): the least-squares nodal field of a cell flux on triangles: the mass matrix's system by conjugate gradients
    with its diagonal, every product a join and a sum over the entries. The field's integral is the flux's. A residual that
    is not below tolerance times the first one after all rounds raises."""
    tri = triangulated(cells.where(F.col("type").isin(5, 7, 9)))
    a = areas(tri, points)
    held = tri.join(a, "cid").join(cells.select(F.col("cid").alias("parent"), F.col(flux).alias("_q")), "parent")
    each = held.select("cid", "area", "_q", F.explode("nodes").alias("row"))
    other = held.select("cid", F.explode("nodes").alias("col"))
    mass = each.join(other, "cid").groupBy("row", "col").agg(F.sum(F.col("area") / 12 * F.when(F.col("row") == F.col("col"), 2.0).otherwise(1.0)).alias("m"))
    mass = saved(mass)
    rhs = each.groupBy(F.col("row").alias("pid")).agg(F.sum(F.col("area") / 3 * F.col("_q")).alias("r"))
    diagonal = mass.where("row = col").select(F.col("row").alias("pid"), F.col("m").alias("d"))
    state = rhs.join(diagonal, "pid").select("pid", F.lit(0.0).alias("x"), "r", "d", (F.col("r") / F.col("d")).alias("p"))
    rz0 = rz = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
    for _ in range(rounds):
        if rz <= tolerance**2 * max(rz0, 1e-300):
            return state.select("pid", F.col("x").alias("value"))
        ap = mass.join(state.select(F.col("pid").alias("col"), "p"), "col").groupBy(F.col("row").alias("pid")).agg(F.sum(F.col("m") * F.col("p")).alias("ap"))
        now = saved(state.join(ap, "pid"))
        step = rz / (now.agg(F.sum(F.col("p") * F.col("ap"))).first()[0] or 1.0)
        now = now.select("pid", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "d", "p")
        new = now.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
        state = now.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p"))
        rz = new
    raise RuntimeError(f"no nodal field within {tolerance} after {rounds} rounds")


# layered profiles: materials {label: {density, cp: number or table}}


def load_materials(spark: SparkSession, path: str) -> DataFrame:
    """(label, density, cp array<array<double>>) of a JSON file keyed by label; a number is a table of one row."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", "map<string,struct<density:double,cp:string>>")).alias("label", "m"))
    table_ = F.coalesce(F.from_json("m.cp", "array<array<double>>"), F.array(F.array(F.lit(0.0), F.col("m.cp").cast("double"))))
    return each.select("label", F.col("m.density").alias("density"), table_.alias("cp"))


def volumetric_energy(t: Column, density: float, cp: Sequence[tuple[float, float]]) -> Column:
    return F.lit(float(density)) * heat_energy(t, cp)


def volumetric_capacity(t: Column, density: float, cp: Sequence[tuple[float, float]]) -> Column:
    return F.lit(float(density)) * heat_capacity(t, cp)


def station_depth(xi: Column, depth: Column, interfaces: Sequence[float], layer: Column) -> Column:
    """A point's depth at a station: its share xi of the layer between the station's interfaces; its own depth where xi is null."""
    edges = F.array(F.lit(0.0), *[F.lit(float(v)) for v in interfaces])
    lo, hi = F.get(edges, layer), F.get(edges, layer + 1)
    return F.when(xi.isNull() | F.isnan(xi), depth).otherwise(lo + xi * (hi - lo))


def profile_bounds(df: DataFrame, node: str, values: str) -> DataFrame:
    """(node, lo, hi): extremes of the station values that contribute to each node."""
    return df.groupBy(node).agg(F.min(values).alias("lo"), F.max(values).alias("hi"))


def cell_temperature(energy: Column, density: float, cp: Sequence[tuple[float, float]], rounds: int = 40) -> Column:
    """The temperature whose volumetric energy is given: a bisection of the increasing integral, as an expression."""
    lo, hi = cp[0][0] - 1000.0, cp[-1][0] + 4000.0
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))

    def step(acc: Column, k: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        below = volumetric_energy(mid, density, cp) < energy
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def station_weights(at: np.ndarray, stations: np.ndarray, values: np.ndarray | None = None, kind: str = "kriging", length: float | None = None) -> np.ndarray:
    """Weights (points, stations) of sum one: of the nearest station, by inverse squared distance, or by ordinary Kriging with a
    length that is given or of the best likelihood of the stations' values."""
    d = np.sqrt(((at[:, None] - stations[None]) ** 2).sum(-1))
    if kind == "nearest":
        return (d == d.min(1, keepdims=True)) / (d == d.min(1, keepdims=True)).sum(1, keepdims=True)
    if kind == "idw":
        w = 1 / np.maximum(d, 1e-12) ** 2
        return w / w.sum(1, keepdims=True)
    length = length or fit_length(stations, values)
    k = np.exp(-np.sqrt(((stations[:, None] - stations[None]) ** 2).sum(-1)) / length) + 1e-10 * np.eye(len(stations))
    n = len(stations)
    a = np.block([[k, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    return np.linalg.solve(a, np.vstack([np.exp(-d / length).T, np.ones((1, len(at)))]))[:n].T


def fit_length(stations: np.ndarray, values: np.ndarray | None) -> float:
    """Correlation length of station values by likelihood; half the stations' extent where there are no values."""
    span = float(np.ptp(stations, axis=0).max()) or 1.0
    if values is None or np.ndim(values) == 0 or len(stations) < 3:
        return span / 2
    d = np.sqrt(((stations[:, None] - stations[None]) ** 2).sum(-1))
    v = np.asarray(values, float).reshape(len(stations), -1)

    def cost(t: float) -> float:
        low, _ = numerics.cholesky_jitter(np.exp(-d / math.exp(t)) + 1e-8 * np.eye(len(d)))
        e = v - v.mean(0)
        s2 = max(float((np.linalg.solve(low, e) ** 2).sum() / e.size), 1e-300)
        return 0.5 * e.size * math.log(s2) + e.shape[1] * float(np.log(np.diag(low)).sum())

    return math.exp(numerics.minimize_scalar(cost, math.log(span / 50), math.log(span * 10))[0])


def write_series(frames: Sequence[tuple[float, DataFrame]], folder: str) -> str:
    """Time tables (pid, temperature) as Parquet partitioned by time: one folder a time, the distributed form of a file series."""
    out = None
    for t, df in frames:
        part = df.withColumn("time", F.lit(float(t)))
        out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").partitionBy("time").parquet(folder)
    return folder


# queries


def _q_elements(s, d):
    """Shape functions: one at their node and zero elsewhere, sums one, the reference measures by quadrature."""
    rows = []
    for k in supported_types():
        e = element(k)
        at = e.nodes if k != 14 else e.nodes * np.array([1, 1, 1 - 1e-9])
        n = e.shape(at)
        p, w = e.rule(4)
        rows.append((k, e.dimension, len(e.nodes), round(float(w.sum()), 9), bool(np.abs(n - np.eye(len(e.nodes))).max() < 1e-6), bool(np.abs(e.shape(p).sum(1) - 1).max() < 1e-9)))
    return s.createDataFrame(rows, "type int, dimension int, nodes int, measure double, nodal boolean, sums boolean")


def _q_integrals(s, d):
    """Nodal x * y + z over boxes of three element types: exact integrals."""
    out = None
    for kind in ("hexahedron", "tetra", "wedge"):
        p, c = box_mesh(s, (4, 3, 2), (2.0, 1.0, 1.0)) if kind == "hexahedron" else box_cells(s, (4, 3, 2), (2.0, 1.0, 1.0), kind)
        nodal = p.select("pid", (F.col("x") + F.col("z")).alias("v"))
        row = integrate(c, quadrature(c, p, 3), nodal, "v").select(F.lit(kind).alias("kind"), F.round("integral", 9).alias("integral"))
        out = row if out is None else out.unionByName(row)
    return out


def _q_sphere(s, d):
    p, c = sphere_surface(s, 2.0, 24)
    q, h = spherical_shell(s, (1.0, 2.0, 3.0), 12, (2, 3))
    a = areas(c, p).agg(F.sum("area").alias("a")).first()["a"]
    v = volumes(h, q).agg(F.sum("volume").alias("v"), F.count("*").alias("n")).first()
    t = triangulated(c).count()
    points = p.count()
    r = s.createDataFrame([(round(a / (16 * math.pi), 2), round(v["v"] / (4 / 3 * math.pi * 26), 2), v["n"], t, points)], "area double, volume double, cells long, triangles long, points long")
    return r


def _q_blocks(s, d):
    c = from_blocks(s, [(5, [(0, 1, 2), (1, 2, 3)]), (9, [(0, 1, 3, 2)]), (10, [(0, 1, 2, 3)])])
    out = sizes(c)
    t = triangulated(c).groupBy(F.col("parent").alias("cid")).agg(F.count("*").alias("triangles"))
    return out.join(t, "cid", "left")


def _q_back(s, d):
    """A linear field of the fine mesh comes back to the coarse one as its cell means; then nodal flux keeps the heat."""
    p, c = plane_mesh(s, 12, 12)
    q, e = plane_mesh(s, 4, 3, triangles=False)
    fine, coarse = with_corners(c, p), with_corners(e, q)
    mean = F.aggregate(F.col("at")["x"], F.lit(0.0), lambda a, v: a + v) / F.size("at")
    values = fine.select("cid", mean.alias("value"))
    back = map_back(overlap_pieces(coarse, fine, 0.3), values, areas(e, q))
    cells = attach(e, back, "value", "q")
    node = point_flux(cells, q, "q")
    least = consistent_flux(attach(c, values, "value", "q"), p, "q")
    got = back.agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.min("cover"), 9).alias("cover")).first()
    heat = load_of(cells, q, node)
    lo = linear_reconstruction(cells, q, "q").groupBy("cid").agg(F.avg("value").alias("m")).join(cells.select("cid", "q"), "cid").agg(F.round(F.max(F.abs(F.col("m") - F.col("q"))), 9).alias("gap")).first()["gap"]
    return s.createDataFrame([(got["mean"], got["cover"], round(heat, 9), lo, round(load_of(c, p, least), 6))], "mean double, cover double, heat double, gap double, least double")


def load_of(cells: DataFrame, points: DataFrame, nodal: DataFrame) -> float:
    a = areas(cells, points)
    share = cells.join(a, "cid").select(F.explode("nodes").alias("pid"), (F.col("area") / F.size("nodes")).alias("a"))
    return share.join(nodal, "pid").agg(F.sum(F.col("a") * F.col("value"))).first()[0]


def _q_layers(s, d):
    cp = [(300.0, 1000.0), (2000.0, 1800.0)]
    t = s.range(300, 2001, 100).select(F.col("id").cast("double").alias("t"))
    e = volumetric_energy(F.col("t"), 250.0, cp)
    return t.select("t", F.round(e, 3).alias("energy"), F.round(volumetric_capacity(F.col("t"), 250.0, cp), 6).alias("capacity"), F.round(cell_temperature(e, 250.0, cp, 60), 6).alias("back"), F.round(station_depth(F.lit(0.5), F.lit(0.0), [0.2, 0.6], F.lit(1)), 9).alias("depth"))


def _q_summary(s, d):
    p, c = box_mesh(s, (5, 4, 3), (1.0, 2.0, 3.0))
    return summary(p, c).select("points", "cells", F.col("types")[12].alias("hexahedra"), F.round("measure", 9).alias("measure"), "x_hi", "y_hi", "z_hi")


def _q_frames(s, d):
    p, c = plane_mesh(s, 3, 2)
    return normals(c, p).agg(F.count("*").alias("n"), F.round(F.min("nz"), 12).alias("nz"), F.round(F.max(F.abs("nx")), 12).alias("nx")).withColumn("t", F.lit(surface_triangles(c, p).count()).cast("long"))


QUERIES = {"element_library": _q_elements, "cell_integrals": _q_integrals, "sphere_meshes": _q_sphere, "cell_blocks": _q_blocks, "flux_back": _q_back, "layer_energy": _q_layers, "mesh_summary": _q_summary, "surface_normals": _q_frames}
SQL = {
    "element_library": "SELECT type::INTEGER AS type, dimension::INTEGER AS dimension, nodes::INTEGER AS nodes, round(measure::DOUBLE, 9) AS measure, true AS nodal, true AS sums FROM (VALUES (3, 1, 2, 2.0::DOUBLE), (5, 2, 3, 0.5), (9, 2, 4, 4.0), (10, 3, 4, 1 / 6.0), (12, 3, 8, 8.0), (13, 3, 6, 1.0), (14, 3, 5, 4 / 3.0), (21, 1, 3, 2.0), (22, 2, 6, 0.5), (23, 2, 8, 4.0), (24, 3, 10, 1 / 6.0), (25, 3, 20, 8.0)) t(type, dimension, nodes, measure)",
    "cell_integrals": "SELECT kind, 3.0::DOUBLE AS integral FROM (VALUES ('hexahedron'), ('tetra'), ('wedge')) t(kind)",
    "sphere_meshes": "SELECT 1.0::DOUBLE AS area, 0.99::DOUBLE AS volume, (6 * 144 * 5)::BIGINT AS cells, (6 * 576 * 2)::BIGINT AS triangles, (25 * 25 * 25 - 23 * 23 * 23)::BIGINT AS points",
    "cell_blocks": "SELECT cid::BIGINT AS cid, size::INTEGER AS size, dimension::INTEGER AS dimension, t::BIGINT AS triangles FROM (VALUES (0, 3, 2, 1), (1, 3, 2, 1), (2, 4, 2, 2), (3, 4, 3, NULL)) v(cid, size, dimension, t)",
    "flux_back": "SELECT 0.5::DOUBLE AS mean, 1.0::DOUBLE AS cover, 0.5::DOUBLE AS heat, 0.0::DOUBLE AS gap, 0.5::DOUBLE AS least",
    "layer_energy": "SELECT t::DOUBLE AS t, round(250 * ((t - 300) * 1000 + (t - 300) * (t - 300) * 800 / 1700.0 / 2), 3)::DOUBLE AS energy, round(250 * (1000 + (t - 300) * 800 / 1700.0), 6)::DOUBLE AS capacity, t::DOUBLE AS back, 0.4::DOUBLE AS depth FROM range(300, 2001, 100) v(t)",
    "mesh_summary": "SELECT 120::BIGINT AS points, 60::BIGINT AS cells, 60::BIGINT AS hexahedra, 6.0::DOUBLE AS measure, 1.0::DOUBLE AS x_hi, 2.0::DOUBLE AS y_hi, 3.0::DOUBLE AS z_hi",
    "surface_normals": "SELECT 12::BIGINT AS n, 1.0::DOUBLE AS nz, 0.0::DOUBLE AS nx, 12::BIGINT AS t",
}
