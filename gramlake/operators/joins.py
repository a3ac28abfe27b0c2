"""Neighbour, range, as-of and interval joins, and what rests on them: inverse distances, local regression, variograms."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.bounded import kd_nearest
from gramlake.session import saved, table

#: Reference points, and bytes of them, up to which a neighbour search broadcasts them as one matrix; beyond, the grid join is used.
BROADCAST_POINTS, BROADCAST_BYTES = 50_000, 32 << 20
#: Distances that a task of that search holds at once.
MATRIX = 1 << 20
#: Boxes of one side that a task pairs with as many of the other in a cell of a box join.
BLOCK_ROWS = 4_096
#: Pairs of points of two cells of a variogram from which on they are measured as arrays. A cell is cut into blocks of one in
#: BLOCKS of all rows, or BLOCK_ROWS, each of which meets each block of the other, in TASKS tasks at most; rows of a tile of a block.
DENSE_PAIRS, BLOCKS, TASKS, TILE_ROWS = 65_536, 32, 256, 256
#: Values of an axis of a rectilinear grid, which come to the driver.
MAX_AXIS = 10_000


def squared_distance(a: Sequence[str], b: Sequence[str]) -> Column:
    return sum(((F.col(x) - F.col(y)) ** 2 for x, y in zip(a, b, strict=True)), F.lit(0.0))


def nearest(queries: DataFrame, points: DataFrame, axes: Sequence[str], k: int, query_id: str = "qid", point_id: str = "pid") -> DataFrame:
    """(query_id, point_id, distance, rank): the exact k nearest points of each query, ties by point_id.

    A checked number of points goes to the workers as one matrix, against which queries stream in blocks. More points go
    to the leaves of a k-d tree, of which each query visits those that may hold a neighbour.
    """
    n = points.count()
    if n <= BROADCAST_POINTS and 8 * n * (len(axes) + 1) <= BROADCAST_BYTES:
        rows = points.select(point_id, *axes).toPandas().sort_values(point_id)
        held = points.sparkSession.sparkContext.broadcast((rows[point_id].to_numpy(), rows[list(axes)].to_numpy(float)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, at = held.value
            for b in batches:
                step = max(1, min(256, MATRIX // max(len(at), 1)))
                for lo in range(0, len(b), step):
                    part = b.iloc[lo : lo + step]
                    q = part[list(axes)].to_numpy(float)
                    d2 = np.zeros((len(q), len(at)))
                    for j in range(q.shape[1]):
                        d2 += (q[:, j, None] - at[None, :, j]) ** 2
                    d2[np.isnan(d2)] = np.inf
                    far = np.partition(d2, k - 1, axis=1)[:, k - 1, None] if len(at) > k else np.inf
                    r, c = np.nonzero(d2 <= far)
                    order = np.lexsort((c, d2[r, c], r))
                    r, c = r[order], c[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c, rank = (x[rank < k] for x in (r, c, rank))
                    distance = np.sqrt(d2[r, c])
                    yield pd.DataFrame({query_id: part[query_id].to_numpy()[r], point_id: ids[c], "distance": np.where(np.isinf(distance), np.nan, distance), "rank": (rank + 1).astype(np.int32)})

        return queries.select(query_id, *axes).mapInPandas(run, f"{query_id} long, {point_id} long, distance double, rank int")
    return kd_nearest(queries, points, axes, k, query_id, point_id)


def _grid_nearest(queries: DataFrame, points: DataFrame, axes: Sequence[str], k: int, query_id: str, point_id: str, n: int) -> DataFrame:
    box = points.agg(*[f(a).alias(f"{a}_{m}") for a in axes for m, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = [max(box[f"{a}_hi"] - box[f"{a}_lo"], 1e-300) for a in axes]
    size = (math.prod(spans) * 2 * k / n) ** (1 / len(axes))
    cell = lambda a: F.floor((F.col(a) - F.lit(box[f"{a}_lo"])) / size).cast("long")
    at = points.select(F.col(point_id), *[F.col(a).alias(f"p_{a}") for a in axes], *[cell(a).alias(f"g{j}") for j, a in enumerate(axes)])
    todo = queries.select(query_id, *axes)
    done, ring = None, 1
    last = [math.floor((box[f"{a}_hi"] - box[f"{a}_lo"]) / size) for a in axes]
    limit = max(last) + 1
    # rings count from the query's cell, or the nearest one of the box for a query outside
    own = [F.greatest(F.lit(0), F.least(F.lit(m), cell(a))) for a, m in zip(axes, last, strict=True)]
    gap = [F.greatest(F.lit(0.0), F.lit(box[f"{a}_lo"]) - F.col(a), F.col(a) - F.lit(box[f"{a}_hi"])) for a in axes]
    ringed = lambda c, m: F.sequence(F.greatest(F.lit(0), c - ring), F.least(F.lit(m), c + ring))
    while True:
        near = todo.select("*", *[F.explode(ringed(c, last[j])).alias(f"g{j}") if j == 0 else c.alias(f"c{j}") for j, c in enumerate(own)])
        for j in range(1, len(axes)):
            near = near.select("*", F.explode(ringed(F.col(f"c{j}"), last[j])).alias(f"g{j}"))
        pairs = near.join(at, [f"g{j}" for j in range(len(axes))]).withColumn("distance", F.sqrt(squared_distance(axes, [f"p_{a}" for a in axes])))
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("distance", point_id))).where(F.col("rank") <= k)
        # a point outside the block is as far as the box on every axis, and by (ring) whole cells farther on one: a k-th
        # neighbour nearer than that is final
        more = [2 * g * ring * size + (ring * size) ** 2 for g in gap]
        free = F.sqrt(sum((g * g for g in gap), F.lit(0.0)) + (F.least(*more) if len(more) > 1 else more[0])) * (1 - 1e-9)
        sure = best.withColumn("free", free).groupBy(query_id).agg(F.count("*").alias("found"), F.max("distance").alias("far"), F.first("free").alias("free")).where((F.col("found") == k) & (F.col("far") < F.col("free")) if ring < limit else F.lit(True))
        part = best.join(sure.select(query_id), query_id, "left_semi").select(query_id, point_id, "distance", "rank")
        done = part if done is None else done.unionByName(part)
        if ring >= limit:
            return done
        todo = todo.join(sure.select(query_id), query_id, "left_anti").checkpoint()
        if todo.isEmpty():
            return done
        ring = min(ring * 3, limit)


def inverse_distance(queries: DataFrame, points: DataFrame, axes: Sequence[str], value: str, k: int, power: float = 2.5) -> DataFrame:
    """(qid, estimate): weights 1 / d^power of the k nearest on axes scaled by population deviation; an exact hit is the value."""
    sd = points.agg(*[F.stddev_pop(a).alias(a) for a in axes]).first()
    scale = lambda df: df.withColumns({a: F.col(a) / F.lit(sd[a] or 1.0) for a in axes})
    near = nearest(scale(queries), scale(points), axes, k).join(points.select("pid", F.col(value).alias("v")), "pid")
    hit = F.col("distance") <= 1e-14
    w = F.when(~hit, F.pow("distance", F.lit(-power)))
    out = near.groupBy("qid").agg(F.avg(F.when(hit, F.col("v"))).alias("at"), (F.sum(w * F.col("v")) / F.sum(w)).alias("mean"))
    return out.select("qid", F.coalesce("at", "mean").alias("estimate"))


def local_regression(queries: DataFrame, points: DataFrame, x: str, y: str, k: int) -> DataFrame:
    """(qid, estimate): local line of the k nearest points on one axis, tricube weights, a ridge of 1e-10 of the trace."""
    near = nearest(queries, points, [x], k).join(points.select("pid", F.col(x).alias("px"), F.col(y).alias("v")), "pid")
    near = near.join(queries.select("qid", F.col(x).alias("qx")), "qid")
    h = F.max("distance").over(Window.partitionBy("qid")) * (1 + 1e-10)
    near = near.withColumn("w", F.when(h > 0, F.pow(1 - F.pow(F.col("distance") / h, 3), 3)).otherwise(1.0)).withColumn("u", F.col("px") - F.col("qx"))
    s = near.groupBy("qid").agg(*[F.sum(e).alias(n) for n, e in (("s0", F.col("w")), ("s1", F.expr("w * u")), ("s2", F.expr("w * u * u")), ("t0", F.expr("w * v")), ("t1", F.expr("w * u * v")))])
    r = "1e-10D * (s0 + s2)"
    return s.selectExpr("qid", f"((s2 + {r}) * t0 - s1 * t1) / ((s0 + {r}) * (s2 + {r}) - s1 * s1) AS estimate")


def box_pairs(a: DataFrame, b: DataFrame, axes: Sequence[str], sizes: Sequence[float]) -> DataFrame:
    """(ida, idb) of all overlapping closed boxes (id, <axis>_lo, <axis>_hi): an equi-join on grid cells of the given sizes.

    A pair is kept in the one cell that holds the lower corner of its overlap, so nothing is deduplicated after the join.
    A cell with many boxes is cut into blocks of BLOCK_ROWS of either side, each pair of blocks a key of its own.
    """
    cell = lambda c, h: F.floor(F.col(c) / F.lit(float(h))).cast("long")

    def dealt(df: DataFrame, mark: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{mark}_{c}") for c in ["id", *[f"{x}_{s}" for x in axes for s in ("lo", "hi")]]])
        for j, (x, h) in enumerate(zip(axes, sizes, strict=True)):
            out = out.select("*", F.explode(F.sequence(cell(f"{mark}_{x}_lo", h), cell(f"{mark}_{x}_hi", h))).alias(f"g{j}"))
        return out

    grid = [f"g{j}" for j in range(len(axes))]
    counts = [dealt(df, m).groupBy(*grid).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias(f"n{m}")) for df, m in ((a, "a"), (b, "b"))]
    hot = F.broadcast(counts[0].join(counts[1].hint("merge"), grid).where("na > 1 OR nb > 1"))  # one row in BLOCK_ROWS at most
    block = lambda m: F.pmod(F.xxhash64(f"{m}_id"), F.coalesce(f"n{m}", F.lit(1))).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.coalesce(f"n{m}", F.lit(1)) - 1))
    left = dealt(a, "a").join(hot, grid, "left").select("*", block("a").alias("ka"), every("b").alias("kb")).drop("na", "nb")
    right = dealt(b, "b").join(hot, grid, "left").select("*", block("b").alias("kb"), every("a").alias("ka")).drop("na", "nb")
    pairs = left.join(right.hint("merge"), [*grid, "ka", "kb"])
    for j, (x, h) in enumerate(zip(axes, sizes, strict=True)):
        low = F.greatest(f"a_{x}_lo", f"b_{x}_lo")
        pairs = pairs.where((low <= F.least(f"a_{x}_hi", f"b_{x}_hi")) & (F.floor(low / F.lit(float(h))).cast("long") == F.col(f"g{j}")))
    return pairs.select(F.col("a_id").alias("ida"), F.col("b_id").alias("idb"))


def as_of(series: DataFrame, queries: DataFrame, by: Sequence[str], t: str, value: str, query_id: str = "qid") -> DataFrame:
    """(query_id, estimate): value of the series at each query's time, linear between neighbours and clamped at the ends.

    One sort of series and queries together in each group: the last sample before and the first after by window.
    """
    both = series.select(*by, t, F.col(value).alias("v"), F.lit(None).cast("long").alias(query_id)).unionByName(queries.select(*by, t, F.lit(None).cast("double").alias("v"), F.col(query_id).cast("long").alias(query_id)))
    sample = F.when(F.col(query_id).isNull(), F.struct(F.col(t).alias("t"), F.col("v").alias("v")))
    # both windows grow from their start: a frame that shrinks would be computed anew for each row
    w, back = Window.partitionBy(*by).orderBy(t), Window.partitionBy(*by).orderBy(F.col(t).desc())
    both = both.withColumn("a", F.last(sample, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("b", F.last(sample, ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, 0)))
    a, b = F.col("a"), F.col("b")
    share = F.try_divide(F.col(t) - a["t"], b["t"] - a["t"])
    inside = F.coalesce(a["v"] + share * (b["v"] - a["v"]), a["v"])
    return both.where(F.col(query_id).isNotNull()).select(query_id, F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inside).alias("estimate"))


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds that two closed intervals share, both ends counted; 0 if they are disjoint."""
    return F.greatest(F.lit(0), F.unix_timestamp(F.least(e1, e2).cast("timestamp")) - F.unix_timestamp(F.greatest(s1, s2).cast("timestamp")) + 1)


def pairs_within(points: DataFrame, axes: Sequence[str], value: str, radius: float, without: DataFrame | None = None) -> DataFrame:
    """(i, j, distance, half_square, d_<axis>): every pair of points within radius, once, by a grid equi-join on cells of that size.

    without: pairs of cells (g0, .., c0, ..) whose points are left out."""
    cell = lambda a: F.floor(F.col(a) / F.lit(float(radius))).cast("long")
    left = points.select(F.col("pid").alias("i"), *[F.col(a).alias(f"a_{a}") for a in axes], F.col(value).alias("va"), *[cell(a).alias(f"g{j}") for j, a in enumerate(axes)])
    right = points.select(F.col("pid").alias("j"), *[F.col(a).alias(f"b_{a}") for a in axes], F.col(value).alias("vb"), *[cell(a).alias(f"c{j}") for j, a in enumerate(axes)])
    for j in range(len(axes)):
        right = right.select("*", F.explode(F.sequence(F.col(f"c{j}") - 1, F.col(f"c{j}") + 1)).alias(f"g{j}"))
    if without is not None:
        right = right.join(without, [f"{s}{j}" for s in "gc" for j in range(len(axes))], "left_anti")
    out = left.join(right, [f"g{j}" for j in range(len(axes))]).where("i < j")
    out = out.withColumn("distance", F.sqrt(squared_distance([f"a_{a}" for a in axes], [f"b_{a}" for a in axes]))).where(F.col("distance") <= radius)
    return out.select("i", "j", "distance", (0.5 * (F.col("va") - F.col("vb")) ** 2).alias("half_square"), F.abs(F.col("va") - F.col("vb")).alias("gap"), *[(F.col(f"b_{a}") - F.col(f"a_{a}")).alias(f"d_{a}") for a in axes])


class Tile:
    """Rows that lie together: ids, axes, values and which are there, with their box and, of each row, 1, there, value, its square."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, v: np.ndarray, there: np.ndarray):
        self.ids, self.x, self.v, self.there = ids, x, v, there
        self.lo, self.hi = x.min(1), x.max(1)
        self.finite = bool(np.isfinite(v).all())
        self.powers = np.stack([np.ones(len(v)), there, v, v * v], 1)


def _tiles(t: pa.Table, axes: Sequence[str]) -> list[Tile]:
    """Tiles of strips of the first axis, cut on the second."""
    ids, v = (t[c].to_numpy() for c in ("pid", "value"))
    there = t["value"].is_valid().to_numpy()
    x = np.stack([t[a].to_numpy() for a in axes])
    order = np.argsort(x[0], kind="stable")
    if len(axes) > 1:
        strip = np.empty(len(ids), np.int64)
        strip[order] = np.arange(len(ids)) // max(TILE_ROWS, math.ceil(math.sqrt(len(ids) * TILE_ROWS)))
        order = np.lexsort((x[1], strip))
    return [Tile(ids[k], x[:, k], np.where(there[k], v[k], 0), there[k]) for k in (order[lo : lo + TILE_ROWS] for lo in range(0, len(order), TILE_ROWS))]


def _distances(a: Tile, b: Tile, room: np.ndarray) -> np.ndarray:
    d, step = (r[: len(a.ids) * len(b.ids)].reshape(len(a.ids), len(b.ids)) for r in room[:2])
    np.subtract(a.x[0][:, None], b.x[0], out=d)
    np.multiply(d, d, out=d)
    for p, q in zip(a.x[1:], b.x[1:], strict=True):
        np.subtract(p[:, None], q, out=step)
        np.multiply(step, step, out=step)
        np.add(d, step, out=d)
    return np.sqrt(d, out=d)


def _tile_sums(a: Tile, b: Tile, same: bool, twice: bool, edges: np.ndarray, robust: bool, unit: np.ndarray | None, least: float, room: np.ndarray) -> np.ndarray:
    """Of the pairs of two tiles, for each bin: their number, the sum of distances, how many have both values, what gamma sums.

    same: a and b are one tile, whose pairs count once. twice: an id may be in both, which is no pair. room: for three
    matrices of the tiles' pairs.
    """
    last = len(edges) - 1
    out = np.zeros((4, last))
    gap = np.maximum(0, np.maximum(a.lo - b.hi, b.lo - a.hi))
    reach = np.maximum(a.hi - b.lo, b.hi - a.lo)
    low, high = (int(k) - 1 for k in np.searchsorted(edges, [math.sqrt(sum(g * g for g in gap)), math.sqrt(sum(g * g for g in reach))]))
    if low >= last or high < 0:
        return out
    d = _distances(a, b, room)
    if not (same or twice or robust) and unit is None and a.finite and b.finite:
        # sums up to each edge that parts the pairs; the differences are the bins'
        m = room[2][: d.size].reshape(d.shape)
        begun = np.zeros(4)
        for k in range(low + 1, min(high, last - 1) + 2):
            if k <= high:
                np.less_equal(d, edges[k], out=m)
                f, far = m @ b.powers, np.vdot(m, d)
            else:
                f, far = np.broadcast_to(b.powers.sum(0), (len(a.ids), 4)), d.sum()
            w, v, vv = a.powers[:, 1:].T
            sums = np.array([f[:, 0].sum(), far, w @ f[:, 1], 0.5 * (vv @ f[:, 1] + w @ f[:, 3]) - v @ f[:, 2]])
            if k:
                out[:, k - 1] = sums - begun
            begun = sums
        return out
    kept = a.ids[:, None] != b.ids
    if same:
        kept = np.triu(kept, 1)
    if unit is not None:
        kept &= np.abs(sum((q - p[:, None]) * u for p, q, u in zip(a.x, b.x, unit, strict=True))) >= d * least
    for k in range(max(low, 0), min(high, last - 1) + 1):
        r, c = np.nonzero(kept & (d > edges[k]) & (d <= edges[k + 1]))
        out[:2, k] = len(r), d[r, c].sum()
        both = a.there[r] & b.there[c]
        g = np.abs(a.v[r[both]] - b.v[c[both]])
        out[2:, k] = len(g), (np.sqrt(g) if robust else 0.5 * g * g).sum()
    return out


def _dense_sums(cells: DataFrame, dense: DataFrame, axes: Sequence[str], edges: Sequence[float], robust: bool, direction: Sequence[float] | None, least: float) -> DataFrame:
    """(bin, pairs, far, valued, total): sums over the pairs of points of the dense pairs of cells (g0, .., c0, .., n, m).

    A cell is cut into blocks, and each pair of blocks is measured by one task, a pair of tiles at a time. A row is copied a
    bounded number of times, as blocks grow with the rows.
    """
    g, c = ([f"{s}{j}" for j in range(len(axes))] for s in "gc")
    bounds, unit = np.array(edges, float), None if direction is None else np.array(direction, float) / math.sqrt(sum(x * x for x in direction))
    size = max(BLOCK_ROWS, -(-cells.count() // BLOCKS))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(size)).cast("int")
    tasks = min(TASKS, dense.agg(F.sum(blocks("n") * blocks("m"))).first()[0] or 1)
    block = lambda n: F.pmod(F.xxhash64("pid", *axes), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = cells.join(dense, g).select("*", block("n").alias("ka"), every("m").alias("kb"))
    again = [F.col(x).alias(x) for x in ("pid", *axes, "value")]
    right = cells.select(*again, *[F.col(x).alias(y) for x, y in zip(g, c, strict=True)]).join(dense, c).select("*", block("m").alias("kb"), every("n").alias("ka"))
    once = " AND ".join(f"{x} = {y}" for x, y in zip(g, c, strict=True))
    keys = [*g, *c, "ka", "kb"]
    left, right = (df.where(f"NOT ({once}) OR ka <= kb").select(*keys, "pid", *axes, "value").repartition(tasks, *keys) for df in (left, right))

    def measured(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        same = at[: len(axes)] == at[len(axes) : -2] and at[-2] == at[-1]
        tiles = _tiles(a, axes)
        others = tiles if same else _tiles(b, axes)
        twice = len(np.unique(a["pid"].to_numpy())) < len(a) if same else bool(len(np.intersect1d(a["pid"].to_numpy(), b["pid"].to_numpy())))
        room = np.empty((3, TILE_ROWS * TILE_ROWS))
        out = np.zeros((4, len(bounds) - 1))
        for i, p in enumerate(tiles):
            for j in range(i if same else 0, len(others)):
                out += _tile_sums(p, others[j], same and i == j, twice, bounds, robust, unit, least, room)
        return pa.table({"bin": pa.array(range(len(bounds) - 1), pa.int32()), "pairs": out[0].astype(np.int64), "far": out[1], "valued": out[2].astype(np.int64), "total": out[3]})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(measured, "bin int, pairs long, far double, valued long, total double")


def variogram(points: DataFrame, axes: Sequence[str], value: str, edges: Sequence[float], robust: bool = False, direction: Sequence[float] | None = None, tolerance: float = 22.5) -> DataFrame:
    """(bin, pairs, distance, gamma) for bins (lo, hi] of pair distance; empty bins are absent.

    robust: Cressie and Hawkins's estimator. direction: pairs within tolerance degrees of it, either way. Every pair is
    measured: those of cells with few points by a join, those of others as arrays, in blocks.
    """
    radius, least = float(edges[-1]), math.cos(math.radians(tolerance)) * (1 - 1e-12)
    g, c = ([f"{s}{j}" for j in range(len(axes))] for s in "gc")
    points = points.select("pid", *[F.col(a).cast("double").alias(f"axis{j}") for j, a in enumerate(axes)], F.col(value).cast("double").alias("value"))
    axes = [f"axis{j}" for j in range(len(axes))]
    there = " AND ".join(["pid IS NOT NULL", *[f"{a} IS NOT NULL AND NOT isnan({a})" for a in axes]])
    cells = points.where(there).select("*", *[F.floor(F.col(a) / F.lit(radius)).cast("long").alias(x) for a, x in zip(axes, g, strict=True)])
    sizes = cells.groupBy(*g).agg(F.count("*").alias("n"))
    dense = None
    if (sizes.agg(F.max("n")).first()[0] or 0) ** 2 > DENSE_PAIRS:
        near = sizes.select(*[F.col(x).alias(y) for x, y in zip(g, c, strict=True)], F.col("n").alias("m"))
        for x, y in zip(g, c, strict=True):
            near = near.select("*", F.explode(F.sequence(F.col(y) - 1, F.col(y) + 1)).alias(x))
        dense = saved(sizes.join(near, g).where(F.col("n") * F.col("m") > DENSE_PAIRS))
    pairs = pairs_within(points, axes, "value", radius, None if dense is None else dense.select(*g, *c))
    if direction is not None:
        norm = math.sqrt(sum(x * x for x in direction))
        along = F.abs(sum((F.col(f"d_{a}") * (x / norm) for a, x in zip(axes, direction, strict=True)), F.lit(0.0)))
        pairs = pairs.where(along >= F.col("distance") * least)
    pairs = pairs.withColumn("bin", sum((F.when(F.col("distance") > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0)) - 1).where("bin >= 0")
    kept = F.sqrt("gap") if robust else F.col("half_square")
    sums = pairs.groupBy("bin").agg(F.count("*").alias("pairs"), F.sum("distance").alias("far"), F.count(kept).alias("valued"), F.sum(kept).alias("total"))
    if dense is not None:
        # a pair of cells once
        first = F.struct(*g) <= F.struct(*c)
        sums = sums.unionByName(_dense_sums(cells, dense.where(first), axes, edges, robust, direction, least))
        sums = sums.groupBy("bin").agg(*[F.sum(x).alias(x) for x in ("pairs", "far", "valued", "total")]).where("pairs > 0")
    m, mean = F.col("pairs"), F.try_divide("total", "valued")
    gamma = 0.5 * F.pow(mean, 4) / (0.457 + 0.494 / m + 0.045 / m / m) if robust else mean
    return sums.select("bin", "pairs", (F.col("far") / m).alias("distance"), gamma.alias("gamma"))


def sparse_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, v) of the product of two coordinate tables; entries pre-aggregate before the shuffle."""
    x, y = a.select(F.col("row"), F.col("col").alias("k"), F.col("v").alias("x")), b.select(F.col("row").alias("k"), F.col("col"), F.col("v").alias("y"))
    return x.join(y, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def grid_interpolate(queries: DataFrame, nodes: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(qid, estimate): bilinear on a full rectilinear grid of nodes, extended at the edges by the outer cells.

    The axes, which are small next to the grid, come to the driver; corners are found by an equi-join on (x, y).
    """
    xs, ys = (sorted(float(r[0]) for r in nodes.select(c).distinct().limit(MAX_AXIS + 1).collect()) for c in (x, y))
    if max(len(xs), len(ys)) > MAX_AXIS:
        raise ValueError(f"an axis has over {MAX_AXIS} values")

    def bracket(c: str, at: list[float]) -> tuple[Column, Column]:
        arr = F.from_json(F.lit(str(at)), "array<double>")  # one literal, folded to an array
        k = F.greatest(F.lit(0), F.least(F.lit(len(at) - 2), F.size(F.filter(arr, lambda v: v <= F.col(c))) - 1))
        return F.get(arr, k), F.get(arr, k + 1)

    (x0, x1), (y0, y1) = bracket(x, xs), bracket(y, ys)
    q = queries.select("qid", F.col(x).alias("qx"), F.col(y).alias("qy"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    q = q.withColumn("s", (F.col("qx") - F.col("x0")) / (F.col("x1") - F.col("x0"))).withColumn("t", (F.col("qy") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    corners = F.expr("inline(array(struct(x0 AS cx, y0 AS cy, (1 - s) * (1 - t) AS w), struct(x1 AS cx, y0 AS cy, s * (1 - t) AS w), struct(x0 AS cx, y1 AS cy, (1 - s) * t AS w), struct(x1 AS cx, y1 AS cy, s * t AS w)))")
    at = nodes.select(F.col(x).cast("double").alias("cx"), F.col(y).cast("double").alias("cy"), F.col(value).alias("v"))
    return q.select("qid", corners).join(at, ["cx", "cy"]).groupBy("qid").agg(F.sum(F.col("w") * F.col("v")).alias("estimate"))


# queries


def _points(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("double").alias("v"))
    return e.where("x IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")


def _ask(s, d):
    return _points(s, d).select(F.col("pid").alias("qid"), (F.col("x") + 0.01).alias("x"), F.col("y"))


def _q_knn(s, d):
    return nearest(_ask(s, d), _points(s, d), ["x", "y"], 5).select("qid", "pid", F.round("distance", 7).alias("distance"), "rank")


def _q_knn_grid(s, d):
    p = _points(s, d)
    return _grid_nearest(_ask(s, d), p, ["x", "y"], 5, "qid", "pid", p.count()).select("qid", "pid", F.round("distance", 7).alias("distance"), "rank")


def _q_idw(s, d):
    return inverse_distance(_ask(s, d), _points(s, d), ["x", "y"], "v", 8).select("qid", F.round("estimate", 6).alias("estimate"))


def _q_loess(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    q = s.range(1, 21).select(F.col("id").alias("qid"), (900 + F.col("id") * 50.37).cast("double").alias("x"))
    return local_regression(q, p, "x", "y", 60).select("qid", F.round("estimate", 5).alias("estimate"))


def _boxes(s, d, name):
    if name == "a":
        return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x_lo"), (F.col("p_size") + 2.0).alias("x_hi"), F.col("p_retailprice").alias("y_lo"), (F.col("p_retailprice") + 25).alias("y_hi"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 50).cast("double").alias("x_lo"), (F.col("s_suppkey") % 50 + 1.0).alias("x_hi"), (1000 + F.col("s_acctbal") / 20).alias("y_lo"), (1040 + F.col("s_acctbal") / 20).alias("y_hi"))


def _q_boxes(s, d):
    return box_pairs(_boxes(s, d, "a"), _boxes(s, d, "b"), ["x", "y"], [4.0, 60.0])


def _q_asof(s, d):
    e = table(s, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    series = e.where("event_id % 3 <> 0").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    asked = e.where("event_id % 3 = 0").select(F.col("event_id").alias("qid"), "user_id", "t")
    return as_of(series, asked, ["user_id"], "t", "value").select("qid", F.round("estimate", 5).alias("estimate"))


def _q_overlap(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    j = li.join(o, "o_orderkey")
    month = F.lit("1996-06-01").cast("timestamp_ntz")
    return j.select("o_orderkey", "l_linenumber", overlap_seconds(F.col("o_orderdate"), F.col("l_shipdate"), month, F.lit("1996-06-30").cast("timestamp_ntz")).alias("seconds")).where("seconds > 0")


def _edges():
    return [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]


def _vario(df):
    return df.select("bin", "pairs", F.round("distance", 7).alias("distance"), F.round("gamma", 6).alias("gamma"))


def _q_grid(s, d):
    nodes = table(s, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).cast("double").alias("x"), F.floor(F.col("l_discount") * 50 + 1e-9).cast("double").alias("y")).agg(F.avg("l_extendedprice").alias("v"))
    q = s.range(40).select(F.col("id").alias("qid"), (F.col("id") % 8 * 0.73 - 0.3).cast("double").alias("x"), (F.col("id") % 5 * 1.19 - 0.2).cast("double").alias("y"))
    return grid_interpolate(q, nodes, "x", "y", "v").select("qid", F.round("estimate", 4).alias("estimate"))


def _q_product(s, d):
    li = table(s, d, "lineitem")
    a = li.groupBy((F.col("l_suppkey") % 20).alias("row"), (F.col("l_partkey") % 30).alias("col")).agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy((F.col("l_partkey") % 30).alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.count("*").cast("double").alias("v"))
    return sparse_product(a, b)


QUERIES = {
    "knn_topk": _q_knn, "knn_grid": _q_knn_grid, "idw_predict": _q_idw, "loess_points": _q_loess, "box_overlap": _q_boxes, "asof_interp": _q_asof, "interval_overlap": _q_overlap,
    "variogram_classical": lambda s, d: _vario(variogram(_points(s, d), ["x", "y"], "v", _edges())),
    "variogram_robust": lambda s, d: _vario(variogram(_points(s, d), ["x", "y"], "v", _edges(), robust=True)),
    "variogram_directional": lambda s, d: _vario(variogram(_points(s, d), ["x", "y"], "v", _edges(), direction=[1.0, 1.0], tolerance=30.0)),
    "variogram_cloud": lambda s, d: pairs_within(_points(s, d), ["x", "y"], "v", 0.02).select("i", "j", F.round("distance", 7).alias("distance"), "half_square"),
    "grid_interp": _q_grid, "sparse_product": _q_product,
}
_PT = "p AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::DOUBLE AS v FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL AND label IS NOT NULL), q AS (SELECT pid AS qid, x + 0.01 AS x, y FROM p)"
_NN = f"WITH {_PT}, n AS (SELECT qid, pid, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS d FROM q, p), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS k FROM n) SELECT qid, pid, round(d, 7) AS distance, k::INTEGER AS rank FROM r WHERE k <= 5"
_VG = f"WITH {_PT}, c AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, abs(a.v - b.v) AS g, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON a.pid < b.pid), w AS (SELECT *, (d > 0)::INT + (d > 0.02)::INT + (d > 0.04)::INT + (d > 0.06)::INT + (d > 0.08)::INT - 1 AS bin FROM c WHERE d <= 0.1 AND d > 0)"
SQL = {
    "knn_topk": _NN, "knn_grid": _NN,
    "idw_predict": f"WITH {_PT}, s AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM p), n AS (SELECT qid, pid, v, sqrt(pow((q.x - p.x) / sx, 2) + pow((q.y - p.y) / sy, 2)) AS d FROM q, p, s), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS k FROM n) SELECT qid, round(coalesce(avg(v) FILTER (d <= 1e-14), sum(v * pow(d, -2.5)) FILTER (d > 1e-14) / sum(pow(d, -2.5)) FILTER (d > 1e-14)), 6) AS estimate FROM r WHERE k <= 8 GROUP BY 1",
    "loess_points": "WITH q AS (SELECT i AS qid, 900 + i * 50.37::DOUBLE AS qx FROM range(1, 21) t(i)), n AS (SELECT qid, p_partkey AS pid, p_retailprice - qx AS u, abs(p_retailprice - qx) AS d, p_size::DOUBLE AS v FROM q, part), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS k FROM n), t AS (SELECT *, max(d) OVER (PARTITION BY qid) * (1 + 1e-10) AS h FROM r WHERE k <= 60), w AS (SELECT qid, u, v, pow(1 - pow(d / h, 3), 3) AS w FROM t), s AS (SELECT qid, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * v) AS t0, sum(w * u * v) AS t1 FROM w GROUP BY 1), g AS (SELECT *, 1e-10 * (s0 + s2) AS r FROM s) SELECT qid, round(((s2 + r) * t0 - s1 * t1) / ((s0 + r) * (s2 + r) - s1 * s1), 5) AS estimate FROM g",
    "box_overlap": "WITH a AS (SELECT p_partkey AS id, p_size::DOUBLE AS x0, p_size + 2.0 AS x1, p_retailprice AS y0, p_retailprice + 25 AS y1 FROM part), b AS (SELECT s_suppkey AS id, (s_suppkey % 50)::DOUBLE AS x0, s_suppkey % 50 + 1.0 AS x1, 1000 + s_acctbal / 20 AS y0, 1040 + s_acctbal / 20 AS y1 FROM supplier) SELECT a.id AS ida, b.id AS idb FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1",
    "asof_interp": "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value FROM events), s AS (SELECT user_id, t, max(value) AS v FROM e WHERE event_id % 3 <> 0 GROUP BY 1, 2), q AS (SELECT event_id AS qid, user_id, t FROM e WHERE event_id % 3 = 0), j AS (SELECT qid, q.t, arg_max(s.t, s.t) FILTER (s.t <= q.t) AS t0, arg_max(s.v, s.t) FILTER (s.t <= q.t) AS v0, arg_min(s.t, s.t) FILTER (s.t >= q.t) AS t1, arg_min(s.v, s.t) FILTER (s.t >= q.t) AS v1 FROM q LEFT JOIN s USING (user_id) GROUP BY 1, 2) SELECT qid, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 5) AS estimate FROM j",
    "interval_overlap": "SELECT l_orderkey AS o_orderkey, l_linenumber, s AS seconds FROM (SELECT l_orderkey, l_linenumber, greatest(0, epoch(least(l_shipdate, TIMESTAMP '1996-06-30'))::BIGINT - epoch(greatest(o_orderdate, TIMESTAMP '1996-06-01'))::BIGINT + 1) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE s > 0",
    "variogram_classical": f"{_VG} SELECT bin, count(*) AS pairs, round(avg(d), 7) AS distance, round(avg(0.5 * g * g), 6) AS gamma FROM w GROUP BY 1",
    "variogram_robust": f"{_VG} SELECT bin, count(*) AS pairs, round(avg(d), 7) AS distance, round(0.5 * pow(avg(sqrt(g)), 4) / (0.457 + 0.494 / count(*) + 0.045 / count(*) / count(*)), 6) AS gamma FROM w GROUP BY 1",
    "variogram_directional": f"{_VG} SELECT bin, count(*) AS pairs, round(avg(d), 7) AS distance, round(avg(0.5 * g * g), 6) AS gamma FROM w WHERE abs(dx + dy) / sqrt(2) >= d * cos(radians(30)) * (1 - 1e-12) GROUP BY 1",
    "variogram_cloud": f"WITH {_PT} SELECT a.pid AS i, b.pid AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 7) AS distance, 0.5 * (a.v - b.v) * (a.v - b.v) AS half_square FROM p a JOIN p b ON a.pid < b.pid WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02",
    "grid_interp": "WITH n AS (SELECT floor(l_quantity / 10) AS x, floor(l_discount * 50 + 1e-9) AS y, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), q AS (SELECT i AS qid, (i % 8 * 0.73 - 0.3)::DOUBLE AS x, (i % 5 * 1.19 - 0.2)::DOUBLE AS y FROM range(40) t(i)), b AS (SELECT *, greatest(0, least((SELECT max(x) FROM n) - 1, floor(x))) AS x0, greatest(0, least((SELECT max(y) FROM n) - 1, floor(y))) AS y0 FROM q) SELECT qid, round(sum((CASE WHEN n.x = x0 THEN x0 + 1 - b.x ELSE b.x - x0 END) * (CASE WHEN n.y = y0 THEN y0 + 1 - b.y ELSE b.y - y0 END) * v), 4) AS estimate FROM b JOIN n ON n.x IN (x0, x0 + 1) AND n.y IN (y0, y0 + 1) GROUP BY 1",
    "sparse_product": "WITH a AS (SELECT l_suppkey % 20 AS r, l_partkey % 30 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey % 30 AS r, l_linenumber::BIGINT AS c, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) SELECT a.r AS row, b.c AS col, sum(a.v * b.v) AS v FROM a JOIN b ON a.c = b.r GROUP BY 1, 2",
}
