"""An order of points from far apart to close together, for any number of points: nested nets.

Level k keeps points more than r / 2^k apart and within r / 2^k of every point, among them all of the levels before, as a
farthest-first order does up to a factor of two. A level is found like an independent set in rounds: in each cell of a grid
whose diagonal is the level's distance the candidate of the least hash stands for the cell, and is kept if no stand-in
closer than that distance has a smaller one; what it covers is no candidate any more. A cell has one stand-in, so the joins
of a round meet a fixed number of rows a candidate, however dense the points are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.joins import squared_distance
from gramlake.session import saved, table

#: Kept points of a round up to which their join is a broadcast.
FEW = 50_000


def _celled(df: DataFrame, axes: Sequence[str], side: float) -> DataFrame:
    return df.withColumns({f"g{j}": F.floor(F.col(a) / F.lit(side)).cast("long") for j, a in enumerate(axes)})


def _around(df: DataFrame, axes: Sequence[str], mark: str) -> DataFrame:
    """df (with cells g0 ..) once for each cell in reach of its own, its columns marked."""
    reach = math.ceil(math.sqrt(len(axes)))
    out = df.select(*[F.col(c).alias(f"{mark}{c}") for c in df.columns])
    for j in range(len(axes)):
        out = out.withColumn(f"g{j}", F.explode(F.sequence(F.col(f"{mark}g{j}") - reach, F.col(f"{mark}g{j}") + reach)))
    return out


def nested_nets(points: DataFrame, key: str, axes: Sequence[str], levels: int, seed: int = 0) -> DataFrame:
    """(key, level, radius): the level from which on each point is kept, 0 to levels; levels + 1 for those within the last radius.

    The radius of level k is the diagonal of the points' box over 2^k. Of points at one place that of the least key stands
    for all; the others come last. Keys are longs; rows with a missing coordinate are left out.
    """
    held = points.select(F.col(key).cast("long").alias("key"), *[F.col(a).cast("double").alias(a) for a in axes]).where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in axes))
    box = held.agg(*[f(a).alias(f"{m}_{a}") for a in axes for m, f in (("l", F.min), ("h", F.max))]).first()
    spark = points.sparkSession
    if box[0] is None:
        return spark.createDataFrame([], f"{key} long, level int, radius double")
    diagonal = math.sqrt(sum((box[f"h_{a}"] - box[f"l_{a}"]) ** 2 for a in axes)) or 1.0
    first = held.groupBy(*axes).agg(F.min("key").alias("key"))
    every = saved(first.select("key", *[(F.col(a) - F.lit(box[f"l_{a}"])).alias(a) for a in axes], F.xxhash64("key", F.lit(seed)).alias("rank")))
    kept, out = None, None
    grid = [f"g{j}" for j in range(len(axes))]
    far2 = lambda r: squared_distance(axes, [f"o_{a}" for a in axes]) <= F.lit(r * r)
    for k in range(levels + 1):
        radius = diagonal / 2**k
        side = radius / math.sqrt(len(axes)) * (1 - 1e-12)

        def uncovered(rows: DataFrame, by: DataFrame, radius: float = radius, side: float = side) -> DataFrame:
            near = _around(_celled(by.select(*axes), axes, side), axes, "o_")
            near = F.broadcast(near) if by.count() <= FEW else near
            return rows.join(near, [*[rows[g] == near[g] for g in grid], far2(radius)], "left_anti")

        rows = _celled(every, axes, side)
        rows = saved(rows if kept is None else uncovered(rows, kept))
        while not rows.isEmpty():
            best = rows.groupBy(*grid).agg(F.min(F.struct("rank", "key", *axes)).alias("b")).select("b.*", *grid)
            other = _around(best.select("rank", "key", *axes, *grid), axes, "o_")
            less = F.struct("o_rank", "o_key") < F.struct("rank", "key")
            new = saved(best.join(other, [*[best[g] == other[g] for g in grid], less, far2(radius)], "left_anti").select("key", *axes, "rank"))
            level = new.select("key", F.lit(k).alias("level"))
            out = level if out is None else out.unionByName(level)
            kept = new if kept is None else kept.unionByName(new)
            rows = saved(uncovered(rows, new))
    out = held.select("key").join(out, "key", "left").withColumn("level", F.coalesce("level", F.lit(levels + 1)))
    return out.select(F.col("key").alias(key), "level", (F.lit(diagonal) / F.pow(F.lit(2.0), "level")).alias("radius"))


# queries


def _q_nets(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") * 7919 % 10007 / 10007).alias("x"), ((F.col("c_acctbal") + 1000) / 11000).alias("y"))
    return nested_nets(c, "pid", ["x", "y"], 6).select("pid", "level", F.round("radius", 9).alias("radius"))


QUERIES = {"nested_nets": _q_nets}
SQL: dict[str, str] = {}
