"""Variograms without all pairs: a sample of pairs by shifts of a keyed order, and cells that stand for their points.

The sample numbers the points in the order of a hash and pairs each with the one a few shifts on: every unordered pair has
the same chance, no pair comes twice, and a number of points meets its partners by equal keys. With as many shifts as there
are, it is all pairs.

The other way compares cells of a grid that halves from level to level. The sums of a cell (count, values, squares,
coordinates) give the sum of squared differences over all pairs of two cells exactly, so only the bin of the pairs is in
question: two cells whose boxes' least and greatest distance lie in one bin are settled, others go on to their halves. What
is open at the last level goes to the bin of its root mean square distance, and is counted: a bin's true number of pairs
lies between least and most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.joins import squared_distance
from gramlake.session import saved, table

#: Rows of a part of the keyed order, which are numbered by one task; parts at most.
PART_ROWS, MAX_PARTS = 50_000, 65_536
#: Bits of a cell's place on an axis.
PLACE = 20


def _complete(points: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    """pid, axes and value as doubles, without rows in which one is null or NaN."""
    held = points.select("pid", *[F.col(c).cast("double").alias(c) for c in [*axes, value]])
    return held.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in [*axes, value]))


def keyed_numbers(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """rows with the column number: 0 to n - 1 in the order of the MD5 of key and seed (ties, which equal keys give, at will).

    The hash's first digits deal the rows to parts; the parts' counts come to the driver, which knows how far each begins.
    """
    digits = min(4, max(1, math.ceil(math.log2(max(n / PART_ROWS, 1)) / 4)))
    held = rows.withColumn("keyed", F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))).withColumn("part", F.substring("keyed", 1, digits))
    begins, at = [], 0
    for r in sorted(held.groupBy("part").count().collect()):
        begins.append((r[0], at))
        at += r[1]
    begins = rows.sparkSession.createDataFrame(begins, "part string, begins long")
    number = F.row_number().over(Window.partitionBy("part").orderBy("keyed")) - 1
    return held.withColumn("within", number).join(F.broadcast(begins), "part").withColumn("number", F.col("begins") + F.col("within")).drop("keyed", "part", "begins", "within")


def _bin(d: Column, edges: Sequence[float]) -> Column:
    """The bin (edges[k], edges[k + 1]] of a distance: -1 below, len(edges) - 1 above."""
    return sum((F.when(d > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0)) - 1


def sampled_variogram(points: DataFrame, axes: Sequence[str], value: str, edges: Sequence[float], max_pairs: int, seed: str = "pairs") -> DataFrame:
    """(bin, sampled, pairs, distance, gamma): about max_pairs pairs, at least one for each point, in bins (lo, hi] of distance.

    pairs is the unbiased estimate of the bin's number of all pairs; empty bins are absent. Rows (pid, axes, value) with a
    missing number take no part; fewer than two points give no rows.
    """
    held = _complete(points, axes, value)
    n = held.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], "bin int, sampled long, pairs double, distance double, gamma double")
    held = saved(keyed_numbers(held, "pid", seed, n))
    shifts = max(1, min(n // 2, max_pairs // n))
    left = held.select("number", *[F.col(a).alias(f"a_{a}") for a in axes], F.col(value).alias("va"))
    # shifts are spread evenly over 1 .. n / 2; the last of an even n pairs both ways, and is taken one way
    step = F.floor(F.lit(1) + F.col("k") * F.lit(n // 2) / F.lit(shifts)).cast("long")
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))).alias("k")).withColumn("step", step)
    left = left.where((F.col("step") * 2 < n) | (F.col("number") * 2 < n)).withColumn("partner", F.pmod(F.col("number") + F.col("step"), F.lit(n))).drop("number")
    right = held.select(F.col("number").alias("partner"), *[F.col(a).alias(f"b_{a}") for a in axes], F.col(value).alias("vb"))
    pairs = left.join(right, "partner").withColumn("d", F.sqrt(squared_distance([f"a_{a}" for a in axes], [f"b_{a}" for a in axes])))
    half = n % 2 == 0 and any(math.floor(1 + k * (n // 2) / shifts) * 2 == n for k in (shifts - 1, 0))
    taken = shifts * n - (n // 2 if half else 0)
    pairs = pairs.withColumn("bin", _bin(F.col("d"), edges)).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    return pairs.groupBy("bin").agg(F.count("*").alias("sampled"), (F.count("*") * F.lit(n * (n - 1) / 2 / taken)).alias("pairs"), F.avg("d").alias("distance"), (F.sum((F.col("va") - F.col("vb")) ** 2) / F.count("*") / 2).alias("gamma"))


def _merged(cells: DataFrame, axes: Sequence[str], by: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ["n", "s1", "s2", *[f"m_{a}" for a in axes], "q"]]
    return cells.groupBy(*by).agg(*sums, *[F.min(f"l_{a}").alias(f"l_{a}") for a in axes], *[F.max(f"h_{a}").alias(f"h_{a}") for a in axes])


def cell_variogram(points: DataFrame, axes: Sequence[str], value: str, edges: Sequence[float], levels: int = 6) -> DataFrame:
    """(bin, pairs, least, most, distance, gamma) from the sums of cells of a grid with 2^levels cells an axis.

    least and most bound the number of pairs with a distance in the bin (lo, hi]; distance is the root mean square of those
    placed there. Values count from their mean, so that squares do not cancel. Rows (pid, axes, value) with a missing number
    take no part; fewer than two points give no rows; bins that no pair may be in are absent.
    """
    held = _complete(points, axes, value)
    box = held.agg(F.avg(value).alias("mean"), *[f(a).alias(f"{a}_{m}") for a in axes for m, f in (("lo", F.min), ("hi", F.max))]).first()
    spark, last = points.sparkSession, len(edges) - 1
    if box["mean"] is None:
        return spark.createDataFrame([], "bin int, pairs long, least long, most long, distance double, gamma double")
    place = [F.least(F.lit((1 << levels) - 1).cast("long"), F.floor((F.col(a) - F.lit(box[f"{a}_lo"])) / F.lit(max(box[f"{a}_hi"] - box[f"{a}_lo"], 1e-300)) * (1 << levels)).cast("long")) for a in axes]
    v = F.col(value) - F.lit(box["mean"])
    at = [F.col(a) - F.lit(box[f"{a}_lo"]) for a in axes]
    rows = held.select(*[p.alias(f"g{j}") for j, p in enumerate(place)], F.lit(1).cast("long").alias("n"), v.alias("s1"), (v * v).alias("s2"), *[c.alias(f"m_{a}") for c, a in zip(at, axes, strict=True)], sum((c * c for c in at), F.lit(0.0)).alias("q"), *[c.alias(f"{s}_{a}") for c, a in zip(at, axes, strict=True) for s in "lh"])
    names = [f"g{j}" for j in range(len(axes))]
    cells = {levels: saved(_merged(rows, axes, names))}
    for k in range(levels - 1, -1, -1):
        up = cells[k + 1].withColumns({g: F.shiftright(g, 1) for g in names})
        cells[k] = _merged(up, axes, names)
    code = lambda of: sum((F.shiftleft(F.col(g), PLACE * j) for j, g in enumerate(of)), F.lit(0).cast("long"))
    # one table a level: a cell's code, its parent's, and its sums
    sums = ["n", "s1", "s2", *[f"m_{a}" for a in axes], "q", *[f"{s}_{a}" for s in "lh" for a in axes]]
    named = {k: c.withColumn("code", code(names)).withColumn("parent", sum((F.shiftleft(F.shiftright(g, 1), PLACE * j) for j, g in enumerate(names)), F.lit(0).cast("long"))) for k, c in cells.items()}
    side = lambda k, mark: named[k].select(F.col("code").alias(f"{mark}_code"), F.col("parent").alias(f"{mark}_parent"), *[F.col(c).alias(f"{mark}_{c}") for c in sums])
    same = F.col("a_code") == F.col("b_code")
    gap = [F.greatest(F.lit(0.0), F.col(f"a_l_{a}") - F.col(f"b_h_{a}"), F.col(f"b_l_{a}") - F.col(f"a_h_{a}")) for a in axes]
    reach = [F.greatest(F.col(f"a_h_{a}") - F.col(f"b_l_{a}"), F.col(f"b_h_{a}") - F.col(f"a_l_{a}")) for a in axes]
    norm = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    count = F.when(same, F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")).cast("long")
    square = F.when(same, F.col("a_n") * F.col("a_s2") - F.col("a_s1") ** 2).otherwise(F.col("b_n") * F.col("a_s2") + F.col("a_n") * F.col("b_s2") - 2 * F.col("a_s1") * F.col("b_s1"))
    far = F.when(same, F.col("a_n") * F.col("a_q") - sum((F.col(f"a_m_{a}") ** 2 for a in axes), F.lit(0.0))).otherwise(F.col("b_n") * F.col("a_q") + F.col("a_n") * F.col("b_q") - 2 * sum((F.col(f"a_m_{a}") * F.col(f"b_m_{a}") for a in axes), F.lit(0.0)))
    open_pairs, out = None, None
    for k in range(levels + 1):
        a, b = side(k, "a"), side(k, "b")
        if open_pairs is None:
            pairs = a.join(b, F.col("a_code") == F.col("b_code"))
        else:
            pairs = open_pairs.join(a, F.col("pa") == F.col("a_parent")).join(b, F.col("pb") == F.col("b_parent")).where((F.col("pa") != F.col("pb")) | (F.col("a_code") <= F.col("b_code")))
        pairs = pairs.select("a_code", "b_code", count.alias("pairs"), F.greatest(square, F.lit(0.0)).alias("square"), F.greatest(far, F.lit(0.0)).alias("far"), _bin(norm(gap), edges).alias("low"), _bin(norm(reach), edges).alias("high")).where((F.col("pairs") > 0) & (F.col("low") < last) & (F.col("high") >= 0))
        pairs = saved(pairs)
        settled = pairs.where("low = high") if k < levels else pairs.withColumn("mid", F.greatest("low", F.least("high", _bin(F.sqrt(F.col("far") / F.col("pairs")), edges))))
        settled = settled.select(F.col("low").alias("bin") if k < levels else F.col("mid").alias("bin"), "pairs", "square", "far", "low", "high")
        out = settled if out is None else out.unionByName(settled)
        open_pairs = pairs.where("low < high").select(F.col("a_code").alias("pa"), F.col("b_code").alias("pb"))
    most = out.select(F.explode(F.sequence(F.greatest("low", F.lit(0)), F.least("high", F.lit(last - 1)))).alias("bin"), "pairs").groupBy("bin").agg(F.sum("pairs").alias("most"))
    placed = out.groupBy("bin").agg(F.sum("pairs").alias("pairs"), F.sum(F.when(F.col("low") == F.col("high"), F.col("pairs")).otherwise(0)).alias("least"), F.sqrt(F.sum("far") / F.sum("pairs")).alias("distance"), (F.sum("square") / F.sum("pairs") / 2).alias("gamma"))
    zero = F.lit(0).cast("long")
    return most.join(placed, "bin", "left").select("bin", F.coalesce("pairs", zero).alias("pairs"), F.coalesce("least", zero).alias("least"), "most", "distance", "gamma")


# queries


def _points(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") * 7919 % 10007 / 10007).alias("x"), ((F.col("c_acctbal") + 1000) / 11000).alias("y"), (F.col("c_acctbal") / 1000 + F.col("c_nationkey")).alias("v"))


EDGES = (0.0, 0.05, 0.1, 0.2, 0.4, 0.8)


def _q_sampled(s, d, pairs=60_000):
    out = sampled_variogram(_points(s, d), ["x", "y"], "v", EDGES, pairs)
    return out.select("bin", "sampled", F.round("pairs", 3).alias("pairs"), F.round("distance", 8).alias("distance"), F.round("gamma", 6).alias("gamma"))


def _q_cells(s, d):
    out = cell_variogram(_points(s, d), ["x", "y"], "v", EDGES, levels=5)
    return out.select("bin", "pairs", "least", "most", F.round("distance", 7).alias("distance"), F.round("gamma", 6).alias("gamma"))


QUERIES = {"variogram_sampled": _q_sampled, "variogram_cells": _q_cells}
_P = "p AS MATERIALIZED (SELECT c_custkey AS pid, c_custkey * 7919 % 10007 / 10007 AS x, (c_acctbal + 1000) / 11000 AS y, c_acctbal / 1000 + c_nationkey AS v FROM customer)"
_BIN = lambda d: " + ".join(f"({d} > {e})::INT" for e in EDGES) + " - 1"
SQL = {
    "variogram_sampled": f"WITH {_P}, r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(pid || ':pairs')) - 1 AS i, count(*) OVER () AS n FROM p), t AS (SELECT n, greatest(1, least(n // 2, 60000 // n)) AS m FROM r LIMIT 1), s AS (SELECT n, m, floor(1 + k * (n // 2) / m)::BIGINT AS s FROM t, unnest(range(0, m)) AS u(k)), c AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.v - b.v) * (a.v - b.v) AS g FROM r a JOIN s ON 2 * s.s < s.n OR 2 * a.i < s.n JOIN r b ON b.i = (a.i + s.s) % s.n), w AS (SELECT *, {_BIN('d')} AS bin FROM c) SELECT bin, count(*) AS sampled, round(count(*) * (SELECT n * (n - 1) / 2 / (SELECT count(*) FROM c) FROM t), 3) AS pairs, round(avg(d), 8) AS distance, round(avg(g) / 2, 6) AS gamma FROM w WHERE bin BETWEEN 0 AND {len(EDGES) - 2} GROUP BY bin",
    "variogram_cells": f"WITH {_P}, z AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(v) AS v0 FROM p), g AS (SELECT x - x0 AS x, y - y0 AS y, v - v0 AS v, least(31, floor((x - x0) / (x1 - x0) * 32)) AS gx, least(31, floor((y - y0) / (y1 - y0) * 32)) AS gy FROM p, z), c AS MATERIALIZED (SELECT (gx + 32 * gy)::INT AS c, count(*) AS n, sum(v) AS s1, sum(v * v) AS s2, sum(x) AS mx, sum(y) AS my, sum(x * x + y * y) AS q, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM g GROUP BY 1), k AS (SELECT CASE WHEN a.c = b.c THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n, CASE WHEN a.c = b.c THEN a.n * a.s2 - a.s1 * a.s1 ELSE b.n * a.s2 + a.n * b.s2 - 2 * a.s1 * b.s1 END AS s, CASE WHEN a.c = b.c THEN a.n * a.q - a.mx * a.mx - a.my * a.my ELSE b.n * a.q + a.n * b.q - 2 * a.mx * b.mx - 2 * a.my * b.my END AS f, sqrt(pow(greatest(0, a.lx - b.hx, b.lx - a.hx), 2) + pow(greatest(0, a.ly - b.hy, b.ly - a.hy), 2)) AS d0, sqrt(pow(greatest(a.hx - b.lx, b.hx - a.lx), 2) + pow(greatest(a.hy - b.ly, b.hy - a.ly), 2)) AS d1 FROM c a JOIN c b ON a.c <= b.c), w AS MATERIALIZED (SELECT *, {_BIN('d0')} AS low, {_BIN('d1')} AS high FROM k WHERE n > 0), m AS (SELECT *, greatest(low, least(high, {_BIN('sqrt(greatest(f, 0) / n)')})) AS bin FROM w), u AS (SELECT b AS bin, sum(n)::BIGINT AS most FROM w, range({len(EDGES) - 1}) AS t(b) WHERE b BETWEEN low AND high GROUP BY 1), o AS (SELECT bin, sum(n)::BIGINT AS pairs, (coalesce(sum(n) FILTER (low = high), 0))::BIGINT AS least, sqrt(sum(greatest(f, 0)) / sum(n)) AS distance, sum(greatest(s, 0)) / sum(n) / 2 AS gamma FROM m GROUP BY 1) SELECT u.bin::INT AS bin, coalesce(pairs, 0) AS pairs, coalesce(least, 0) AS least, most, round(distance, 7) AS distance, round(gamma, 6) AS gamma FROM u LEFT JOIN o ON u.bin = o.bin",
}
