"""Designs of experiments, named test problems, folds, bootstrap and sensitivity: indices are planned, points are expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.session import table

Limits = Sequence[tuple[float, float]]


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts: the same whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) / float(1 << 52)


def _scaled(df: DataFrame, limits: Limits) -> DataFrame:
    return df.select("i", *[(F.lit(float(lo)) + F.col(f"u{j}") * float(hi - lo)).alias(f"x{j}") for j, (lo, hi) in enumerate(limits)])


def full_factorial(spark: SparkSession, limits: Limits, levels: Sequence[int]) -> DataFrame:
    """(i, x0, ...): the tensor grid, the last axis fastest; one level is the midpoint."""
    df, step = spark.range(math.prod(levels)).withColumnRenamed("id", "i"), math.prod(levels)
    for j, n in enumerate(levels):
        step //= n
        k = F.floor(F.col("i") / step) % n
        df = df.withColumn(f"u{j}", k / float(n - 1) if n > 1 else F.lit(0.5))
    return _scaled(df, limits)


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def halton(spark: SparkSession, n: int, limits: Limits, shift: Sequence[float] = ()) -> DataFrame:
    """(i, x0, ...): radical inverses of i + 1 in the first primes, shifted modulo one."""
    df = spark.range(n).withColumnRenamed("id", "i")
    for j, base in enumerate(_primes(len(limits))):
        digits = math.ceil(math.log(n + 2, base)) + 1
        u = sum((F.floor((F.col("i") + 1) / base**k) % base / float(base ** (k + 1)) for k in range(digits)), F.lit(0.0))
        df = df.withColumn(f"u{j}", (u + F.lit(float(shift[j] if shift else 0))) % 1)
    return _scaled(df, limits)


def random_points(spark: SparkSession, n: int, limits: Limits, seed: int = 0) -> DataFrame:
    df = spark.range(n).withColumnRenamed("id", "i")
    return _scaled(df.withColumns({f"u{j}": uniform(seed, F.col("i"), F.lit(j)) for j in range(len(limits))}), limits)


def _dealt(i: np.ndarray, n: int, seed: int, axis: int) -> np.ndarray:
    """Places of i in a permutation of 0 .. n - 1. A walk returns to where it started at the latest, so every walk ends inside."""
    half = np.uint64(max(1, math.ceil(math.log2(max(n, 2)) / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    v, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right = v[todo] >> half, v[todo] & mask
        for r in range(4):
            key = (seed * 0x9E3779B97F4A7C15 + axis * 0xC2B2AE3D27D4EB4F + r * 0x165667B19E3779F9) % (1 << 64)
            h = (right + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) ^ np.uint64(key)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        v[todo] = left << half | right
        todo = todo[v[todo] >= n]
    return v.astype(np.int64)


def latin_hypercube(spark: SparkSession, n: int, limits: Limits, seed: int = 0, centre: bool = False) -> DataFrame:
    """(i, x0, ...): each axis has one point in each of n strata. Strata are dealt by a keyed permutation of i that needs no sort:
    four rounds of a Feistel mix on a power-of-two range, walked until the value is inside n."""
    d = len(limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            i = t["i"].to_numpy()
            yield pd.DataFrame({"i": i} | {f"v{j}": _dealt(i, n, seed, j) for j in range(d)})

    df = spark.range(n).withColumnRenamed("id", "i").mapInPandas(run, "i long" + "".join(f", v{j} long" for j in range(d)))
    for j in range(d):
        jitter = F.lit(0.5) if centre else uniform(seed + 1, F.col("i"), F.lit(j))
        df = df.withColumn(f"u{j}", (F.col(f"v{j}") + jitter) / n).drop(f"v{j}")
    return _scaled(df, limits)


def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    """A row's fold, from the MD5 of its key and the seed: no shuffle, stable under reordering, the same in any engine."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % folds).cast("int")


def _poisson_steps() -> list[float]:
    """The cumulative Poisson(1) distribution from 0 to 11."""
    cdf, p, out = 0.0, math.exp(-1), []
    for k in range(12):
        cdf += p
        out.append(cdf)
        p /= k + 1
    return out


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, mean) of pairs bootstraps: each row enters each replicate a Poisson(1) number of times, the quantile of a number
    hashed (MD5) from its key, the replicate and the seed; one pass."""
    text = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("replicate").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    count = sum((F.when(u >= F.lit(c), 1).otherwise(0) for c in _poisson_steps()), F.lit(0))
    rows = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("n", count)
    return rows.groupBy("replicate").agg((F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("mean"))


#: inputs' ranges of the named problems.
PROBLEMS = {
    "branin": [(-5.0, 10.0), (0.0, 15.0)], "rosenbrock": [(-2.0, 2.0)] * 2, "sphere": [(-5.12, 5.12)] * 2, "ackley": [(-32.768, 32.768)] * 2,
    "hartmann3": [(0.0, 1.0)] * 3, "hartmann6": [(0.0, 1.0)] * 6, "ishigami": [(-math.pi, math.pi)] * 3, "friedman": [(0.0, 1.0)] * 5,
}
#: Fixed values of the Hartmann function in three inputs.
_H3_ALPHA = (1.0, 1.2, 3.0, 3.2)
_H3_A = ((3.0, 10.0, 30.0), (0.1, 10.0, 35.0), (3.0, 10.0, 30.0), (0.1, 10.0, 35.0))
_H3_P = ((0.3689, 0.1170, 0.2673), (0.4699, 0.4387, 0.7470), (0.1091, 0.8732, 0.5547), (0.0381, 0.5743, 0.8828))

#: Fixed values of the one in six inputs.
_H6_A = ((10.0, 3.0, 17.0, 3.5, 1.7, 8.0), (0.05, 10.0, 17.0, 0.1, 8.0, 14.0), (3.0, 3.5, 1.7, 10.0, 17.0, 8.0), (17.0, 8.0, 0.05, 10.0, 0.1, 14.0))
_H6_P = ((0.1312, 0.1696, 0.5569, 0.0124, 0.8283, 0.5886), (0.2329, 0.4135, 0.8307, 0.3736, 0.1004, 0.9991), (0.2348, 0.1451, 0.3522, 0.2883, 0.3047, 0.6650), (0.4047, 0.8828, 0.8732, 0.5743, 0.1091, 0.0381))


def problem(name: str, *x: Column) -> Column:
    """A named problem as an expression of its inputs."""
    if name == "branin":
        return (x[1] - 5.1 / (4 * math.pi**2) * x[0] ** 2 + 5 / math.pi * x[0] - 6) ** 2 + 10 * (1 - 1 / (8 * math.pi)) * F.cos(x[0]) + 10
    if name == "rosenbrock":
        return sum((100 * (b - a**2) ** 2 + (1 - a) ** 2 for a, b in zip(x, x[1:], strict=False)), F.lit(0.0))
    if name == "sphere":
        return sum((a**2 for a in x), F.lit(0.0))
    if name == "ackley":
        n = len(x)
        return -20 * F.exp(-0.2 * F.sqrt(sum((a**2 for a in x), F.lit(0.0)) / n)) - F.exp(sum((F.cos(2 * math.pi * a) for a in x), F.lit(0.0)) / n) + 20 + math.e
    if name in ("hartmann3", "hartmann6"):
        slopes, centres = (_H3_A, _H3_P) if name == "hartmann3" else (_H6_A, _H6_P)
        return -sum((c * F.exp(-sum((a * (v - p) ** 2 for a, p, v in zip(row, at, x, strict=True)), F.lit(0.0))) for c, row, at in zip(_H3_ALPHA, slopes, centres, strict=True)), F.lit(0.0))
    if name == "ishigami":
        return F.sin(x[0]) + 7 * F.sin(x[1]) ** 2 + 0.1 * x[2] ** 4 * F.sin(x[0])
    if name == "friedman":
        return 10 * F.sin(math.pi * x[0] * x[1]) + 20 * (x[2] - 0.5) ** 2 + 10 * x[3] + 5 * x[4]
    raise KeyError(f"unknown problem {name}; there are {sorted(PROBLEMS)}")


def ishigami_sobol(a: float = 7.0, b: float = 0.1) -> dict[str, list[float]]:
    """First and total indices of the Ishigami function in closed form."""
    v1, v2, v13 = 0.5 * (1 + b * math.pi**4 / 5) ** 2, a * a / 8, b * b * math.pi**8 * 8 / 225
    v = v1 + v2 + v13
    return {"first": [v1 / v, v2 / v, 0.0], "total": [(v1 + v13) / v, v2 / v, v13 / v]}


def sobol_indices(spark: SparkSession, name: str, n: int, seed: int = 0) -> DataFrame:
    """(input, first, total): Saltelli's and Jansen's estimators from n * (d + 2) evaluations, all expressions of the row index."""
    limits = PROBLEMS[name]
    d = len(limits)
    point = lambda which, j: F.lit(limits[j][0]) + uniform(seed + which, F.col("id"), F.lit(j)) * (limits[j][1] - limits[j][0])
    df = spark.range(n).withColumns({f"a{j}": point(1, j) for j in range(d)} | {f"b{j}": point(2, j) for j in range(d)})
    a, b = [F.col(f"a{j}") for j in range(d)], [F.col(f"b{j}") for j in range(d)]
    df = df.withColumns({"fa": problem(name, *a), "fb": problem(name, *b)} | {f"m{j}": problem(name, *[b[k] if k == j else a[k] for k in range(d)]) for j in range(d)})
    var = (F.var_pop("fa") + F.var_pop("fb")) / 2
    cells = [F.struct(F.lit(j).alias("input"), (F.avg(F.col("fb") * (F.col(f"m{j}") - F.col("fa"))) / var).alias("first"), (F.avg((F.col("fa") - F.col(f"m{j}")) ** 2) / 2 / var).alias("total")) for j in range(d)]
    return df.agg(F.array(*cells).alias("all")).select(F.inline("all"))


#: Multipliers that spread part keys over the axes of a problem.
SPREAD = (7919, 104729, 1299709, 15485863, 32452843, 49979687)


def _q_problems(s, d):
    """Every problem at inputs that the part keys give, one an axis."""
    part, out = table(s, d, "part"), None
    for name, limits in PROBLEMS.items():
        x = [F.lit(float(lo)) + F.col("p_partkey") * m % 1009 / 1009 * (hi - lo) for m, (lo, hi) in zip(SPREAD, limits, strict=False)]
        one = part.select(F.lit(name).alias("name"), F.col("p_partkey").alias("i"), F.round(problem(name, *x), 6).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def _limits(s, d):
    """Size and price between their ends in part, and the number of suppliers."""
    box = table(s, d, "part").agg(F.min("p_size").cast("double"), F.max("p_size").cast("double"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    return [(box[0], box[1]), (box[2], box[3])], table(s, d, "supplier").count()


def _q_factorial(s, d):
    limits, _ = _limits(s, d)
    levels = [table(s, d, "region").count(), table(s, d, "nation").count()]
    return full_factorial(s, [*limits, (5, 7)], [*levels, 1]).select("i", *[F.round(f"x{j}", 8).alias(f"x{j}") for j in range(3)])


def _q_halton(s, d):
    limits, n = _limits(s, d)
    return halton(s, n, limits).select("i", *[F.round(f"x{j}", 8).alias(f"x{j}") for j in range(2)])


def _q_hypercube(s, d, axis):
    limits, n = _limits(s, d)
    lo, hi = limits[axis]
    x = F.floor((F.col(f"x{axis}") - lo) / (hi - lo) * n + 1e-9).cast("long")
    return latin_hypercube(s, n, limits, 5).groupBy(x.alias("stratum")).agg(F.count("*").alias("points"))


def _q_random(s, d):
    limits, n = _limits(s, d)
    lo, hi = limits[1]
    return random_points(s, n, limits, 3).agg(F.count("*").alias("n"), F.count_if((F.col("x1") >= lo) & (F.col("x1") < hi)).alias("inside"), F.lit(hi).alias("upper"))


QUERIES = {
    "full_factorial": _q_factorial, "halton": _q_halton, "latin_hypercube": lambda s, d: _q_hypercube(s, d, 0), "latin_hypercube_axis2": lambda s, d: _q_hypercube(s, d, 1), "random_points": _q_random,
    "kfold_assign": lambda s, d: table(s, d, "orders").select("o_orderkey", fold_of(F.col("o_orderkey"), 5).alias("fold")),
    "bootstrap_means": lambda s, d: bootstrap_means(table(s, d, "orders"), "o_orderkey", "o_totalprice", 50).select("replicate", F.round("mean", 4).alias("mean")),
    "benchmark_problems": _q_problems, "sobol_monte_carlo": lambda s, d: sobol_indices(s, "ishigami", 20000),
}


def _prob_sql():
    cols = lambda name: ", ".join(f"{float(lo)!r}::DOUBLE + p_partkey * {m} % 1009 / 1009 * {hi - lo!r}::DOUBLE AS x{j}" for j, (m, (lo, hi)) in enumerate(zip(SPREAD, PROBLEMS[name], strict=False)))
    h = lambda slopes, centres: " + ".join(f"{c} * exp(-({' + '.join(f'{a} * (x{j} - {p}) * (x{j} - {p})' for j, (a, p) in enumerate(zip(row, at, strict=True)))}))" for c, row, at in zip(_H3_ALPHA, slopes, centres, strict=True))
    body = {
        "branin": "pow(x1 - 5.1 / (4 * pi() * pi()) * x0 * x0 + 5 / pi() * x0 - 6, 2) + 10 * (1 - 1 / (8 * pi())) * cos(x0) + 10",
        "rosenbrock": "100 * pow(x1 - x0 * x0, 2) + pow(1 - x0, 2)", "sphere": "x0 * x0 + x1 * x1",
        "ackley": "-20 * exp(-0.2 * sqrt((x0 * x0 + x1 * x1) / 2)) - exp((cos(2 * pi() * x0) + cos(2 * pi() * x1)) / 2) + 20 + exp(1)",
        "hartmann3": f"-({h(_H3_A, _H3_P)})", "hartmann6": f"-({h(_H6_A, _H6_P)})", "ishigami": "sin(x0) + 7 * pow(sin(x1), 2) + 0.1 * pow(x2, 4) * sin(x0)",
        "friedman": "10 * sin(pi() * x0 * x1) + 20 * pow(x2 - 0.5, 2) + 10 * x3 + 5 * x4",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS name, i, round({e}, 6) AS y FROM (SELECT p_partkey AS i, {cols(k)} FROM part)" for k, e in body.items())


def _halton_sql(base):
    return " + ".join(f"((i + 1) // {base**k}) % {base} / {base ** (k + 1)}.0::DOUBLE" for k in range(24 if base == 2 else 15))


_BOX = "b AS (SELECT min(p_size)::DOUBLE AS s0, max(p_size)::DOUBLE AS s1, min(p_retailprice) AS p0, max(p_retailprice) AS p1 FROM part), n AS (SELECT count(*) AS n FROM supplier)"
SQL = {
    "bootstrap_means": "WITH u AS (SELECT rep, o_totalprice AS v, ('0x' || substr(md5(o_orderkey || ':' || rep || ':0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM orders, range(50) t(rep)), n AS (SELECT rep, v, " + " + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in _poisson_steps()) + " AS n FROM u) SELECT rep::INTEGER AS replicate, round(sum(n * v) / sum(n), 4) AS mean FROM n GROUP BY 1",

    "kfold_assign": "SELECT o_orderkey, (('0x' || substr(md5(o_orderkey || ':0'), 1, 13))::BIGINT % 5)::INTEGER AS fold FROM orders",

    "full_factorial": f"WITH {_BOX}, l AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS k) SELECT i, round(s0 + (i // k) / (r - 1)::DOUBLE * (s1 - s0), 8) AS x0, round(p0 + (i % k) / (k - 1)::DOUBLE * (p1 - p0), 8) AS x1, 6.0::DOUBLE AS x2 FROM b, l, unnest(range(0, r * k)) AS u(i)",
    "halton": f"WITH {_BOX} SELECT i, round(s0 + ({_halton_sql(2)}) % 1 * (s1 - s0), 8) AS x0, round(p0 + ({_halton_sql(3)}) % 1 * (p1 - p0), 8) AS x1 FROM b, n, unnest(range(0, n)) AS u(i)",
    "latin_hypercube": "SELECT i AS stratum, 1::BIGINT AS points FROM range(0, (SELECT count(*) FROM supplier)) t(i)", "latin_hypercube_axis2": "SELECT row_number() OVER () - 1 AS stratum, 1::BIGINT AS points FROM supplier",
    "random_points": "SELECT (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM supplier) AS inside, max(p_retailprice) AS upper FROM part", "benchmark_problems": _prob_sql(),
}
