"""Fits of any number of rows that a few sums a round carry: quantile regression with standard errors, Kriging on inducing points.

Quantile regression: Newton steps on a check loss smoothed by the logistic function, one aggregate a step, come near the
optimum. Rows far from the plane then keep their side, so that two weighted rows stand for all of them; the rows near it,
merged where they are equal, are few enough for the exact fit, and one more aggregate shows that no far row changed sides.

Kriging: m centres are chosen by the largest residual variance that those before leave (a pivoted factorisation whose
pivot is one aggregate of the partitions' best). Likelihood and predictions need sums of m x m cross products alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.operators.additive import quantile_exact
from gramlake.operators.linear import fit_one
from gramlake.operators.models import KERNELS, _original, _standardised
from gramlake.session import saved, table

#: Rows near the plane that the exact fit takes, after equal ones are merged.
NEAR_ROWS = 1_500


def _plane(beta: np.ndarray, xs: Sequence[str]) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(xs, beta[1:], strict=True)), F.lit(float(beta[0])))


def _sums(data: DataFrame, xs: Sequence[str], first: Column, second: Column) -> tuple[np.ndarray, np.ndarray]:
    """Sums of first times (1, xs) and of second times their products: one aggregate on the JVM."""
    one = [F.lit(1.0), *[F.col(c) for c in xs]]
    p = len(one)
    r = data.select(*xs, first.alias("_g"), second.alias("_h")).agg(*[F.sum(F.col("_g") * a).alias(f"g{j}") for j, a in enumerate(one)], *[F.sum(F.col("_h") * one[i] * one[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    return np.array([r[f"g{j}"] for j in range(p)]), np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])


def quantile_large(df: DataFrame, xs: Sequence[str], y: str, tau: float, rounds: int = 40) -> dict:
    """Exact linear quantile regression with standard errors: coef (the constant first), cov, se, n, bandwidth, exact.

    cov is the sandwich tau (1 - tau) D^-1 J D^-1 with J the cross products of (1, xs) and D those weighted by a normal
    kernel of the residuals, of width 1.06 times their deviation times n^-1/5: errors need not be alike for all rows. exact
    is False where more distinct rows than NEAR_ROWS lie on the plane; the coefficients are then those of the smoothed loss.
    Rows with a missing number take no part. No rows raise.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*xs, y])]).dropna()
    if data.isEmpty():
        raise ValueError("no rows")
    data, m, s = _standardised(data, xs)
    data = saved(data)
    size = data.agg(F.count("*").alias("n"), F.stddev_pop(y).alias("s")).first()
    n, spread = size.n, size.s or 1.0
    beta = np.array(fit_one(data, list(xs), y)["coef"], float)
    h, least = spread / 2, spread * max(n, 10) ** -0.7
    narrow = 0  # rounds at the least width; among rows wider apart than it, steps go to and fro, and the exact fit goes on
    for _ in range(rounds):
        r = (F.col(y) - _plane(beta, xs)) / h
        up = 1 / (1 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), r))))  # the smoothed share of rows below
        g, hess = _sums(data, xs, F.lit(tau) - up, up * (1 - up) / h)
        step = np.linalg.lstsq(hess + 1e-10 * np.trace(hess) * np.eye(len(beta)), g, rcond=None)[0]
        beta = beta + step * min(1.0, 4 * h / max(np.abs(step).max(), 1e-300))
        narrow += h <= least
        if narrow and np.abs(step).max() < h or narrow > 4:
            break
        h = max(h / 2, least)
    exact = False
    for _ in range(12):
        r = F.col(y) - _plane(beta, xs)
        wide = float(data.select(F.abs(r).alias("r")).agg(F.percentile_approx("r", min(1.0, NEAR_ROWS / n), 100_000)).first()[0])
        for _ in range(100):  # a sketch of many rows misses the rank by more than 300: closer, until the rows are few
            near = data.where(F.abs(r) <= wide).groupBy(*xs, y).agg(F.count("*").cast("double").alias("_w"))
            rows = near.limit(NEAR_ROWS + 300).toPandas()
            if len(rows) < NEAR_ROWS + 300 or wide <= 1e-9 * spread:
                break
            wide *= 0.7
        if len(rows) >= NEAR_ROWS + 300:
            break
        far = data.select(*xs, r.alias("_r")).where(F.abs(F.col("_r")) > wide).groupBy((F.col("_r") > 0).alias("up")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in xs]).toPandas()
        x = np.vstack([rows[list(xs)].to_numpy(float), far[list(xs)].to_numpy(float)])
        w = np.append(rows["_w"], far["n"])
        away = np.where(far["up"], 1, -1) * 10.0 * (spread + wide)
        values = np.append(rows[y], np.hstack([np.ones((len(far), 1)), far[list(xs)].to_numpy(float)]) @ beta + away)
        new = quantile_exact(x, values, tau, w / w.max())
        moved = data.select(r.alias("a"), (F.col(y) - _plane(new, xs)).alias("b")).where((F.abs("a") > wide) & (F.signum("a") * F.col("b") < 0)).limit(1).count()
        beta = new
        if not moved:
            exact = True
            break
    r = F.col(y) - _plane(beta, xs)
    sd = data.agg(F.stddev_pop(r)).first()[0] or spread
    width = 1.06 * sd * n**-0.2
    _, d = _sums(data, xs, F.lit(0.0), F.exp(-(r / width) ** 2 / 2) / (width * math.sqrt(2 * math.pi)))
    _, j = _sums(data, xs, F.lit(0.0), F.lit(1.0))
    inv = np.linalg.pinv(d)
    # from standardised columns back to the given ones
    back = np.eye(len(beta))
    back[0, 1:], back[1:, 1:] = -m / s, np.diag(1 / s)
    cov = back @ (tau * (1 - tau) * inv @ j @ inv) @ back.T
    return {"coef": _original(beta, m, s), "cov": cov, "se": np.sqrt(np.diag(cov)).tolist(), "n": n, "bandwidth": width, "exact": exact}


# Kriging on inducing points


def _kernel(name: str, lengths: np.ndarray):
    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = np.sqrt(np.maximum((((a[:, None] - b[None]) / lengths) ** 2).sum(-1), 0))
        return KERNELS[name](r)

    return k


def greedy_centres(points: DataFrame, axes: Sequence[str], m: int, kernel: str, lengths: Sequence[float], batch: int = 8) -> np.ndarray:
    """Up to m centres (rows of axes), each where the ones before leave the largest residual variance; ties to the least
    coordinates. A pass lets every partition factorise its own rows for batch pivots; the driver chooses among these, so a
    pass sends batch rows a partition. Points that nothing is left of (equal to centres) are never chosen."""
    k = _kernel(kernel, np.asarray(lengths, float))

    def picks(x: np.ndarray, held: np.ndarray, count: int) -> np.ndarray:
        """Rows of x by greedy residuals, given the centres held."""
        x = np.unique(x, axis=0)
        left = np.ones(len(x))
        out = np.zeros((0, len(x)))
        if len(held):
            low = np.linalg.cholesky(k(held, held) + 1e-10 * np.eye(len(held)))
            out = np.linalg.solve(low, k(held, x))
            left = left - (out * out).sum(axis=0)
        chosen: list[int] = []
        while len(chosen) < min(count, len(x)):
            j = int(np.argmax(np.round(left, 12)))
            if left[j] < 1e-8:
                break
            new = (k(x[j : j + 1], x)[0] - out.T @ out[:, j]) / math.sqrt(left[j])
            out, left = np.vstack([out, new]), left - new * new
            left[j] = 0.0
            chosen.append(j)
        return x[chosen]

    held = np.zeros((0, len(axes)))
    while len(held) < m:

        def run(batches: Iterator[pd.DataFrame], held: np.ndarray = held) -> Iterator[pd.DataFrame]:
            best = np.zeros((0, len(axes)))
            for b in batches:
                best = picks(np.vstack([best, b[list(axes)].to_numpy(float)]), held, batch)
            yield pd.DataFrame(best, columns=list(axes))

        found = points.select(*axes).mapInPandas(run, ", ".join(f"{a} double" for a in axes)).toPandas()[list(axes)].to_numpy(float)
        new = picks(found, held, min(batch, m - len(held))) if len(found) else found
        if not len(new):
            break
        held = np.vstack([held, new])
    return held


def sparse_gp(points: DataFrame, axes: Sequence[str], y: str, m: int = 64, kernel: str = "squared_exponential", lengths: Sequence[float] | float = 1.0, sill: float = 1.0, noise: float = 0.1, centres: np.ndarray | None = None) -> dict:
    """The FITC posterior of a field with a constant mean (the average): centres, weights, what variances need, loglik.

    Each row's variance keeps what the centres leave of it, so that dense data do not make the posterior too sure. lengths
    may differ by axis. One pass sums n, m and m x m numbers a partition; missing numbers leave a row out.
    """
    lengths = np.broadcast_to(np.asarray(lengths, float), (len(axes),)).copy()
    data = points.select(*[F.col(c).cast("double").alias(c) for c in [*axes, y]]).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in [*axes, y]))
    mean = data.agg(F.avg(y)).first()[0]
    if mean is None:
        raise ValueError("no rows")
    z = greedy_centres(data, axes, m, kernel, lengths) if centres is None else np.asarray(centres, float)
    k = _kernel(kernel, lengths)
    kmm = sill * (k(z, z) + 1e-10 * np.eye(len(z)))
    low = np.linalg.cholesky(kmm)
    size = len(z)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, rest = np.zeros((size, size)), np.zeros(size), np.zeros(3)
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.iloc[lo : lo + 4096]
                kx = sill * k(z, part[list(axes)].to_numpy(float))
                v = np.linalg.solve(low, kx)
                lam = np.maximum(sill - (v * v).sum(axis=0), 0) + noise
                e = part[y].to_numpy(float) - mean
                a += (kx / lam) @ kx.T
                b += kx @ (e / lam)
                rest += [len(part), (e * e / lam).sum(), np.log(lam).sum()]
        yield pd.DataFrame({"slot": np.arange(size * size + size + 3), "v": np.concatenate([a.ravel(), b, rest])})

    got = data.mapInPandas(run, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas().sort_values("slot")["v"].to_numpy()
    a, b, (n, fit, logs) = got[: size * size].reshape(size, size), got[size * size : -3], got[-3:]
    full = kmm + a
    weights = np.linalg.solve(full, b)
    loglik = -0.5 * (logs + np.linalg.slogdet(full)[1] - np.linalg.slogdet(kmm)[1] + fit - b @ weights + n * math.log(2 * math.pi))
    return {"axes": list(axes), "centres": z, "mean": mean, "weights": weights, "less": np.linalg.inv(kmm) - np.linalg.inv(full), "kernel": kernel, "lengths": lengths, "sill": sill, "noise": noise, "n": int(n), "loglik": float(loglik)}


def sparse_predict(model: dict, queries: DataFrame, query_id: str = "qid") -> DataFrame:
    """(query_id, mean, variance) of the field (without noise) at each query; a map without a shuffle."""
    k = _kernel(model["kernel"], model["lengths"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kx = model["sill"] * k(b[model["axes"]].to_numpy(float), model["centres"])
            yield pd.DataFrame({query_id: b[query_id], "mean": model["mean"] + kx @ model["weights"], "variance": np.maximum(model["sill"] - np.einsum("ij,jk,ik->i", kx, model["less"], kx), 0)})

    return queries.select(query_id, *model["axes"]).mapInPandas(run, f"{query_id} long, mean double, variance double")


# queries


def _q_quantile(s, d):
    o = table(s, d, "orders").select("o_totalprice", *[(F.col("o_orderpriority") == p).cast("int").alias(n) for n, p in (("urgent", "1-URGENT"), ("high", "2-HIGH"))])
    rows = []
    for tau in (0.25, 0.9):
        m = quantile_large(o, ["urgent", "high"], "o_totalprice", tau)
        rows += [(tau, name, round(c, 4), round(e, 4)) for name, c, e in zip(("constant", "urgent", "high"), m["coef"], m["se"], strict=True)]
    return s.createDataFrame(rows, "tau double, term string, coef double, se double")


CENTRES = ((0.2, 0.3), (0.7, 0.6))


def _q_sparse(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") * 7919 % 10007 / 10007).alias("x"), (F.col("c_nationkey") / 25).alias("y"), (F.col("c_acctbal") / 5000).alias("v"))
    m = sparse_gp(c, ["x", "y"], "v", lengths=[0.5, 0.8], sill=0.7, noise=0.3, centres=CENTRES)
    return sparse_predict(m, c).select("qid", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


QUERIES = {"quantile_errors": _q_quantile, "kriging_inducing": _q_sparse}


def _sql_quantile() -> str:
    """With groups for inputs a fit is the groups' quantiles, and the sandwich is diagonal by groups."""
    one = """
SELECT {t}::DOUBLE AS tau, term, round(coef, 4) AS coef, round(se, 4) AS se FROM (
  WITH o AS (SELECT o_totalprice AS y, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS g FROM orders),
  q AS (SELECT g, quantile_disc(y, {t}) AS b FROM o GROUP BY g), r AS (SELECT g, y - b AS r FROM o JOIN q USING (g)),
  w AS (SELECT 1.06 * stddev_pop(r) * pow(count(*), -0.2) AS h FROM r),
  d AS (SELECT g, count(*) AS n, sum(exp(-pow(r / h, 2) / 2) / (h * sqrt(2 * pi()))) AS f FROM r, w GROUP BY g),
  v AS (SELECT g, b, {t} * (1 - {t}) * n / (f * f) AS v FROM d JOIN q USING (g))
  SELECT CASE a.g WHEN 0 THEN 'constant' WHEN 1 THEN 'urgent' ELSE 'high' END AS term, CASE a.g WHEN 0 THEN a.b ELSE a.b - z.b END AS coef, sqrt(CASE a.g WHEN 0 THEN a.v ELSE a.v + z.v END) AS se FROM v a, v z WHERE z.g = 0)"""
    return " UNION ALL ".join(one.format(t=t) for t in (0.25, 0.9))


def _sql_sparse() -> str:
    (x0, y0), (x1, y1) = CENTRES
    k = lambda x, y: f"0.7 * exp(-(pow((x - {x}) / 0.5, 2) + pow((y - {y}) / 0.8, 2)) / 2)"
    off = 0.7 * math.exp(-(((x0 - x1) / 0.5) ** 2 + ((y0 - y1) / 0.8) ** 2) / 2)
    dia = 0.7 * (1 + 1e-10)
    det = dia * dia - off * off
    return f"""
WITH c AS (SELECT c_custkey AS qid, c_custkey * 7919 % 10007 / 10007 AS x, c_nationkey / 25 AS y, c_acctbal / 5000 AS v FROM customer),
k AS (SELECT qid, v - avg(v) OVER () AS e, avg(v) OVER () AS m, {k(x0, y0)} AS a, {k(x1, y1)} AS b FROM c),
l AS (SELECT *, (a * a * {dia!r} - 2 * a * b * {off!r} + b * b * {dia!r}) / {det!r} AS q FROM k),
s AS (SELECT {dia!r} + sum(a * a / (0.7 - q + 0.3)) AS p, {off!r} + sum(a * b / (0.7 - q + 0.3)) AS r, {dia!r} + sum(b * b / (0.7 - q + 0.3)) AS t, sum(a * e / (0.7 - q + 0.3)) AS f, sum(b * e / (0.7 - q + 0.3)) AS g FROM l)
SELECT qid, round(m + (a * (t * f - r * g) + b * (p * g - r * f)) / (p * t - r * r), 6) AS mean, round(0.7 - q + (a * a * t - 2 * a * b * r + b * b * p) / (p * t - r * r), 6) AS variance FROM l, s
"""


SQL = {"quantile_errors": _sql_quantile(), "kriging_inducing": _sql_sparse()}
