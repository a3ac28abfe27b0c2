"""Models beyond least squares: iterated reweighting over grouped sums, order-based fits, and dense models on bounded groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions.special import box_cox, normal_ppf
from gramlake.operators.linear import fit_one, mean_column
from gramlake.operators.tables import percentiles
from gramlake.session import saved, table

#: Rows that one dense fit (a covariance matrix) takes; a larger group is an error, not a sample.
DENSE_ROWS = 2_000

# links and families, as expressions of the linear predictor or the mean

LINKS: dict[str, tuple[Callable, Callable, Callable]] = {  # inverse, derivative of eta by mu, link
    "identity": (lambda e: e, lambda m: F.lit(1.0), lambda m: m),
    "log": (F.exp, lambda m: 1 / m, F.log),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda m: 1 / (m * (1 - m)), lambda m: F.log(m / (1 - m))),
    "cloglog": (lambda e: 1 - F.exp(-F.exp(e)), lambda m: -1 / ((1 - m) * F.log(1 - m)), lambda m: F.log(-F.log(1 - m))),
    "inverse": (lambda e: 1 / e, lambda m: -1 / (m * m), lambda m: 1 / m),
    "inverse_squared": (lambda e: 1 / F.sqrt(e), lambda m: -2 / (m * m * m), lambda m: 1 / (m * m)),
    "sqrt": (lambda e: e * e, lambda m: 0.5 / F.sqrt(m), F.sqrt),
}
VARIANCES: dict[str, Callable[[Column], Column]] = {
    "gaussian": lambda m: F.lit(1.0), "poisson": lambda m: m, "binomial": lambda m: m * (1 - m), "gamma": lambda m: m * m, "inverse_gaussian": lambda m: m * m * m,
}
CANONICAL = {"gaussian": "identity", "poisson": "log", "binomial": "logit", "gamma": "log", "inverse_gaussian": "log"}


def negative_binomial(theta: float) -> Callable[[Column], Column]:
    return lambda m: m + m * m / theta


def tweedie(power: float) -> Callable[[Column], Column]:
    return lambda m: F.pow(m, F.lit(power))


def unit_deviance(family: str, y: Column, m: Column) -> Column:
    log_ratio = F.when(y > 0, y * F.log(y / m)).otherwise(0.0)
    if family == "gaussian":
        return (y - m) ** 2
    if family == "poisson":
        return 2 * (log_ratio - (y - m))
    if family == "binomial":
        return 2 * (log_ratio + F.when(y < 1, (1 - y) * F.log((1 - y) / (1 - m))).otherwise(0.0))
    if family == "gamma":
        return 2 * ((y - m) / m - F.log(y / m))
    return (y - m) ** 2 / (y * m * m)


def _weighted_gram(df: DataFrame, xs: Sequence[str], w: Column, z: Column, extra: Sequence[Column]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """X'WX, X'Wz and other sums in one aggregate; xs without the constant, which comes first."""
    names = ["1", *xs]
    col = {"1": F.lit(1.0)} | {c: F.col(c) for c in xs}
    df = df.withColumns({"__w": w, "__z": z})
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(F.array(*[F.sum(F.col("__w") * col[names[i]] * col[names[j]]) for i, j in pairs]).alias("g"), F.array(*[F.sum(F.col("__w") * col[c] * F.col("__z")) for c in names]).alias("v"), F.array(*[F.sum(e).cast("double") for e in extra]).alias("e")).first()
    gram = np.zeros((p, p))
    gram[np.triu_indices(p)] = row["g"]
    return gram + np.triu(gram, 1).T, np.array(row["v"], float), list(row["e"])


def _standardised(df: DataFrame, xs: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in xs], *[F.stddev_pop(c).alias(f"s_{c}") for c in xs]).first()
    m, s = np.array([row[f"m_{c}"] for c in xs]), np.array([row[f"s_{c}"] or 1.0 for c in xs])
    return df.withColumns({c: (F.col(c) - F.lit(float(a))) / F.lit(float(b)) for c, a, b in zip(xs, m, s, strict=True)}), m, s


def _original(beta: np.ndarray, m: np.ndarray, s: np.ndarray) -> list[float]:
    slope = beta[1:] / s
    return [float(beta[0] - slope @ m), *map(float, slope)]


def glm(df: DataFrame, xs: Sequence[str], y: str, family: str, link: str | None = None, tolerance: float = 1e-10, rounds: int = 30, variance: Callable | None = None) -> dict:
    """Fisher scoring: each round is one aggregate over the (cached) standardised inputs. Returns coef, deviance, rounds."""
    inverse, slope, forward = LINKS[link or CANONICAL[family]]
    variance = variance or VARIANCES[family]
    data, m, s = _standardised(df.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna(), xs)
    data = data.cache()
    try:
        start = data.agg(F.avg(y)).first()[0]
        mu0 = min(max(start, 1e-6), 1 - 1e-6) if family == "binomial" else start
        beta = np.zeros(len(xs) + 1)
        beta[0] = data.limit(1).select(forward(F.lit(float(mu0)))).first()[0]
        last = math.inf
        for k in range(rounds):
            eta = mean_column({"coef": list(map(float, beta))}, xs)
            mu = inverse(eta)
            g = slope(mu)
            gram, v, (dev,) = _weighted_gram(data, xs, 1 / (variance(mu) * g * g), eta + (F.col(y) - mu) * g, [unit_deviance(family, F.col(y), mu)])
            if abs(last - dev) <= tolerance * (abs(dev) + 0.1):
                break
            beta, last = np.linalg.solve(gram, v), dev
        return {"coef": _original(beta, m, s), "deviance": dev, "rounds": k, "n": data.count()}
    finally:
        data.unpersist()


TUNING = {"huber": 1.345, "bisquare": 4.685, "cauchy": 2.385}


def robust_weight(kind: str, u: Column) -> Column:
    """psi(u) / u of a standardised residual."""
    a, c = F.abs(u), TUNING[kind]
    if kind == "huber":
        return F.when(a <= c, 1.0).otherwise(c / a)
    if kind == "bisquare":
        return F.when(a < c, (1 - (u / c) ** 2) ** 2).otherwise(0.0)
    return 1 / (1 + (u / c) ** 2)


def robust(df: DataFrame, xs: Sequence[str], y: str, kind: str = "huber", rounds: int = 25, tolerance: float = 1e-8) -> dict:
    """Iterated reweighting with scale 1.4826 * median |r - median r|; bisquare starts from huber."""
    data, m, s = _standardised(df.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna(), xs)
    data = data.cache()
    try:
        beta = np.array(fit_one(data, xs, y)["coef"])
        for name in (["huber", kind] if kind == "bisquare" else [kind]):
            for _ in range(rounds):
                r = F.col(y) - mean_column({"coef": list(map(float, beta))}, xs)
                (centre,) = percentiles(data, r, [0.5])
                scale = 1.4826 * percentiles(data, F.abs(r - F.lit(centre)), [0.5])[0]
                gram, v, _ = _weighted_gram(data, xs, F.greatest(robust_weight(name, r / F.lit(max(scale, 1e-300))), F.lit(1e-12)), F.col(y), [])
                new = np.linalg.solve(gram, v)
                done = np.abs(new - beta).max() <= tolerance * np.abs(new).max()
                beta = new
                if done:
                    break
        return {"coef": _original(beta, m, s), "scale": scale}
    finally:
        data.unpersist()


def quantile_line(df: DataFrame, x: str, y: str, tau: float, rounds: int = 60) -> dict:
    """Linear quantile regression by reweighted least squares on a smoothed check loss, sharpened every round."""
    data, m, s = _standardised(df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna(), [x])
    data = data.cache()
    try:
        first = fit_one(data, [x], y)
        beta, eps = np.array(first["coef"]), math.sqrt(first["sigma2"])
        for _ in range(rounds):
            r = F.col(y) - mean_column({"coef": list(map(float, beta))}, [x])
            w = F.when(r >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(r), F.lit(eps))
            gram, v, _ = _weighted_gram(data, [x], w, F.col(y), [])
            new = np.linalg.solve(gram, v)
            moved = np.abs(new - beta).max()
            beta, eps = new, max(eps * 0.6, 1e-9 * math.sqrt(first["sigma2"]))
            if moved < 1e-7 * np.abs(new).max() and eps < 1e-6 * math.sqrt(first["sigma2"]):
                break
        r = F.col(y) - mean_column({"coef": list(map(float, beta))}, [x])
        loss = data.agg(F.sum(r * (F.lit(tau) - F.when(r < 0, 1.0).otherwise(0.0)))).first()[0]
        return {"coef": _original(beta, m, s), "loss": loss}
    finally:
        data.unpersist()


def pava(values: Sequence[float], weights: Sequence[float]) -> np.ndarray:
    """Weighted pool-adjacent-violators: blocks are merged while they fall."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.empty(0)


def isotonic(df: DataFrame, x: str, y: str, levels: int = 1_000_000) -> DataFrame:
    """(x, fitted): ties pooled by one aggregate; each range of x pools its falling blocks where it lies. A block stays as it is
    unless a range before reaches above it or a range after below; only the others, whose number is checked, come to the
    driver to be pooled again."""
    pooled = df.groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts and sum(map(len, parts)):
            rows = pd.concat(parts)
            fitted = pava(rows["y"], rows["w"])
            start = np.concatenate([[True], fitted[1:] != fitted[:-1]])
            lo = rows["x"].to_numpy()[start][np.cumsum(start) - 1]
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "x": rows["x"], "lo": lo, "mean": fitted, "w": rows["w"]})

    spark = df.sparkSession
    held = pooled.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(run, "part int, x double, lo double, mean double, w long")
    # ranges are sampled: written, so that every later read sees the same (kept in memory where no folder is set)
    held = held.checkpoint() if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) else held.cache()
    ends = held.groupBy("part").agg(F.min("lo").alias("lo"), F.min("mean").alias("first"), F.max("mean").alias("last")).toPandas().sort_values("lo")  # a row a partition
    if not len(ends):
        return held.select("x", F.col("mean").alias("fitted"))
    before = np.concatenate([[-np.inf], np.maximum.accumulate(ends["last"].to_numpy())[:-1]])
    after = np.concatenate([np.minimum.accumulate(ends["first"].to_numpy()[::-1])[::-1][1:], [np.inf]])
    limits = spark.createDataFrame([(int(p), float(a), float(b)) for p, a, b in zip(ends["part"], before, after, strict=True)], "part int, before double, after double")
    blocks = held.groupBy("part", "lo").agg(F.first("mean").alias("mean"), F.sum("w").alias("w"))
    loose = blocks.join(F.broadcast(limits), "part").where("before > mean OR mean > after").select("lo", "mean", "w").limit(levels + 1).toPandas().sort_values("lo")
    if len(loose) > levels:
        raise ValueError(f"more than {levels} blocks cross ranges: bin {x} first")
    again = spark.createDataFrame([(float(a), float(b)) for a, b in zip(loose["lo"], pava(loose["mean"], loose["w"]), strict=True)], "lo double, again double")
    return held.join(again, "lo", "left").select("x", F.coalesce("again", "mean").alias("fitted"))


def box_cox_profile(df: DataFrame, y: str, grid: Sequence[float]) -> DataFrame:
    """(lambda, log_lik): profile likelihood of each lambda with the Jacobian, all from one aggregate."""
    n = F.count("*")
    cells = [F.struct(F.lit(float(v)).alias("lambda"), (-n / 2 * F.log(F.var_pop(box_cox(F.col(y), v))) + (v - 1) * F.sum(F.log(y))).alias("log_lik")) for v in grid]
    return df.where(F.col(y) > 0).agg(F.array(*cells).alias("all")).select(F.inline("all"))


def kmeans(df: DataFrame, axes: Sequence[str], k: int, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, Column]:
    """Centres, and the assignment expression. Seeds by distance-weighted hash sampling; each round is one grouped aggregate."""
    centres = [np.array(df.orderBy(F.xxhash64(F.lit(seed), *axes)).select(*axes).first(), float)]

    def distance(c: np.ndarray) -> Column:
        return sum(((F.col(a) - F.lit(float(v))) ** 2 for a, v in zip(axes, c, strict=True)), F.lit(0.0))

    u = F.pmod(F.xxhash64(F.lit(seed + 1), *axes), F.lit(1 << 30)) / float(1 << 30) + 1e-12
    while len(centres) < k:
        d = F.least(*[distance(c) for c in centres]) if len(centres) > 1 else distance(centres[0])
        # exponential race: the least key is drawn with probability in proportion to d
        centres.append(np.array(df.where(d > 0).orderBy(-F.log(u) / d).select(*axes).first(), float))
    for _ in range(rounds):
        near = assignment(axes, centres)
        sums = {r["c"]: np.array([r[a] for a in axes]) for r in df.groupBy(near.alias("c")).agg(*[F.avg(a).alias(a) for a in axes]).collect()}
        new = [sums.get(j, c) for j, c in enumerate(centres)]
        if max(np.abs(a - b).max() for a, b in zip(new, centres, strict=True)) < 1e-12:
            break
        centres = new
    return np.array(centres), assignment(axes, centres)


def assignment(axes: Sequence[str], centres: Sequence[np.ndarray]) -> Column:
    cells = [F.struct(sum(((F.col(a) - F.lit(float(v))) ** 2 for a, v in zip(axes, c, strict=True)), F.lit(0.0)).alias("d"), F.lit(j).alias("c")) for j, c in enumerate(centres)]
    return F.array_min(F.array(*cells))["c"]


# kernels of scaled squared distance r2 or distance r

KERNELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "squared_exponential": lambda r: np.exp(-r * r / 2), "exponential": lambda r: np.exp(-r), "matern32": lambda r: (1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r),
    "matern52": lambda r: (1 + math.sqrt(5) * r + 5 * r * r / 3) * np.exp(-math.sqrt(5) * r), "spherical": lambda r: np.where(r < 1, 1 - 1.5 * r + 0.5 * r**3, 0.0),
    "rational_quadratic": lambda r: 1 / (1 + r * r / 2), "wendland": lambda r: np.maximum(1 - r, 0) ** 4 * (4 * r + 1), "cubic": lambda r: np.where(r < 1, 1 - 7 * r**2 + 8.75 * r**3 - 3.5 * r**5 + 0.75 * r**7, 0.0),
}


def kriging_fit(x: np.ndarray, y: np.ndarray, kernel: str, scale: float, nugget: float, count: np.ndarray | None = None, within: float = 0.0) -> dict:
    """Ordinary Kriging at a fixed correlation length: generalised mean, process variance, weights, exact leave-one-out.

    With count, each row stands for so many at one place with y their mean, and within is the sum of squares about the
    means: the covariance of all the rows has the same likelihood and predictions, by its inverse and determinant."""
    count = np.ones(len(x)) if count is None else np.asarray(count, float)
    n = count.sum()
    r = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)) / scale
    cov = KERNELS[kernel](r) + np.diag(nugget / count)
    inv = np.linalg.inv(cov)
    one = np.ones(len(x))
    mean = one @ inv @ y / (one @ inv @ one)
    alpha = inv @ (y - mean)
    q = inv - np.outer(inv @ one, inv @ one) / (one @ inv @ one)
    sigma2 = float(((y - mean) @ alpha + (within / nugget if within else 0.0)) / max(n - 1, 1))
    logdet = np.linalg.slogdet(cov)[1] + np.log(count).sum() + ((n - len(x)) * math.log(nugget) if n > len(x) else 0.0)
    restricted = -0.5 * ((n - 1) * math.log(max(sigma2, 1e-300)) + logdet + math.log(one @ inv @ one))
    return {"inv": inv, "mean": mean, "alpha": alpha, "sigma2": sigma2, "loo": (q @ y) / np.diag(q), "reml": restricted}


def kriging(points: DataFrame, queries: DataFrame, by: str, axes: Sequence[str], y: str, kernel: str = "exponential", nugget: float = 1e-6) -> DataFrame:
    """(by, qid, mean, variance) by ordinary Kriging in each group, the correlation length by restricted likelihood on a grid.

    Rows at one place come as their count, mean and sum of squares, which changes nothing, so that groups have any number of
    rows at up to DENSE_ROWS places; more raise, since a dense covariance does not split. Rows that lack a number take no
    part. nugget is positive.
    """

    def run(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(p) > DENSE_ROWS:
            raise ValueError(f"group {key} has points at {len(p)} places, over {DENSE_ROWS}: use local neighbours")
        if not len(p) or not len(q):
            return pd.DataFrame({by: [], "qid": [], "mean": [], "variance": []})
        p = p.sort_values(list(axes))
        x, v, count, within = p[list(axes)].to_numpy(float), p["_mean"].to_numpy(float), p["_n"].to_numpy(float), float(p["_within"].sum())
        span = max(float(np.ptp(x, axis=0).max()), 1e-12)
        best = max((kriging_fit(x, v, kernel, s * span, nugget, count, within) | {"scale": s * span} for s in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)), key=lambda m: m["reml"])
        at = q[list(axes)].to_numpy(float)
        c = KERNELS[kernel](np.sqrt(((at[:, None] - x[None]) ** 2).sum(-1)) / best["scale"])
        one = best["inv"].sum(0)
        gap = 1 - c @ one
        var = best["sigma2"] * np.maximum(1 - np.einsum("ij,jk,ik->i", c, best["inv"], c) + gap**2 / one.sum(), 0)
        return pd.DataFrame({by: key[0], "qid": q["qid"], "mean": best["mean"] + c @ best["alpha"], "variance": var})

    kind = points.schema[by].dataType.simpleString()
    rows = points.select(by, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*axes, y])]).dropna(subset=list(dict.fromkeys([*axes, y])))
    places = rows.groupBy(by, *axes).agg(F.count("*").alias("_n"), F.avg(y).alias("_mean"), (F.var_pop(y) * F.count("*")).alias("_within"))
    return places.groupBy(by).cogroup(queries.groupBy(by)).applyInPandas(run, f"`{by}` {kind}, qid long, mean double, variance double")


def not_a_knot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the not-a-knot cubic through (x, y)."""
    n, h = len(x), np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    if n < 4:  # one parabola or line
        a[0, 0] = a[-1, -1] = 1
        a[0, 1] = a[-1, -2] = -1 if n == 3 else 0
        return np.linalg.solve(a, b) if n == 3 else np.zeros(n)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(a, b)


def cubic_value(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    m = not_a_knot(x, y)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    s, t = (x[k + 1] - at) / h, (at - x[k]) / h
    return s * y[k] + t * y[k + 1] + h * h / 6 * ((s**3 - s) * m[k] + (t**3 - t) * m[k + 1])


def p_spline(x: np.ndarray, y: np.ndarray, lo: float, hi: float, segments: int, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients of a cubic P-spline and its effective degrees of freedom."""
    b = b_spline(x, lo, hi, segments)
    d = np.diff(np.eye(b.shape[1]), 2, axis=0)
    g = b.T @ b
    inv = np.linalg.inv(g + penalty * d.T @ d)
    return inv @ b.T @ y, float(np.trace(inv @ g))


def b_spline(x: np.ndarray, lo: float, hi: float, segments: int) -> np.ndarray:
    """Uniform cubic B-splines on [lo, hi], segments + 3 columns."""
    t = np.clip((np.asarray(x, float) - lo) / (hi - lo) * segments, 0, segments * (1 - 1e-15))
    k = np.minimum(t.astype(int), segments - 1)
    u = t - k
    part = np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3]) / 6
    out = np.zeros((len(t), segments + 3))
    for j in range(4):
        out[np.arange(len(t)), k + j] = part[j]
    return out


def spline_groups(df: DataFrame, by: str, x: str, y: str, segments: int = 8) -> DataFrame:
    """(by, x, fitted, edf): a P-spline in each group, its penalty by generalised cross-validation. Sums are per x level first."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("x")
        w = np.sqrt(p["n"].to_numpy(float))
        xv, yv = p["x"].to_numpy(float), p["y"].to_numpy(float)
        b = b_spline(xv, xv.min(), max(xv.max(), xv.min() + 1e-9), segments)
        d = np.diff(np.eye(b.shape[1]), 2, axis=0)
        bw, yw = b * w[:, None], yv * w
        n, best = p["n"].sum(), None
        for log_pen in np.arange(-4, 8.1, 0.5):
            inv = np.linalg.pinv(bw.T @ bw + 10**log_pen * d.T @ d)
            coef, edf = inv @ bw.T @ yw, float(np.trace(inv @ bw.T @ bw))
            score = n * (((yw - bw @ coef) ** 2).sum() + p["within"].sum()) / max(n - edf, 1e-9) ** 2
            if best is None or score < best[0]:
                best = score, coef, edf
        return pd.DataFrame({by: key[0], "x": xv, "fitted": b @ best[1], "edf": best[2]})

    level = df.groupBy(by, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("n"), (F.var_pop(y) * F.count("*")).alias("within"))
    return level.groupBy(by).applyInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, x double, fitted double, edf double")


def mixed_intercepts(df: DataFrame, group: str, x: str, y: str, rounds: int = 80) -> dict:
    """Random-intercept model by restricted likelihood from group sums: one aggregate, then a one-parameter search."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))

    def at(ratio: float) -> tuple[float, np.ndarray, float]:
        # V = s2 (I + ratio 11'): its inverse takes ratio / (1 + n ratio) of the group's sums off
        k = F.lit(ratio) / (1 + F.col("n") * ratio)
        s = g.agg(*[F.sum(e) for e in (F.col("n") - k * F.col("n") ** 2, F.col("sx") - k * F.col("n") * F.col("sx"), F.col("sxx") - k * F.col("sx") ** 2, F.col("sy") - k * F.col("n") * F.col("sy"), F.col("sxy") - k * F.col("sx") * F.col("sy"), F.col("syy") - k * F.col("sy") ** 2, F.col("n"), F.log(1 + F.col("n") * ratio))]).first()
        a, b = np.array([[s[0], s[1]], [s[1], s[2]]]), np.array([s[3], s[4]])
        beta = np.linalg.solve(a, b)
        s2 = (s[5] - beta @ b) / (s[6] - 2)
        return -0.5 * ((s[6] - 2) * math.log(s2) + s[7] + np.linalg.slogdet(a)[1]), beta, s2

    g = g.cache()
    try:
        lo, hi, gold = -12.0, 6.0, (math.sqrt(5) - 1) / 2
        c, d = hi - gold * (hi - lo), lo + gold * (hi - lo)
        fc, fd = at(math.exp(c))[0], at(math.exp(d))[0]
        for _ in range(rounds):
            if hi - lo < 1e-4:
                break
            if fc > fd:
                hi, d, fd = d, c, fc
                c = hi - gold * (hi - lo)
                fc = at(math.exp(c))[0]
            else:
                lo, c, fc = c, d, fd
                d = lo + gold * (hi - lo)
                fd = at(math.exp(d))[0]
        ratio = math.exp((lo + hi) / 2)
        ll, beta, s2 = at(ratio)
        return {"coef": list(map(float, beta)), "residual_variance": s2, "group_variance": s2 * ratio, "icc": ratio / (1 + ratio)}
    finally:
        g.unpersist()


def nid_band(tau: float, n: int, alpha: float = 0.05) -> float:
    """Bandwidth of Hall and Sheather for a quantile's density."""
    z, q = normal_ppf(1 - alpha / 2), normal_ppf(tau)
    f = math.exp(-q * q / 2) / math.sqrt(2 * math.pi)
    return n ** (-1 / 3) * z ** (2 / 3) * (1.5 * f * f / (2 * q * q + 1)) ** (1 / 3)


def practical_range(kernel: str, scale: float) -> float:
    """Distance at which a variogram of this kernel reaches 95 % of its partial sill; its end for compact ones."""
    if kernel in ("spherical", "wendland", "cubic"):
        return scale
    lo, hi = 0.0, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if KERNELS[kernel](np.array(mid)) > 0.05 else (lo, mid)
    return scale * (lo + hi) / 2


def fit_variogram(bins: Sequence[tuple[float, float, int]], kernel: str = "exponential") -> dict:
    """Nugget, partial sill and range of (distance, gamma, pairs) bins by weighted least squares: linear in two, searched in one."""
    h, g, m = (np.array(c, float) for c in zip(*bins, strict=True))
    if len(h) < 3:
        raise ValueError("a variogram fit needs three bins")
    w, best = m.copy(), None
    for _ in range(6):
        best = None
        for scale in np.geomspace(h.max() / 100, h.max() * 3, 600):
            a = np.stack([np.ones_like(h), 1 - KERNELS[kernel](h / scale)], 1)
            coef = np.linalg.lstsq(a * np.sqrt(w)[:, None], g * np.sqrt(w), rcond=None)[0]
            if coef[0] < 0 or coef[1] < 0:  # on the edge: without a nugget, or flat
                one = [np.array([0, max((w * a[:, 1] * g).sum() / (w * a[:, 1] ** 2).sum(), 0)]), np.array([(w * g).sum() / w.sum(), 0])]
                coef = min(one, key=lambda c: (w * (g - a @ c) ** 2).sum())
            loss = float((w * (g - a @ coef) ** 2).sum())
            if best is None or loss < best[0]:
                best = loss, scale, coef, a @ coef
        w = m / np.maximum(best[3], 1e-300) ** 2
    return {"nugget": float(best[2][0]), "sill": float(best[2][1]), "range": float(best[1]), "practical_range": practical_range(kernel, float(best[1]))}


# queries


def _counts(s, d):
    e = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("y"), F.avg("value").alias("v"))
    return e.select(F.dayofmonth("day").cast("double").alias("x"), "y", "v")


def _one(s, m, k=5):
    return s.createDataFrame([tuple(round(float(v), k) for v in m["coef"])], "intercept double, slope double")



def _q_dense(s, d):
    p = table(s, d, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 17).cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    q = s.range(4).select(F.col("id").alias("qid"), (F.col("id") * 4.1).cast("double").alias("x"), F.explode(F.array(*[F.lit(k) for k in range(25)])).alias("g"))
    return kriging(p, q, "g", ["x"], "y", nugget=0.1)


def _q_iso(s, d):
    return isotonic(table(s, d, "part"), "p_size", "p_retailprice").select("x", F.round("fitted", 5).alias("fitted"))


def _q_boxcox(s, d):
    return box_cox_profile(table(s, d, "orders"), "o_totalprice", [-1.0, -0.5, 0.0, 0.5, 1.0]).select("lambda", F.round(F.col("log_lik") / 1e3, 6).alias("log_lik_k"))


def _q_poisson(s, d):
    return _one(s, glm(_counts(s, d), ["x"], "y", "poisson"), 6)


def _q_logit(s, d):
    o = table(s, d, "orders").select((F.col("o_totalprice") / 1e5).alias("x"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return _one(s, glm(o, ["x"], "y", "binomial"), 6)


def _q_gamma(s, d):
    return _one(s, glm(table(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")).where("y > 0"), ["x"], "y", "gamma"), 6)


def _q_mixed(s, d):
    m = mixed_intercepts(table(s, d, "events").select("user_id", F.hour("ts").cast("double").alias("x"), "value"), "user_id", "x", "value")
    return s.createDataFrame([(k, float(v)) for k, v in m.items() if k != "coef"], "name string, value double")


def _q_variogram_fit(s, d):
    from gramlake.operators.joins import _edges, _points, variogram

    bins = [(r["distance"], r["gamma"], r["pairs"]) for r in variogram(_points(s, d), ["x", "y"], "v", _edges()).orderBy("bin").collect()]
    return s.createDataFrame([(k, float(v)) for k, v in fit_variogram(bins).items()], "name string, value double")


def _q_kmeans(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    _, near = kmeans(p, ["x", "y"], 4)
    return p.groupBy(near.alias("cluster")).agg(F.count("*").alias("n"))


def poisson_draw(h: Column) -> Column:
    """A Poisson count of mean one by inversion of a 64-bit hash."""
    total, share, out, steps = 0.0, math.exp(-1), None, []
    for k in range(17):
        total += share
        share /= k + 1
        steps.append((k, min(int(total * 2.0**64) - 2**63, 2**63 - 1)))
    for k, top in steps:
        out = F.when(h < F.lit(top), F.lit(k)) if out is None else out.when(h < F.lit(top), F.lit(k))
    return out.otherwise(F.lit(17))


def forest_cells(df: DataFrame, inputs: Sequence[str], label: str, row: Sequence[str], trees: int) -> DataFrame:
    """(tree, inputs, n, y): every row's bootstrap count in each tree, summed by equal inputs, and the mean label by these counts;
    tree -1 counts every row once.

    A squared-error tree depends on rows with equal inputs only by their number and mean. Counts are Poisson, by a hash of
    the columns row and the tree, whatever the partitions."""
    each = df.select(*inputs, F.col(label).alias("y"), *[F.col(c).alias(f"_{c}") for c in row], F.explode(F.sequence(F.lit(-1), F.lit(trees - 1))).alias("tree"))
    each = each.withColumn("n", F.when(F.col("tree") < 0, F.lit(1)).otherwise(poisson_draw(F.xxhash64(*[f"_{c}" for c in row], "tree")))).where("n > 0")
    return each.groupBy("tree", *inputs).agg(F.sum("n").cast("double").alias("n"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("y"))


def _forest(s, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    inputs, trees = ["l_quantity", "l_discount", "l_tax"], 20
    df = table(s, d, "lineitem").select(*inputs, F.col("l_extendedprice").alias("label"), "l_orderkey", "l_linenumber").dropna(subset=[*inputs, "label"])
    train, test = df.where("l_orderkey % 4 <> 0"), df.where("l_orderkey % 4 = 0")
    assembled = VectorAssembler(inputCols=inputs, outputCol="x").transform
    cells = saved(assembled(forest_cells(train, inputs, "label", ["l_orderkey", "l_linenumber"], trees)))
    # a test cell's rows have one prediction: their squared errors are those of the mean and the spread about it
    held = saved(assembled(test.groupBy(*inputs).agg(F.count("*").alias("n"), F.avg("label").alias("mean"), F.var_pop("label").alias("spread"))))
    out = None
    for name in ("random_forest", "gradient_boosting"):
        if name == "random_forest":  # a tree of its own bootstrap each, with a third of the inputs at a node
            one = held
            for t in range(trees):
                m = RandomForestRegressor(featuresCol="x", labelCol="y", weightCol="n", predictionCol=f"p{t}", numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", seed=t + 1)
                one = m.fit(cells.where(F.col("tree") == t)).transform(one)
            one = one.withColumn("p", sum((F.col(f"p{t}") for t in range(trees)), F.lit(0.0)) / trees)
        else:
            one = GBTRegressor(featuresCol="x", labelCol="y", weightCol="n", predictionCol="p", maxIter=10, seed=1).fit(cells.where("tree = -1")).transform(held)
        one = one.agg(F.lit(name).alias("model"), F.sum("n").alias("n"), F.sqrt(F.sum(F.col("n") * (F.col("spread") + (F.col("mean") - F.col("p")) ** 2)) / F.sum("n")).alias("rmse"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "glm_poisson": _q_poisson, "glm_binomial": _q_logit, "glm_gamma": _q_gamma, "isotonic": _q_iso, "boxcox_loglik": _q_boxcox,
    "robust_huber": lambda s, d: _one(s, robust(table(s, d, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")), ["x"], "y"), 6),
    "robust_bisquare": lambda s, d: _one(s, robust(table(s, d, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")), ["x"], "y", "bisquare"), 6),
    "quantile_regression": lambda s, d: _one(s, quantile_line(table(s, d, "part"), "p_size", "p_retailprice", 0.75), 4),
    "kriging_groups": _q_dense, "mixed_intercepts": _q_mixed, "variogram_fit": _q_variogram_fit, "kmeans": _q_kmeans, "tree_ensembles": _forest,
    "spline_groups": lambda s, d: spline_groups(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"),
}


def _irls_sql(source: str, start: str, w: str, z: str, rounds: int) -> str:
    """rounds of reweighting unrolled as common table expressions; w and z in terms of x, y, a, b."""
    parts = [f"d AS ({source})", f"b0 AS ({start})"]
    for k in range(rounds):
        parts.append(f"s{k} AS (SELECT {w} AS w, x, {z} AS z FROM d, b{k})")
        parts.append(f"m{k} AS (SELECT sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz FROM s{k})")
        parts.append(f"b{k + 1} AS (SELECT any_value(mz) - sum(w * (x - mx) * (z - mz)) / sum(w * (x - mx) * (x - mx)) * any_value(mx) AS a, sum(w * (x - mx) * (z - mz)) / sum(w * (x - mx) * (x - mx)) AS b FROM s{k}, m{k})")
    return "WITH " + ", ".join(parts) + f" SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM b{rounds}"


_E = "exp(a + b * x)"
_G = "(1 / (1 + exp(-(a + b * x))))"
SQL = {
    "glm_poisson": _irls_sql("SELECT day(ts)::DOUBLE AS x, count(*)::DOUBLE AS y FROM events GROUP BY user_id, ts::DATE, day(ts)", "SELECT ln(avg(y)) AS a, 0.0::DOUBLE AS b FROM d", _E, f"a + b * x + (y - {_E}) / {_E}", 8),
    "glm_binomial": _irls_sql("SELECT o_totalprice / 1e5 AS x, (o_orderstatus = 'F')::INT::DOUBLE AS y FROM orders", "SELECT ln(avg(y) / (1 - avg(y))) AS a, 0.0::DOUBLE AS b FROM d", f"{_G} * (1 - {_G})", f"a + b * x + (y - {_G}) / ({_G} * (1 - {_G}))", 8),
    "glm_gamma": _irls_sql("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_extendedprice > 0", "SELECT ln(avg(y)) AS a, 0.0::DOUBLE AS b FROM d", "1.0::DOUBLE", f"a + b * x + (y - {_E}) / {_E}", 14),
    "isotonic": "WITH g AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y, count(*) AS w FROM part GROUP BY 1), r AS (SELECT a.x AS lo, b.x AS hi, sum(g.w * g.y) / sum(g.w) AS m FROM g a JOIN g b ON a.x <= b.x JOIN g ON g.x BETWEEN a.x AND b.x GROUP BY 1, 2), t AS (SELECT g.x, r.lo, min(r.m) AS m FROM g JOIN r ON r.lo <= g.x AND r.hi >= g.x GROUP BY 1, 2) SELECT x, round(max(m), 5) AS fitted FROM t GROUP BY 1",
    "boxcox_loglik": " UNION ALL ".join(f"SELECT {v}::DOUBLE AS lambda, round((-count(*) / 2.0 * ln(var_pop({'ln(o_totalprice)' if v == 0 else f'(pow(o_totalprice, {v}) - 1) / {v}'})) + ({v} - 1) * sum(ln(o_totalprice))) / 1e3, 6) AS log_lik_k FROM orders WHERE o_totalprice > 0" for v in (-1.0, -0.5, 0.0, 0.5, 1.0)),
}
