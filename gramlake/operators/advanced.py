"""Further models: from moments (any number of rows), by iterated aggregates, from neighbours, or dense on bounded groups."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.functions.scalars import formula
from gramlake.functions.special import box_cox, box_cox_inverse
from gramlake.operators.bounded import closest_on_surface, point_triangles
from gramlake.operators.joins import nearest
from gramlake.operators.layers import stations_at
from gramlake.operators.linear import fit_one, full_moments, mean_column
from gramlake.operators.models import DENSE_ROWS, KERNELS, glm
from gramlake.session import table

# from moments: m = {n, mean, cov} of inputs and output, centred sums


def _parts(m: dict) -> tuple[np.ndarray, np.ndarray, float]:
    cov = np.asarray(m["cov"])
    return cov[:-1, :-1], cov[:-1, -1], float(cov[-1, -1])


def _with_intercept(m: dict, slope: np.ndarray) -> list[float]:
    mean = np.asarray(m["mean"])
    return [float(mean[-1] - slope @ mean[:-1]), *map(float, slope)]


def bayes(m: dict, ard: bool = False, rounds: int = 500) -> dict:
    """Evidence maximisation for the precisions of noise and coefficients, one for all or one each (ARD), on scaled inputs."""
    gram, xy, yy = _parts(m)
    sd = np.sqrt(np.diag(gram) / m["n"])
    gram, xy = gram / np.outer(sd, sd), xy / sd
    p, n = len(xy), m["n"] - 1
    alpha, beta = np.ones(p) * 1e-3, n / yy
    for _ in range(rounds):
        inv = np.linalg.inv(np.diag(alpha) + beta * gram)
        w = beta * inv @ xy
        rss = yy - 2 * w @ xy + w @ gram @ w
        free = 1 - alpha * np.diag(inv)
        new = np.minimum(free / np.maximum(w * w, 1e-300), 1e12) if ard else np.full(p, free.sum() / max(w @ w, 1e-300))
        beta_new = (n - free.sum()) / rss
        new = np.maximum(new, 1e-300)
        done = np.abs(np.log(new / alpha)).max() < 1e-9 and abs(math.log(beta_new / beta)) < 1e-9
        alpha, beta = new, beta_new
        if done:
            break
    inv = np.linalg.inv(np.diag(alpha) + beta * gram)
    w = beta * inv @ xy
    rss = yy - 2 * w @ xy + w @ gram @ w
    evidence = 0.5 * (np.log(alpha).sum() + n * math.log(beta) - beta * rss - alpha @ (w * w) + np.linalg.slogdet(inv)[1] - n * math.log(2 * math.pi))
    return {"coef": _with_intercept(m, w / sd), "noise_precision": float(beta), "precisions": alpha.tolist(), "log_evidence": float(evidence), "kept": [bool(a < 1e6) for a in alpha]}


def nonnegative(m: dict) -> list[float]:
    """Coefficients (intercept first) with slopes of at least zero: coordinate descent on the moments, which is convex."""
    gram, xy, _ = _parts(m)
    w = np.zeros(len(xy))
    for _ in range(20_000):
        old = w.copy()
        for j in range(len(w)):
            w[j] = max(0.0, w[j] + (xy[j] - gram[j] @ w) / gram[j, j])
        if np.abs(w - old).max() <= 1e-12 * max(1.0, np.abs(w).max()):
            break
    return _with_intercept(m, w)


def constrained(m: dict, c: Sequence[Sequence[float]], d: Sequence[float]) -> dict:
    """Least squares under c @ coef = d (intercept first), with the multipliers."""
    cov, mean, n = np.asarray(m["cov"]), np.asarray(m["mean"]), m["n"]
    p = len(mean) - 1
    gram = np.zeros((p + 1, p + 1))
    gram[0, 0], gram[0, 1:], gram[1:, 0] = n, n * mean[:p], n * mean[:p]
    gram[1:, 1:] = cov[:p, :p] + n * np.outer(mean[:p], mean[:p])
    rhs = np.concatenate([[n * mean[p]], cov[:p, p] + n * mean[:p] * mean[p]])
    c, d = np.atleast_2d(np.asarray(c, float)), np.asarray(d, float)
    k = len(d)
    full = np.block([[gram, c.T], [c, np.zeros((k, k))]])
    out = np.linalg.solve(full, np.concatenate([rhs, d]))
    return {"coef": out[: p + 1].tolist(), "multipliers": out[p + 1 :].tolist()}


def least_angle_order(m: dict) -> list[int]:
    """The order in which inputs enter the least-angle path."""
    gram, xy, _ = _parts(m)
    sd = np.sqrt(np.diag(gram))
    gram, c = gram / np.outer(sd, sd), xy / sd
    active: list[int] = [int(np.abs(c).argmax())]
    while len(active) < len(c):
        s = np.sign(c[active])
        direction = np.linalg.solve(gram[np.ix_(active, active)], s)
        top, move = np.abs(c[active]).max(), gram[:, active] @ direction
        steps = {}
        for j in set(range(len(c))) - set(active):
            both = [(top - c[j]) / (1 - move[j]) if move[j] != 1 else math.inf, (top + c[j]) / (1 + move[j]) if move[j] != -1 else math.inf]
            steps[j] = min((x for x in both if x > 1e-12), default=math.inf)
        j = min(steps, key=lambda k: (steps[k], k))
        c = c - steps[j] * move
        active.append(j)
    return active


def errors_in_variables(df: DataFrame, x: str, y: str, ratio: float = 1.0) -> DataFrame:
    """(slope, intercept) of Deming's line: ratio is the variance of the errors in y over those in x. One native aggregate."""
    s = df.agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = F.col("b") - ratio * F.col("a")
    slope = (d + F.sqrt(d * d + 4 * ratio * F.col("c") ** 2)) / (2 * F.col("c"))
    return s.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


# iterated aggregates


def nonlinear(df: DataFrame, text: str, start: dict[str, float], y: str, rounds: int = 60, tolerance: float = 1e-10) -> dict:
    """Nonlinear least squares of a formula in the columns and the named parameters, damped: each round is one aggregate.

    Derivatives are central differences of the formula, so that they too are expressions.
    """
    columns = {c: F.col(c) for c in df.columns}
    names, p = list(start), np.array(list(start.values()), float)
    df = df.cache()

    def at(v: np.ndarray) -> Column:
        return formula(text, **columns, **{k: F.lit(float(x)) for k, x in zip(names, v, strict=True)})

    def sums(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        grads = []
        for k in range(len(v)):
            h = 1e-5 * max(1e-3, abs(v[k]))
            grads.append((at(v + h * (np.arange(len(v)) == k)) - at(v - h * (np.arange(len(v)) == k))) / (2 * h))
        work = df.select((F.col(y) - at(v)).alias("r"), *[g.alias(f"g{k}") for k, g in enumerate(grads)])
        pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
        row = work.agg(F.array(*[F.sum(F.col(f"g{i}") * F.col(f"g{j}")) for i, j in pairs]).alias("j"), F.array(*[F.sum(F.col(f"g{k}") * F.col("r")) for k in range(len(v))]).alias("v"), F.sum(F.col("r") ** 2).alias("s")).first()
        full = np.zeros((len(v), len(v)))
        full[np.triu_indices(len(v))] = row["j"]
        return full + np.triu(full, 1).T, np.array(row["v"]), row["s"]

    try:
        damp = 1e-3
        jtj, jtr, sse = sums(p)
        for _ in range(rounds):
            step = np.linalg.solve(jtj + damp * np.diag(np.diag(jtj) + 1e-300), jtr)
            new = sums(p + step)
            if new[2] <= sse:
                small = sse - new[2] <= tolerance * (sse + 1e-300)
                p, (jtj, jtr, sse), damp = p + step, new, max(damp / 5, 1e-12)
                if small:
                    break
            else:
                damp *= 8
                if damp > 1e12:
                    break
        n = df.count()
        s2 = sse / max(n - len(p), 1)
        return {"parameters": dict(zip(names, map(float, p), strict=True)), "std_error": dict(zip(names, np.sqrt(s2 * np.diag(np.linalg.pinv(jtj))).tolist(), strict=True)), "sse": sse}
    finally:
        df.unpersist()


def heteroscedastic(df: DataFrame, xs: Sequence[str], y: str, rounds: int = 12) -> dict:
    """Mean and log-variance lines, alternating weighted means and a gamma fit of the squared residuals."""
    variance = [0.0] * (len(xs) + 1)
    for _ in range(rounds):
        mean = fit_one(df.withColumn("__w", F.exp(-mean_column({"coef": variance}, xs))), xs, y, weight="__w")
        e2 = F.greatest((F.col(y) - mean_column(mean, xs)) ** 2, F.lit(1e-300))
        new = glm(df.withColumn("__e", e2), xs, "__e", "gamma")["coef"]
        moved = max(abs(a - b) for a, b in zip(new, variance, strict=True))
        variance = new
        if moved < 1e-7:
            break
    return {"mean": mean["coef"], "log_variance": variance}


def transformed(df: DataFrame, xs: Sequence[str], y: str, grid: Sequence[float] = tuple(np.linspace(-2, 3, 11))) -> dict:
    """Box-Cox parameter by profile likelihood of a linear model; smearing factor for means.

    The moments of all grid values come from one aggregate: the inputs' cross products are shared, each value adds its own
    sums. Two finer grids around the best follow, then a parabola.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in xs], F.col(y).cast("double").alias("__y")).dropna()
    base = data.agg(F.avg(F.log("__y")).alias("l"), *[F.avg(c).alias(f"m_{c}") for c in xs]).first()
    centre = [F.col(c) - F.lit(float(base[f"m_{c}"])) for c in xs]
    p = len(xs)

    def scores(values: Sequence[float]) -> dict[float, float]:
        # scaled by the geometric mean, so that powers stay in range
        z = [box_cox(F.col("__y") / F.lit(math.exp(base["l"])), v) for v in values]
        row = data.agg(F.count("*").alias("n"), F.array(*[F.sum(a * b) for a in centre for b in centre]).alias("g"), *[F.array(F.sum(t), F.sum(t * t), *[F.sum(a * t) for a in centre]).alias(f"z{k}") for k, t in enumerate(z)]).first()
        g = np.array(row["g"]).reshape(p, p)
        out = {}
        for k, v in enumerate(values):
            s, ss, *cross = row[f"z{k}"]
            sse = ss - s * s / row["n"] - np.array(cross) @ np.linalg.lstsq(g, np.array(cross), rcond=None)[0]
            out[v] = -row["n"] / 2 * math.log(max(sse / row["n"], 1e-300))  # the Jacobian is in the scaling
        return out

    values = [round(float(v), 12) for v in grid]
    step = values[1] - values[0]
    found = scores(values)
    best = max(found, key=found.get)
    for _ in range(2):
        step /= 5
        found = scores([round(best + step * k, 12) for k in range(-5, 6)])
        best = max(found, key=found.get)
    lo, hi = found.get(round(best - step, 12)), found.get(round(best + step, 12))
    if lo is not None and hi is not None and lo + hi < 2 * found[best]:
        best += 0.5 * step * (lo - hi) / (lo + hi - 2 * found[best])
    m = fit_one(df.withColumn("__z", box_cox(F.col(y), best)), xs, "__z")
    back = box_cox_inverse(mean_column(m, xs), best)
    return {"lambda": best, "coef": m["coef"], "smearing": df.agg(F.avg(F.col(y) / back)).first()[0]}


# orthogonal polynomials


def legendre(x: Column, degree: int) -> list[Column]:
    """Legendre polynomials 0 to degree of x in [-1, 1], of norm one under the uniform density, each a sum of powers."""
    out = []
    for k in range(degree + 1):
        power = np.polynomial.legendre.leg2poly([0.0] * k + [math.sqrt(2 * k + 1)])
        out.append(sum((F.pow(x, F.lit(float(j))) * float(c) for j, c in enumerate(power) if c), F.lit(0.0)))
    return out


def chaos(df: DataFrame, xs: Sequence[str], y: str, limits: Sequence[tuple[float, float]], degree: int) -> dict:
    """Polynomial chaos by least squares, with exact first and total Sobol indices of the fitted polynomial."""
    unit = [(F.col(c) - (lo + hi) / 2) * (2 / (hi - lo)) for c, (lo, hi) in zip(xs, limits, strict=True)]
    basis = [legendre(u, degree) for u in unit]
    powers = [e for e in itertools.product(range(degree + 1), repeat=len(xs)) if 0 < sum(e) <= degree]
    cols = {}
    for k, e in enumerate(powers):
        col = F.lit(1.0)
        for b, n in zip(basis, e, strict=True):
            if n:
                col = col * b[n]
        cols[f"__p{k}"] = col
    m = fit_one(df.withColumns(cols), list(cols), y)
    sq = np.array(m["coef"][1:]) ** 2
    total = sq.sum()
    used = np.array(powers) > 0
    first = [float(sq[used[:, j] & (used.sum(1) == 1)].sum() / total) for j in range(len(xs))]
    return {"coef": m["coef"], "powers": powers, "r_squared": m["r_squared"], "first": first, "total": [float(sq[used[:, j]].sum() / total) for j in range(len(xs))]}


# neighbours

#: Small systems that a task solves at once.
SOLVES = 1_000


def local_kriging(points: DataFrame, queries: DataFrame, axes: Sequence[str], y: str, k: int, scale: float, kernel: str = "exponential", nugget: float = 1e-6) -> DataFrame:
    """(qid, mean, variance): ordinary Kriging of each query from its k nearest points; the tables may be of any size."""
    near = nearest(queries, points, axes, k).join(points.select("pid", *axes, F.col(y).alias("v")), "pid")
    rows = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *axes, "v"))).alias("n"))  # k entries each
    # arrays of numbers, which come to the workers without an object an entry
    rows = rows.select("qid", *[F.col(f"n.{c}").cast("array<double>").alias(f"n_{j}") for j, c in enumerate([*axes, "v"])])
    rows = rows.join(queries.select("qid", *[F.col(a).alias(f"q_{a}") for a in axes]), "qid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (batch.iloc[lo : lo + SOLVES] for batch in batches for lo in range(0, len(batch), SOLVES)):
            for size, part in b.groupby(b["n_0"].map(len)):  # all solves of a size at once
                x = np.stack([np.stack(part[f"n_{j}"].to_numpy()) for j in range(len(axes))], axis=-1).astype(float)
                v = np.stack(part[f"n_{len(axes)}"].to_numpy()).astype(float)
                at = part[[f"q_{a}" for a in axes]].to_numpy(float)
                dist = lambda p, q: np.sqrt(np.maximum(((p - q) ** 2).sum(-1), 0)) / scale
                inv = np.linalg.inv(KERNELS[kernel](dist(x[:, :, None], x[:, None])) + nugget * np.eye(size))
                c = KERNELS[kernel](dist(x, at[:, None]))
                one = inv.sum(1)
                total = one.sum(1)
                mean = (one * v).sum(1) / total
                alpha = np.einsum("nij,nj->ni", inv, v - mean[:, None])
                sigma2 = ((v - mean[:, None]) * alpha).sum(1) / max(size - 1, 1)
                spread = 1 - np.einsum("ni,nij,nj->n", c, inv, c) + (1 - (c * one).sum(1)) ** 2 / total
                yield pd.DataFrame({"qid": part["qid"].to_numpy(), "mean": mean + (c * alpha).sum(1), "variance": sigma2 * np.maximum(spread, 0)})

    return rows.mapInPandas(run, "qid long, mean double, variance double")


def layered(points: DataFrame, profiles: DataFrame, t: float, k: int = 3, power: float = 2.0) -> DataFrame:
    """(pid, temperature): station profiles (name, x, y, t, depth, temperature) at time t and each point's depth, blended over
    the k nearest stations. Profiles are linear in time and depth and clamped at their ends."""
    st = stations_at(profiles, t).withColumn("sid", F.xxhash64("name", "x", "y"))
    near = nearest(points.select(F.col("pid").alias("qid"), "x", "y"), st.select("sid", "x", "y"), ["x", "y"], k, point_id="sid")
    pairs = near.join(st.select("sid", "at"), "sid").join(points.select(F.col("pid").alias("qid"), F.col("depth").alias("z")), "qid")
    lower = F.filter("at", lambda a: a["depth"] <= F.col("z"))
    upper = F.filter("at", lambda a: a["depth"] >= F.col("z"))
    a, b = F.element_at(lower, -1), F.get(upper, F.lit(0))
    a, b = F.when(F.size(lower) > 0, a), F.when(F.size(upper) > 0, b)
    v = F.coalesce(F.when(b["depth"] > a["depth"], a["v"] + (F.col("z") - a["depth"]) / (b["depth"] - a["depth"]) * (b["v"] - a["v"])), a["v"], b["v"])
    weight = 1 / F.pow(F.greatest("distance", F.lit(1e-12)), F.lit(power))
    return pairs.withColumn("v", v).groupBy(F.col("qid").alias("pid")).agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("temperature"))


def closest_on_triangles(queries: DataFrame, triangles: DataFrame) -> DataFrame:
    """(qid, tid, distance): nearest triangle (tid, a, b, c arrays) of each query (qid, p array).

    Up to 20,000 triangles go to the workers as they are; more are searched through a hierarchy of boxes.
    """
    rows = triangles.limit(20_001).toPandas().sort_values("tid")
    if len(rows) > 20_000:
        return closest_on_surface(queries, triangles)
    held = triangles.sparkSession.sparkContext.broadcast((rows["tid"].to_numpy(), *(np.array(rows[c].tolist(), float) for c in "abc")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, a, b, c = held.value
        for batch in batches:
            out = []
            for q, p in zip(batch["qid"], batch["p"], strict=True):
                d = point_triangles(np.asarray(p, float), a, b, c)
                k = int(d.argmin())
                out.append((q, ids[k], math.sqrt(d[k])))
            yield pd.DataFrame(out, columns=["qid", "tid", "distance"])

    return queries.select("qid", "p").mapInPandas(run, "qid long, tid long, distance double")


# dense, on bounded groups


def radial(x: np.ndarray, y: np.ndarray, kernel: str, scale: float, smooth: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights of a radial interpolant with a constant, and its leave-one-out error."""
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) / scale
    n = len(x)
    a = np.block([[KERNELS[kernel](r) + smooth * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    inv = np.linalg.pinv(a)
    w = inv @ np.append(y, 0)
    return w, float(np.sqrt(((w[:n] / np.diag(inv)[:n]) ** 2).mean()))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float, epsilon: float, scale: float, rounds: int = 3_000) -> tuple[np.ndarray, float]:
    """Dual coefficients and offset of epsilon regression with a Gaussian kernel: the offset is held in the kernel as a
    constant, so that coordinates move one at a time."""
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * scale * scale)) + 1.0
    b, f = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            g = y[i] - f[i] + k[i, i] * b[i]
            new = float(np.clip(np.sign(g) * max(abs(g) - epsilon, 0) / k[i, i], -cost, cost))
            if new != b[i]:
                f += (new - b[i]) * k[:, i]
                moved = max(moved, abs(new - b[i]))
                b[i] = new
        if moved < 1e-9 * cost:
            break
    return b, float(b.sum())


def network(x: np.ndarray, y: np.ndarray, hidden: int = 12, rounds: int = 1_500, seed: int = 0, decay: float = 1e-4) -> dict:
    """One hidden layer of tanh units by Adam on standardised data."""
    r = np.random.default_rng(seed)
    mx, sx, my, sy = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1), y.mean(), y.std() or 1.0
    u, v = (x - mx) / sx, (y - my) / sy
    p = [r.normal(size=(x.shape[1], hidden)) / math.sqrt(x.shape[1]), np.zeros(hidden), r.normal(size=hidden) / math.sqrt(hidden), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for k in range(1, rounds + 1):
        h = np.tanh(u @ p[0] + p[1])
        e = (h @ p[2] + p[3] - v) / len(v)
        back = np.outer(e, p[2]) * (1 - h * h)
        grads = [u.T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], np.array([e.sum()])]
        for a, g, m1, m2 in zip(p, grads, first, second, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            a -= 0.02 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    return {"p": p, "mx": mx, "sx": sx, "my": my, "sy": sy}


def network_value(m: dict, x: np.ndarray) -> np.ndarray:
    return (np.tanh((x - m["mx"]) / m["sx"] @ m["p"][0] + m["p"][1]) @ m["p"][2] + m["p"][3]) * m["sy"] + m["my"]


def dense_groups(df: DataFrame, by: str, axes: Sequence[str], y: str, method: str, **kw) -> DataFrame:
    """(by, n, rmse, loo) of one dense model a group: radial, svr or network. Groups of up to DENSE_ROWS rows."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > DENSE_ROWS:
            raise ValueError(f"group {key} has {len(p)} rows, over {DENSE_ROWS}")
        p = p.groupby(list(axes), as_index=False)[y].mean().sort_values(list(axes))
        x, v = p[list(axes)].to_numpy(float), p[y].to_numpy(float)
        scale = kw.get("scale") or max(float(np.ptp(x, axis=0).max()), 1e-9) / 4
        loo = math.nan
        if method == "radial":
            w, loo = radial(x, v, kw.get("kernel", "squared_exponential"), scale, kw.get("smooth", 1e-3))
            fit = KERNELS[kw.get("kernel", "squared_exponential")](np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) / scale) @ w[:-1] + w[-1]
        elif method == "svr":
            b, _ = support_vectors(x, v - v.mean(), kw.get("cost", 10.0) * (v.std() or 1), kw.get("epsilon", 0.1) * (v.std() or 1), scale, kw.get("rounds", 300))
            fit = v.mean() + (np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * scale * scale)) + 1) @ b
        else:
            fit = network_value(network(x, v, rounds=kw.get("rounds", 400)), x)
        return pd.DataFrame({by: [key[0]], "n": [len(v)], "rmse": [float(np.sqrt(((v - fit) ** 2).mean()))], "loo": [loo]})

    return df.select(by, *axes, y).groupBy(by).applyInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, n long, rmse double, loo double")


# tables of constraints, dimensions and sparse entries


def project(x: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """(i, x): the least change (weights w) of x (i, x, w) that meets sum_i c(k, i) x_i = d(k). The k by k system comes to the
    driver, whose number of constraints is bounded by its memory; entries and unknowns stay distributed."""
    e = c.join(x, "i")
    gap = {r["k"]: r for r in e.groupBy("k").agg(F.sum(F.col("c") * F.col("x")).alias("now")).join(d, "k").select("k", (F.col("d") - F.col("now")).alias("gap")).collect()}
    ks = sorted(gap)
    at = {k: j for j, k in enumerate(ks)}
    right = e.select("i", F.col("k").alias("l"), F.col("c").alias("cl"))
    s = np.zeros((len(ks), len(ks)))
    for r in e.join(right, "i").groupBy("k", "l").agg(F.sum(F.col("c") * F.col("cl") / F.col("w")).alias("s")).collect():
        s[at[r["k"]], at[r["l"]]] = r["s"]
    lam = np.linalg.lstsq(s, np.array([gap[k]["gap"] for k in ks]), rcond=None)[0]
    spark = x.sparkSession
    force = spark.createDataFrame([(k, float(v)) for k, v in zip(ks, lam, strict=True)], f"k {c.schema['k'].dataType.simpleString()}, lam double")
    move = c.join(F.broadcast(force), "k").groupBy("i").agg(F.sum(F.col("c") * F.col("lam")).alias("push"))
    return x.join(move, "i", "left").select("i", (F.col("x") + F.coalesce("push", F.lit(0.0)) / F.col("w")).alias("x"))


def pi_groups(dimensions: dict[str, dict[str, int]]) -> list[dict[str, Fraction]]:
    """Dimensionless products as exponents: a basis of the null space of the dimension matrix, in exact fractions."""
    names = list(dimensions)
    rows = sorted({d for v in dimensions.values() for d in v})
    a = [[Fraction(dimensions[n].get(d, 0)) for n in names] for d in rows]
    lead, r = [], 0
    for col in range(len(names)):
        pivot = next((k for k in range(r, len(a)) if a[k][col]), None)
        if pivot is None:
            continue
        a[r], a[pivot] = a[pivot], a[r]
        a[r] = [v / a[r][col] for v in a[r]]
        for k in range(len(a)):
            if k != r and a[k][col]:
                a[k] = [u - a[k][col] * v for u, v in zip(a[k], a[r], strict=True)]
        lead.append(col)
        r += 1
    out = []
    for free in (c for c in range(len(names)) if c not in lead):
        v = {names[free]: Fraction(1)} | {names[c]: -a[k][free] for k, c in enumerate(lead) if a[k][free]}
        out.append(v)
    return out


def sparse_gram(a: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(row, col, v) of A diag(v) A': entries of a column meet in one join on it."""
    left = a if v is None else a.join(v.withColumnRenamed("v", "s"), "col").select("row", "col", (F.col("v") * F.col("s")).alias("v"))
    right = a.select(F.col("row").alias("r2"), "col", F.col("v").alias("v2"))
    return left.join(right, "col").groupBy("row", F.col("r2").alias("col2")).agg(F.sum(F.col("v") * F.col("v2")).alias("v")).select("row", F.col("col2").alias("col"), "v")


def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1] from the eigenvalues of the Jacobi matrix."""
    k = np.arange(1, n)
    off = k / np.sqrt(4.0 * k * k - 1)
    x, v = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    return x, 2 * v[0] ** 2


def triangle_rule(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on the unit triangle by collapsing a square rule; exact to total degree 2n - 2."""
    x, w = gauss_legendre(n)
    u, v = np.meshgrid((x + 1) / 2, (x + 1) / 2, indexing="ij")
    weight = np.outer(w, w) / 4 * (1 - u)
    return np.stack([u.ravel(), (v * (1 - u)).ravel()], 1), weight.ravel()


# column mapping


def rules_text(rules: dict[str, dict]) -> str:
    """Mapping rules as JSON; `rules_of` reads them back."""
    import json

    return json.dumps(rules, sort_keys=True)


def rules_of(text: str) -> dict[str, dict]:
    import json

    return {k: v | ({"unit": tuple(v["unit"])} if v.get("unit") else {}) for k, v in json.loads(text).items()}


def map_columns(df: DataFrame, rules: dict[str, dict], fuzzy: float = 0.0) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Columns of df under the rules' names, cast and converted; and how each was found: (target, source, tier).

    A rule: {"aliases": [...], "type": ..., "unit": (source, target), "required": bool}. Tiers: exact, case, normalised,
    and, where fuzzy is over 0, the column whose normalised name is most alike, by at least so many per cent of matching
    characters.
    """
    import difflib
    import re

    from gramlake.functions.scalars import convert

    plain = lambda s: re.sub(r"[\s_\-./]+", "", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s)).lower()
    out, report = [], []
    for target, rule in rules.items():
        names = [target, *rule.get("aliases", [])]
        tiers = (("exact", lambda s: s), ("case", str.lower), ("normalised", plain))
        hit = next(((c, tier) for tier, f in tiers for n in names for c in sorted(df.columns, key=lambda c: (len(c), c)) if f(c) == f(n)), None)
        if hit is None and fuzzy > 0:
            alike = [(100 * difflib.SequenceMatcher(None, plain(c), plain(n)).ratio(), -len(c), c) for n in names for c in df.columns]
            best = max(alike, default=(0.0, 0, ""))
            hit = (best[2], "fuzzy") if best[0] >= fuzzy else None
        if hit is None:
            if rule.get("required", True):
                raise KeyError(f"no column for {target} among {df.columns}")
            out.append(F.lit(None).cast(rule.get("type", "string")).alias(target))
            report.append((target, "", "missing"))
            continue
        col = F.col(f"`{hit[0]}`")
        if "type" in rule:
            col = col.try_cast(rule["type"])
        if rule.get("unit"):
            col = convert(col.cast("double"), *rule["unit"])
        out.append(col.alias(target))
        report.append((target, hit[0], hit[1]))
    return df.select(*out), report


# queries


def _m(s, d):
    return full_moments(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


def _row(s, values, names):
    return s.createDataFrame([tuple(float(v) for v in values)], ", ".join(f"{n} double" for n in names))


def _q_constrained(s, d):
    c = constrained(full_moments(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice"), [[0, 1]], [1000.0])
    return _row(s, [round(v, 4) for v in c["coef"]], ["intercept", "slope"])


def _q_deming(s, d):
    df = table(s, d, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_size") * 3 + F.col("p_retailprice") / 100).alias("y"))
    return errors_in_variables(df, "x", "y", 2.0).select(F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _q_nonlinear(s, d):
    df = table(s, d, "lineitem").groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("y")).select(F.col("l_quantity").alias("x"), (F.exp(-F.col("l_quantity") / 20) * 3 + F.col("y") / 1e6).alias("y"))
    m = nonlinear(df, "a * exp(-x / b) + c", {"a": 1.0, "b": 10.0, "c": 0.0}, "y")
    return _row(s, m["parameters"].values(), m["parameters"])


def _q_chaos(s, d):
    from gramlake.operators.sampling import PROBLEMS, halton, problem

    lim = PROBLEMS["ishigami"]
    pts = halton(s, 3000, lim)
    m = chaos(pts.withColumn("y", problem("ishigami", F.col("x0"), F.col("x1"), F.col("x2"))), ["x0", "x1", "x2"], "y", lim, 4)
    return s.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(m["first"], m["total"], strict=True))], "input int, first double, total double")


def _q_local_kriging(s, d):
    from gramlake.operators.joins import _ask, _points

    return local_kriging(_points(s, d), _ask(s, d), ["x", "y"], "v", 12, 0.2, nugget=0.1)


def _q_project(s, d):
    x = table(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"), F.lit(1.0).alias("w"), "p_brand")
    c = x.select(F.col("p_brand").alias("k"), "i", F.lit(1.0).alias("c"))
    target = x.groupBy(F.col("p_brand").alias("k")).agg((F.count("*") * 30.0).alias("d"))
    return project(x.drop("p_brand"), c, target).select("i", F.round("x", 7).alias("x"))


def _q_gram(s, d):
    a = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 15).alias("row"), (F.col("l_partkey") % 40).alias("col")).agg(F.sum("l_quantity").alias("v"))
    return sparse_gram(a)


def _q_map(s, d):
    out, _ = map_columns(table(s, d, "part"), {"partKey": {"aliases": ["p_partkey"], "type": "bigint"}, "size": {"aliases": ["P_SIZE"], "unit": ("mm", "cm")}, "price": {"aliases": ["pRetailPrice"], "type": "double"}})
    return out.select("partKey", F.round("size", 9).alias("size"), "price")


def _q_layered(s, d):
    st = s.range(4).select(F.concat(F.lit("s"), "id").alias("name"), (F.col("id") % 2 * 10.0).alias("x"), (F.floor(F.col("id") / 2) * 10.0).alias("y"), F.col("id"))
    prof = st.select("*", F.explode(F.array(F.lit(0.0), F.lit(2.0))).alias("t")).select("*", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.5, 1.0)])).alias("depth")).withColumn("temperature", 300 + 10 * F.col("id") + 20 * F.col("t") - 50 * F.col("depth"))
    pts = s.range(50).select(F.col("id").alias("pid"), (F.col("id") % 10 + 0.3).alias("x"), (F.floor(F.col("id") / 10) * 2 + 0.1).alias("y"), (F.col("id") % 7 * 0.2).alias("depth"))
    return layered(pts, prof.drop("id"), 0.5).select("pid", F.round("temperature", 6).alias("temperature"))


QUERIES = {
    "constrained_ls": _q_constrained, "deming": _q_deming, "nonlinear_ls": _q_nonlinear, "chaos_sobol": _q_chaos, "local_kriging": _q_local_kriging, "affine_projection": _q_project, "sparse_gram": _q_gram, "map_columns": _q_map, "layered_profiles": _q_layered,
    "bayes_evidence": lambda s, d: _row(s, bayes(_m(s, d))["coef"], ["b0", "b1", "b2", "b3"]),
    "bayes_ard": lambda s, d: _row(s, bayes(_m(s, d), ard=True)["coef"], ["b0", "b1", "b2", "b3"]),
    "nonnegative_ls": lambda s, d: _row(s, nonnegative(_m(s, d)), ["b0", "b1", "b2", "b3"]),
    "least_angle_order": lambda s, d: s.createDataFrame([(k, j) for k, j in enumerate(least_angle_order(_m(s, d)))], "k int, input int"),
    "heteroscedastic": lambda s, d: _row(s, heteroscedastic(table(s, d, "events").select(F.hour("ts").cast("double").alias("h"), "value"), ["h"], "value")["log_variance"], ["v0", "v1"]),
    "transformed_target": lambda s, d: _row(s, [transformed(table(s, d, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 10).cast("double").alias("x")), ["x"], "y")["lambda"]], ["lambda"]),
    "radial_groups": lambda s, d: dense_groups(table(s, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("y")), "l_returnflag", ["l_quantity"], "y", "radial"),
    "svr_groups": lambda s, d: dense_groups(table(s, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("y")), "l_returnflag", ["l_quantity"], "y", "svr"),
    "network_groups": lambda s, d: dense_groups(table(s, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("y")), "l_returnflag", ["l_quantity"], "y", "network"),
}
SQL = {
    "constrained_ls": "SELECT round(avg(l_extendedprice) - 1000 * avg(l_quantity), 4) AS intercept, 1000.0::DOUBLE AS slope FROM lineitem",
    "deming": "WITH p AS (SELECT p_size::DOUBLE AS x, p_size * 3 + p_retailprice / 100 AS y FROM part), m AS (SELECT var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c, avg(x) AS mx, avg(y) AS my FROM p), s AS (SELECT *, (b - 2 * a + sqrt((b - 2 * a) * (b - 2 * a) + 8 * c * c)) / (2 * c) AS k FROM m) SELECT round(k, 7) AS slope, round(my - k * mx, 6) AS intercept FROM s",
    "affine_projection": "SELECT p_partkey AS i, round(p_size + 30 - avg(p_size) OVER (PARTITION BY p_brand), 7) AS x FROM part",
    "sparse_gram": "WITH a AS (SELECT l_suppkey % 15 AS r, l_partkey % 40 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a.r AS row, b.r AS col, sum(a.v * b.v) AS v FROM a JOIN a b ON a.c = b.c GROUP BY 1, 2",
    "map_columns": 'SELECT p_partkey AS "partKey", round(p_size * 0.1, 9) AS size, p_retailprice AS price FROM part',
    "layered_profiles": "WITH st AS (SELECT i AS id, i % 2 * 10.0::DOUBLE AS x, i // 2 * 10.0::DOUBLE AS y FROM range(4) t(i)), p AS (SELECT i AS pid, i % 10 + 0.3::DOUBLE AS x, i // 10 * 2 + 0.1::DOUBLE AS y, i % 7 * 0.2::DOUBLE AS z FROM range(50) t(i)), n AS (SELECT pid, 310 + 10 * id - 50 * least(z, 1.0) AS v, sqrt((p.x - st.x) * (p.x - st.x) + (p.y - st.y) * (p.y - st.y)) AS d, id FROM p, st), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, id) AS k FROM n) SELECT pid, round(sum(v / (d * d)) / sum(1 / (d * d)), 6) AS temperature FROM r WHERE k <= 3 GROUP BY 1",
}
