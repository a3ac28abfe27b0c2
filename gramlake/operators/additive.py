"""Additive, quantile, shape-bound, mixed and tree models, and what fitted models tell of themselves: residuals, intervals,
summaries, bootstraps. Sums over the data are Spark aggregates; dense fits take bounded groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions.numerics import Tree, bounded_qp, build_tree, difference_matrix, importance, minimize, smoothing_criterion, smoothing_spline
from gramlake.functions.special import gammaln_column, normal_ppf
from gramlake.operators.advanced import nonlinear, pi_groups
from gramlake.operators.linear import fit_one, mean_column
from gramlake.operators.models import CANONICAL, DENSE_ROWS, LINKS, VARIANCES, _original, _standardised, _weighted_gram, b_spline, glm, unit_deviance
from gramlake.functions.special import _udf, box_cox, box_cox_inverse, normal_cdf_column
from gramlake.operators.tables import percentiles
from gramlake.session import table

# links: probit by the normal law, powers of the mean


def power_link(p: float) -> tuple[Callable, Callable, Callable]:
    """(inverse, derivative of eta by mu, link) of eta = mu^p; the logarithm for p = 0."""
    if p == 0:
        return LINKS["log"]
    return lambda e: F.pow(e, F.lit(1 / p)), lambda m: p * F.pow(m, F.lit(p - 1)), lambda m: F.pow(m, F.lit(p))


PROBIT = (normal_cdf_column, lambda m: 1 / (F.exp(-_udf(normal_ppf, m) ** 2 / 2) / math.sqrt(2 * math.pi)), lambda m: _udf(normal_ppf, m))

# generalised linear models


def glm_full(df: DataFrame, xs: Sequence[str], y: str, family: str, link: str | None = None) -> dict:
    """A fitted GLM with the covariance of its coefficients, dispersion, deviances, likelihood and criteria.

    After the scoring rounds, one aggregate for the information matrix and one for the sums over the data.
    """
    model = glm(df, xs, y, family, link)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna()
    inverse, slope, _ = LINKS[link or CANONICAL[family]]
    mu = inverse(mean_column(model, xs))
    v = VARIANCES[family]
    gram, _, _ = _weighted_gram(data, xs, 1 / (v(mu) * slope(mu) ** 2), F.lit(0.0), [])
    mean = data.agg(F.avg(y)).first()[0]
    null = F.lit(float(mean))
    loglik = {
        "gaussian": F.lit(0.0), "poisson": F.col(y) * F.log(mu) - mu - gammaln_column(F.col(y) + 1), "binomial": F.when(F.col(y) > 0, F.col(y) * F.log(mu)).otherwise(0.0) + F.when(F.col(y) < 1, (1 - F.col(y)) * F.log(1 - mu)).otherwise(0.0),
    }.get(family, F.lit(0.0))
    s = data.agg(F.sum((F.col(y) - mu) ** 2 / v(mu)).alias("pearson"), F.sum(unit_deviance(family, F.col(y), null)).alias("null"), F.sum(loglik).alias("ll"), F.count("*").alias("n")).first()
    n, p = s["n"], len(xs) + 1
    known = family in ("poisson", "binomial")
    dispersion = 1.0 if known else s["pearson"] / (n - p)
    if family == "gaussian":
        ll = -0.5 * n * (math.log(2 * math.pi * model["deviance"] / n) + 1)
    elif family == "gamma":
        a = n / model["deviance"]
        g = data.agg(F.sum(a * F.log(a * F.col(y) / mu) - a * F.col(y) / mu - F.log(F.col(y))).alias("g")).first()["g"]
        ll = g - n * math.lgamma(a)
    elif family == "inverse_gaussian":
        phi = model["deviance"] / n
        ll = data.agg(F.sum(-0.5 * (F.log(2 * math.pi * phi * F.col(y) ** 3) + (F.col(y) - mu) ** 2 / (phi * mu**2 * F.col(y)))).alias("g")).first()["g"]
    else:
        ll = s["ll"]
    k = p + (not known)
    return model | {"cov": np.linalg.inv(gram) * dispersion, "family": family, "link": link or CANONICAL[family], "dispersion": dispersion, "null_deviance": s["null"], "pearson": s["pearson"], "edf": float(p), "loglik": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(n) - 2 * ll, "deviance_explained": 1 - model["deviance"] / s["null"], "xs": list(xs), "y": y}


def glm_summary(m: dict) -> dict:
    return {k: m[k] for k in ("deviance", "null_deviance", "dispersion", "edf", "loglik", "aic", "bic")}


def link_value(m: dict) -> Column:
    """The linear predictor."""
    return mean_column(m, m["xs"])


def _quadratic(cov: np.ndarray, xs: Sequence[str]) -> Column:
    col = [F.lit(1.0), *[F.col(c) for c in xs]]
    return sum((F.lit(float(cov[i, j])) * col[i] * col[j] for i in range(len(col)) for j in range(len(col))), F.lit(0.0))


def glm_interval(m: dict, level: float = 0.95) -> tuple[Column, Column, Column]:
    """(mean, lower, upper): the interval of the linear predictor, taken through the inverse link."""
    inverse = LINKS[m["link"]][0]
    eta, half = link_value(m), normal_ppf(0.5 + level / 2) * F.sqrt(_quadratic(m["cov"], m["xs"]))
    a, b = inverse(eta - half), inverse(eta + half)
    return inverse(eta), F.least(a, b), F.greatest(a, b)


def glm_residual(m: dict, kind: str = "deviance") -> Column:
    inverse, slope, _ = LINKS[m["link"]]
    y, mu = F.col(m["y"]), inverse(link_value(m))
    return {
        "response": y - mu, "pearson": (y - mu) / F.sqrt(VARIANCES[m["family"]](mu)), "working": (y - mu) * slope(mu),
        "deviance": F.signum(y - mu) * F.sqrt(F.greatest(unit_deviance(m["family"], y, mu), F.lit(0.0))),
    }[kind]


# quantiles


def check_loss(r: Column, tau: float | Column) -> Column:
    return r * ((tau if isinstance(tau, Column) else F.lit(tau)) - (r < 0).cast("double"))


def quantile_exact(x: np.ndarray, y: np.ndarray, tau: float, w: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (the constant first) that minimise the weighted check loss, by interior points of the dual on up to
    DENSE_ROWS rows, then brought to a vertex: as many points as coefficients are met exactly. Of vertices with the same
    loss it is one of lower fitted values, as the smallest value whose share reaches tau is a column's quantile."""
    a = np.hstack([np.ones((len(y), 1)), np.asarray(x, float).reshape(len(y), -1)])
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    n, p = a.shape
    if n > DENSE_ROWS:
        raise ValueError(f"{n} rows, over {DENSE_ROWS}")
    # dual: max y'd with a'd = (1 - tau) a'w and 0 <= d <= w
    target = (1 - tau) * a.T @ w
    d = (1 - tau) * w
    beta = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    scale = max(np.abs(y - a @ beta).max(), 1e-12)
    mu = scale
    for _ in range(80):
        mu *= 0.5
        for _ in range(4):
            # max y'd + mu (log d + log(w - d)) subject to a'd = target: a Newton step
            h = mu * (1 / d**2 + 1 / (w - d) ** 2)
            g = y + mu * (1 / d - 1 / (w - d))
            ah = a / h[:, None]
            beta = np.linalg.lstsq(a.T @ ah, ah.T @ g - (target - a.T @ d), rcond=None)[0]
            step = (g - a @ beta) / h
            with np.errstate(divide="ignore"):
                room = np.where(step > 0, (w - d) / step, np.where(step < 0, -d / step, np.inf)).min()
            d = d + min(1.0, 0.995 * room) * step
        if mu < 1e-13 * scale:
            break
    loss = lambda b: (w * (y - a @ b) * (tau - (y - a @ b < 0))).sum()
    order = np.argsort(np.abs(y - a @ beta))
    basis: list[int] = []
    for k in order:
        if np.linalg.matrix_rank(a[[*basis, k]]) == len(basis) + 1:
            basis.append(int(k))
        if len(basis) == p:
            break
    if len(basis) < p:
        return beta
    # from vertex to vertex along edges, each to the least of its piecewise-linear loss, until none is lower; where the loss
    # is level between two vertices, to that of the lower fitted values
    vertex, least = np.linalg.solve(a[basis], y[basis]), 1e-12 * np.abs(y).max()
    value, fitted = loss(vertex), w @ a @ vertex
    for _ in range(1_000):
        moved = False
        for k in range(p):
            d = np.linalg.solve(a[basis], np.eye(p)[k])
            c, r = a @ d, y - a @ vertex
            r[basis] = 0.0
            size = np.abs(c).max()
            at = np.flatnonzero(np.abs(c) > 1e-9 * size)
            t = r[at] / c[at]
            pull = w[at] * np.abs(c[at])
            order = np.argsort(t, kind="stable")
            want = (pull * np.where(c[at] > 0, tau, 1 - tau)).sum()
            total = np.cumsum(pull[order])
            i = min(int(np.searchsorted(total, want * (1 - 1e-10))), len(order) - 1)
            level = i + 1 < len(order) and abs(total[i] - want) <= 1e-10 * want
            to = order[i + 1 if level and w @ c < 0 else i]
            if abs(t[to]) * size <= least:
                continue
            after = [*basis[:k], int(at[to]), *basis[k + 1 :]]
            new = np.linalg.solve(a[after], y[after])
            now, sums = loss(new), w @ a @ new
            same = 1e-13 * max(1.0, abs(value))
            if now < value - same or now <= value + same and sums < fitted - 1e-13 * abs(fitted):
                basis, vertex, value, fitted, moved = after, new, now, sums, True
        if not moved:
            break
    return vertex


def quantile_fit(df: DataFrame, xs: Sequence[str], y: str, tau: float, rounds: int = 60) -> dict:
    """Linear quantile regression of any number of rows and inputs, by reweighted least squares on a check loss whose corner
    is smoothed less in every round; with the loss, and its share under that of the plain quantile (R1)."""
    data, m, s = _standardised(df.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna(), xs)
    data = data.cache()
    try:
        beta = np.array(fit_one(data, list(xs), y)["coef"])
        size = data.agg(F.stddev_pop(y)).first()[0] or 1.0
        for k in range(rounds):
            eps = size * max(0.6**k, 1e-7)
            r = F.col(y) - mean_column({"coef": list(map(float, beta))}, xs)
            w = F.when(r >= 0, tau).otherwise(1 - tau) / F.sqrt(r * r + F.lit(eps * eps))
            gram, v, _ = _weighted_gram(data, xs, w, F.col(y), [])
            new = np.linalg.solve(gram, v)
            done = np.abs(new - beta).max() <= 1e-10 * max(np.abs(new).max(), 1e-300)
            beta = new
            if done and eps <= size * 1e-6:
                break
        (flat,) = percentiles(data, F.col(y), [tau])
        r = F.col(y) - mean_column({"coef": list(map(float, beta))}, xs)
        at = data.agg(F.sum(check_loss(r, tau)).alias("a"), F.sum(check_loss(F.col(y) - F.lit(flat), tau)).alias("b")).first()
        return {"coef": _original(beta, m, s), "objective": at["a"], "r1": 1 - at["a"] / at["b"] if at["b"] else 0.0, "tau": tau}
    finally:
        data.unpersist()


def quantile_process(df: DataFrame, by: str, xs: Sequence[str], y: str, taus: Sequence[float]) -> DataFrame:
    """(by, tau, coef array): exact coefficients of several levels in each group. Groups of up to DENSE_ROWS rows are fitted in
    a task each, a larger one by `quantile_large`, whose sums the partitions share."""
    from gramlake.operators.scalable import quantile_large

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([*xs, y])
        return pd.DataFrame([(key[0], t, quantile_exact(p[list(xs)].to_numpy(float), p[y].to_numpy(float), t).tolist()) for t in taus], columns=[by, "tau", "coef"])

    kind = df.schema[by].dataType.simpleString()
    numbers = list(dict.fromkeys([*xs, y]))
    rows = df.select(by, *[F.col(c).cast("double").alias(c) for c in numbers]).dropna(subset=numbers)
    large = [r[0] for r in rows.groupBy(by).count().where(F.col("count") > DENSE_ROWS).select(by).collect()]
    own = lambda v: F.col(by).eqNullSafe(F.lit(v).cast(kind))
    small = rows.where(~reduce(lambda a, b: a | b, map(own, large))) if large else rows
    out = small.groupBy(by).applyInPandas(run, f"`{by}` {kind}, tau double, coef array<double>")
    if not large:
        return out
    fits = []
    for v in large:
        for t in taus:
            m = quantile_large(rows.where(own(v)), xs, y, t)
            if not m["exact"]:
                raise ValueError(f"group {v}: over {DENSE_ROWS} distinct rows lie on the plane of level {t}")
            fits.append((v, float(t), [float(c) for c in m["coef"]]))
    return out.unionByName(df.sparkSession.createDataFrame(fits, out.schema))


# penalised additive models


def _term_columns(term: dict, p: pd.DataFrame) -> np.ndarray:
    v = p[term["x"]]
    if term["kind"] == "linear":
        return v.to_numpy(float)[:, None] - term["centre"]
    if term["kind"] in ("factor", "random"):
        return (v.astype(str).to_numpy()[:, None] == np.array(term["levels"])[None]).astype(float)
    return b_spline(v.to_numpy(float), term["lo"], term["hi"], term["segments"])


def gam_fit(df: DataFrame, terms: Sequence[dict], y: str, family: str = "gaussian", criterion: str = "auto", rounds: int = 30) -> dict:
    """g(mean) = a constant + terms {x, kind}: spline (segments, a second-difference penalty), linear, factor, random.

    Every scoring round is one distributed sum of X'WX and X'Wz (bases by numpy on Arrow batches, partial sums per partition);
    the smoothing parameters are chosen on the driver from these sums, by GCV, or UBRE where the family's scale is known.
    """
    terms = [dict(t) for t in terms]
    numeric = [t for t in terms if t["kind"] in ("spline", "linear")]
    box = df.agg(*[f(t["x"]).alias(f"{t['x']}_{n}") for t in numeric for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))], F.avg(y).alias("mean")).first()
    for t in terms:
        if t["kind"] == "spline":
            t |= {"lo": float(box[f"{t['x']}_lo"]), "hi": float(box[f"{t['x']}_hi"]), "segments": t.get("segments", 8)}
        elif t["kind"] == "linear":
            t["centre"] = float(box[f"{t['x']}_mean"])
        else:
            t["levels"] = sorted(str(r[0]) for r in df.select(F.col(t["x"]).cast("string")).distinct().limit(1_001).collect())
            if len(t["levels"]) > 1_000:
                raise ValueError(f"{t['x']} has over 1,000 levels")
    size = {"spline": lambda t: t["segments"] + 3, "linear": lambda t: 1, "factor": lambda t: len(t["levels"]), "random": lambda t: len(t["levels"])}
    width = [size[t["kind"]](t) for t in terms]
    start = np.concatenate([[1], 1 + np.cumsum(width)]).astype(int)
    p = 1 + sum(width)
    penalties = []
    for t, a, w in zip(terms, start, width, strict=False):
        s = np.zeros((p, p))
        if t["kind"] == "spline":
            d = difference_matrix(w, 2)
            s[a : a + w, a : a + w] = d.T @ d
        elif t["kind"] == "random":
            s[a : a + w, a : a + w] = np.eye(w)
        penalties.append(s)
    smooth = [k for k, t in enumerate(terms) if t["kind"] in ("spline", "random")]
    # what splines and factors share with the constant is held by a small ridge
    ridge = 1e-8 * np.eye(p)
    ridge[0, 0] = 0
    data = df.select(*{t["x"] for t in terms}, F.col(y).cast("double").alias("__y")).dropna().cache()

    def design(b: pd.DataFrame) -> np.ndarray:
        return np.hstack([np.ones((len(b), 1)), *[_term_columns(t, b) for t in terms]])

    def sums(beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, float, float]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((p + 1) * (p + 1) + 2)
            for b in batches:
                x, v = design(b), b["__y"].to_numpy(float)
                w, z, dev = _working(family, x @ beta if beta is not None else None, v)
                xz = np.hstack([x, z[:, None]])
                total[:-2] += ((xz * w[:, None]).T @ xz).reshape(-1)
                total[-2] += dev
                total[-1] += len(v)
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        rows = data.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
        g = rows[:-2].reshape(p + 1, p + 1)
        return g[:-1, :-1], g[:-1, -1], g[-1, -1], rows[-2], rows[-1]

    known = 1.0 if family in ("poisson", "binomial") else None

    def solve(lam: np.ndarray, g: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = g + ridge * max(np.trace(g) / p, 1e-300) + sum((math.exp(x) * penalties[k] for x, k in zip(lam, smooth, strict=True)), np.zeros((p, p)))
        inv = np.linalg.pinv(a, hermitian=True)
        return inv @ v, inv

    try:
        beta, lam, last = None, np.zeros(len(smooth)), math.inf
        for _ in range(rounds):
            g, v, zz, dev, n = sums(beta)

            def cost(l: np.ndarray, g=g, v=v, zz=zz, n=n) -> float:  # noqa: E741
                b, inv = solve(l, g, v)
                edf = float(np.trace(inv @ g))
                rss = max(zz - 2 * b @ v + b @ g @ b, 0.0)
                use = known if criterion in ("auto", "ubre") else None
                return smoothing_criterion(rss, n, edf, use)

            if len(smooth):
                lam = minimize(cost, lam, [(-12.0, 16.0)] * len(smooth), method="simplex", tol=1e-9, rounds=120)[0]
            beta, inv = solve(lam, g, v)
            if family == "gaussian" or abs(last - dev) <= 1e-9 * (abs(dev) + 0.1):
                break
            last = dev
        g, v, zz, dev, n = sums(beta)
        inv = solve(lam, g, v)[1]
        edf = np.diag(inv @ g)
        scale = known or dev / (n - edf.sum())
        return {"terms": terms, "start": start, "coef": beta, "cov": inv * scale, "edf": edf, "lambda": {terms[k]["x"]: float(math.exp(x)) for x, k in zip(lam, smooth, strict=True)}, "family": family, "deviance": dev, "n": n, "scale": scale, "gram": g, "y": y, "criterion": "UBRE" if known else "GCV", "score": smoothing_criterion(dev, n, edf.sum(), known)}
    finally:
        data.unpersist()


def _working(family: str, eta: np.ndarray | None, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, working response, deviance) of a family with its canonical link (log for gamma)."""
    if family == "gaussian":
        return np.ones(len(y)), y, float(((y - (eta if eta is not None else 0)) ** 2).sum())
    if family == "binomial":
        m = (y + 0.5) / 2 if eta is None else 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        v = m * (1 - m)
        with np.errstate(divide="ignore", invalid="ignore"):
            dev = 2 * (np.where(y > 0, y * np.log(y / m), 0) + np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - m)), 0)).sum()
        return v, np.log(m / (1 - m)) + (y - m) / v, float(dev)
    m = np.maximum(y, 0.1) if eta is None else np.exp(np.clip(eta, -30, 30))
    z = np.log(m) + (y - m) / m
    if family == "poisson":
        with np.errstate(divide="ignore", invalid="ignore"):
            return m, z, float(2 * (np.where(y > 0, y * np.log(y / m), 0) - (y - m)).sum())
    return np.ones(len(y)), z, float(2 * ((y - m) / m - np.log(y / m)).sum())


def gam_predict(m: dict, df: DataFrame, parts: bool = False) -> DataFrame:
    """df with `mean`, and with parts an array of (term, fit, se): each term's centred effect on the linear predictor."""
    centre = [m["gram"][0, a : a + (b - a)] / m["gram"][0, 0] for a, b in zip(m["start"], m["start"][1:], strict=False)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            eta, cells = np.full(len(b), m["coef"][0]), []
            for t, a, c in zip(m["terms"], m["start"], centre, strict=False):
                x = _term_columns(t, b)
                own = slice(a, a + x.shape[1])
                eta = eta + x @ m["coef"][own]
                x = x - c
                cells.append((t["x"], x @ m["coef"][own], np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, m["cov"][own, own], x), 0))))
            out = b.copy()
            out["mean"] = eta if m["family"] == "gaussian" else 1 / (1 + np.exp(-eta)) if m["family"] == "binomial" else np.exp(eta)
            if parts:
                out["parts"] = [[{"term": n, "fit": float(f[i]), "se": float(e[i])} for n, f, e in cells] for i in range(len(b))]
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, kinds + ", mean double" + ", parts array<struct<term:string,fit:double,se:double>>" * parts)


def gam_terms(m: dict) -> list[dict]:
    """Of each term its degrees of freedom, smoothing parameter and the Wald statistic of no effect."""
    out = []
    for t, a, b in zip(m["terms"], m["start"], m["start"][1:], strict=False):
        own = slice(a, b)
        # constants along a basis are the model's own
        c = np.eye(b - a) - 1 / (b - a) if b - a > 1 else np.eye(1)
        coef, cov = c @ m["coef"][own], c @ m["cov"][own, own] @ c.T
        out.append({"term": t["x"], "edf": float(m["edf"][own].sum()), "lambda": m["lambda"].get(t["x"]), "wald": float(coef @ np.linalg.pinv(cov, rcond=1e-8, hermitian=True) @ coef)})
    return out


def gam_summary(m: dict) -> dict:
    return {"criterion": m["criterion"], "score": m["score"], "edf": float(m["edf"].sum()), "deviance": m["deviance"], "scale": m["scale"], "lambda": m["lambda"]}


# splines


def smoothing_groups(df: DataFrame, by: str, x: str, y: str, s: float | None = None) -> DataFrame:
    """(by, knots, coef, residual): a smoothing spline with automatic knots in each group of up to DENSE_ROWS distinct x."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("x")
        if len(p) > DENSE_ROWS:
            raise ValueError(f"group {key} has {len(p)} distinct values, over {DENSE_ROWS}")
        if len(p) < 4:
            return pd.DataFrame({by: [], "knots": [], "coef": [], "residual": []})
        f = smoothing_spline(p["x"].to_numpy(float), p["y"].to_numpy(float), np.sqrt(p["n"].to_numpy(float)), s)
        return pd.DataFrame([(key[0], f["t"].tolist(), f["c"].tolist(), f["fp"])], columns=[by, "knots", "coef", "residual"])

    level = df.groupBy(by, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("n"))
    return level.groupBy(by).applyInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, knots array<double>, coef array<double>, residual double")


def shape_spline(df: DataFrame, x: str, y: str, shape: str = "increasing", segments: int = 12, penalty: float = 1e-3) -> dict:
    """A P-spline bound to be increasing, decreasing, convex or concave: one aggregate per distinct x, its sums of the basis,
    then a quadratic program in the coefficients' differences."""
    level = df.groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("n"))
    box = level.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = box["lo"], max(box["hi"], box["lo"] + 1e-9)
    p = segments + 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p + 1))
        for b in batches:
            base, w = b_spline(b["x"].to_numpy(float), lo, hi, segments), b["n"].to_numpy(float)
            total += (base * w[:, None]).T @ np.hstack([base, b["y"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"k": np.arange(total.size), "v": total.reshape(-1)})

    s = level.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy().reshape(p, p + 1)
    g, v = s[:, :-1], s[:, -1]
    # coefficients = t theta: theta's bounded entries are first or second differences
    order = 1 if shape in ("increasing", "decreasing") else 2
    t = np.tril(np.ones((p, p)))
    if order == 2:
        t = np.hstack([np.ones((p, 1)), np.arange(p)[:, None], *[np.maximum(np.arange(p) - k, 0)[:, None] for k in range(1, p - 1)]])
    sign = -1.0 if shape in ("decreasing", "concave") else 1.0
    lower = np.concatenate([np.full(order, -np.inf), np.zeros(p - order)])
    t = t * np.concatenate([np.ones(order), np.full(p - order, sign)])
    d = difference_matrix(p, 2)
    h = t.T @ (g + penalty * np.trace(g) / p * d.T @ d) @ t
    theta = bounded_qp(h, -t.T @ v, lower)
    return {"coef": t @ theta, "lo": lo, "hi": hi, "segments": segments}


def shape_values(m: dict, at: np.ndarray) -> np.ndarray:
    return b_spline(at, m["lo"], m["hi"], m["segments"]) @ m["coef"]


# mixed models


def mixed_fit(df: DataFrame, group: str, xs: Sequence[str], y: str, slopes: Sequence[str] = (), rounds: int = 60) -> dict:
    """Random intercepts and slopes by restricted likelihood. The data are read once, for the groups' cross products; every
    step of the search is one aggregate over these, for several candidates at once."""
    names, random = ["1", *xs], ["1", *slopes]
    p, q = len(names), len(random)
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    cross = lambda a, b: F.array(*[F.sum(col(i) * col(j)) for i in a for j in b])
    target = F.col(y).cast("double")
    g = df.groupBy(F.col(group).alias("g")).agg(cross(names, names).alias("xx"), cross(random, names).alias("zx"), cross(random, random).alias("zz"), F.array(*[F.sum(col(c) * target) for c in names]).alias("xy"), F.array(*[F.sum(col(c) * target) for c in random]).alias("zy"), F.sum(target * target).alias("yy"), F.count("*").alias("n")).cache()
    at = np.tril_indices(q)

    def factor(t: np.ndarray) -> np.ndarray:
        low = np.zeros((q, q))
        low[at] = t
        return low

    def parts(r: pd.DataFrame, low: np.ndarray) -> Iterator[tuple]:
        for xx, zx, zz, xy, zy in zip(r["xx"], r["zx"], r["zz"], r["xy"], r["zy"], strict=True):
            zx, zz, zy = np.reshape(zx, (q, p)), np.reshape(zz, (q, q)), np.asarray(zy)
            m = np.eye(q) + low.T @ zz @ low
            a = np.linalg.solve(m, low.T @ np.hstack([zx, zy[:, None]]))
            yield np.reshape(xx, (p, p)), np.asarray(xy), low.T @ zx, low.T @ zy, a, np.linalg.slogdet(m)[1]

    def score(candidates: Sequence[np.ndarray]) -> list[tuple]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(candidates), p * p + p + 3))
            for b in batches:
                for k, t in enumerate(candidates):
                    for xx, xy, lzx, lzy, a, logdet in parts(b, factor(t)):
                        total[k, : p * p] += (xx - lzx.T @ a[:, :-1]).reshape(-1)
                        total[k, p * p : -3] += xy - lzx.T @ a[:, -1]
                        total[k, -2] += logdet
                        total[k, -3] -= lzy @ a[:, -1]
                    total[k, -3] += b["yy"].sum()
                    total[k, -1] += b["n"].sum()
            yield pd.DataFrame({"k": np.arange(total.size), "v": total.reshape(-1)})

        s = g.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy().reshape(len(candidates), -1)
        out = []
        for r in s:
            h, v, yy, logdet, n = r[: p * p].reshape(p, p), r[p * p : -3], r[-3], r[-2], r[-1]
            beta = np.linalg.solve(h, v)
            s2 = max((yy - v @ beta) / (n - p), 1e-300)
            out.append((0.5 * ((n - p) * math.log(s2) + logdet + np.linalg.slogdet(h)[1]), beta, s2, np.linalg.inv(h) * s2))
        return out

    try:
        best, step = np.eye(q)[at] * 0.5, 0.5
        value = score([best])[0]
        for _ in range(rounds):
            moves = [best + step * s * e for e in np.eye(len(best)) for s in (-1, 1)]
            found = score(moves)
            k = int(np.argmin([f[0] for f in found]))
            if found[k][0] < value[0] - 1e-12:
                best, value = moves[k], found[k]
            else:
                step /= 3
                if step < 1e-5:
                    break
        low, (reml, beta, s2, cov) = factor(best), value
        n = df.count()
        effects = g.select("g", "xx", "zx", "zz", "xy", "zy")

        def blups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(low @ (a[:, -1] - a[:, :-1] @ beta)).tolist() for *_, a, _ in parts(b, low)]
                yield pd.DataFrame({"g": b["g"], "effects": rows})

        kind = df.schema[group].dataType.simpleString()
        random_effects = effects.mapInPandas(blups, f"g {kind}, effects array<double>").withColumnRenamed("g", group)
        var = low @ low.T * s2
        return {"coef": beta, "cov": cov, "residual_variance": s2, "random_covariance": var, "icc": float(var[0, 0] / (var[0, 0] + s2)), "reml": -reml - 0.5 * (n - p) * (1 + math.log(2 * math.pi)), "random_effects": random_effects, "xs": list(xs), "slopes": list(slopes)}
    finally:
        g.unpersist()


def population(m: dict) -> Column:
    """The prediction without group effects."""
    return mean_column({"coef": list(map(float, m["coef"]))}, m["xs"])


# nonlinear forms: fixed values, by name

FORMS: dict[str, tuple[str, tuple[str, ...]]] = {
    "linear": ("a + b*x", ("a", "b")),
    "powerLaw": ("a*x**b", ("a", "b")),
    "powerLawOffset": ("a*x**b + c", ("a", "b", "c")),
    "exponential": ("a*exp(b*x)", ("a", "b")),
    "exponentialDecay": ("a*exp(-x/tau) + c", ("a", "tau", "c")),
    "exponentialRise": ("a*(1 - exp(-x/tau)) + c", ("a", "tau", "c")),
    "inverseExponential": ("a*exp(b/x)", ("a", "b")),
    "logistic": ("L/(1 + exp(-k*(x - x0))) + c", ("L", "k", "x0", "c")),
    "saturation": ("a*x/(b + x)", ("a", "b")),
    "powerSaturation": ("a*x**n/(b**n + x**n)", ("a", "b", "n")),
    "gaussianPeak": ("a*exp(-(x - mu)**2/(2*sigma**2)) + c", ("a", "mu", "sigma", "c")),
    "weibullCdf": ("1 - exp(-(x/lam)**k)", ("lam", "k")),
    "sinusoid": ("a*sin(2*pi*f*x + phi) + c", ("a", "f", "phi", "c")),
    "rationalPower": ("a*x**n/(x + b)", ("a", "n", "b")),
    "linearPlusPower": ("a*x + b*x**n", ("a", "b", "n")),
    "logarithmic": ("a + b*log(x)", ("a", "b")),
    "inverse": ("a + b/x", ("a", "b")),
}


def register_form(name: str, text: str, parameters: Sequence[str]) -> None:
    if name in FORMS:
        raise ValueError(f"the form {name} is there")
    FORMS[name] = (text, tuple(parameters))


def form_start(df: DataFrame, name: str, x: str, y: str) -> dict[str, float]:
    """Starting values from a few sums: lines through transformed values where the form becomes one, else typical sizes."""
    one = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    s = one.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("x").alias("xm"), F.stddev_pop("x").alias("xs"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("y").alias("ym"), F.min_by("y", "x").alias("first"), F.max_by("y", "x").alias("last"), F.max_by("x", "y").alias("top")).first()
    line = lambda u, v: one.where((u.isNotNull()) & (v.isNotNull())).agg(F.regr_slope(v, u).alias("b"), F.regr_intercept(v, u).alias("a")).first()
    lx, ly = (F.when(F.col(c) > 0, F.log(c)) for c in ("x", "y"))
    cx, cy = F.col("x"), F.col("y")
    span = (s["x1"] - s["x0"]) or 1.0
    rise = s["last"] - s["first"]
    if name in ("powerLaw", "powerLawOffset", "rationalPower", "linearPlusPower"):
        r = line(lx, ly)
        a, b = math.exp(min(r["a"] or 0.0, 50)), r["b"] or 1.0
        return {"powerLaw": {"a": a, "b": b}, "powerLawOffset": {"a": a, "b": b, "c": 0.0}, "rationalPower": {"a": a, "n": b + 1, "b": 0.1 * span}, "linearPlusPower": {"a": rise / span, "b": 0.1 * rise / span**2, "n": 2.0}}[name]
    if name == "exponential":
        r = line(cx, ly)
        return {"a": math.exp(min(r["a"] or 0.0, 50)), "b": r["b"] or 0.0}
    if name == "inverseExponential":
        r = line(F.try_divide(F.lit(1.0), cx), ly)
        return {"a": math.exp(min(r["a"] or 0.0, 50)), "b": r["b"] or 0.0}
    if name in ("linear", "logarithmic", "inverse"):
        r = line({"linear": cx, "logarithmic": lx, "inverse": F.try_divide(F.lit(1.0), cx)}[name], cy)
        return {"a": r["a"], "b": r["b"]}
    return {
        "exponentialDecay": {"a": s["first"] - s["last"], "tau": span / 3, "c": s["last"]}, "exponentialRise": {"a": rise, "tau": span / 3, "c": s["first"]},
        "logistic": {"L": rise, "k": 8 / span, "x0": s["xm"], "c": s["first"]}, "saturation": {"a": 1.3 * s["y1"], "b": span / 3}, "powerSaturation": {"a": 1.1 * s["y1"], "b": s["xm"], "n": 1.5},
        "gaussianPeak": {"a": s["y1"] - s["y0"], "mu": s["top"], "sigma": span / 6, "c": s["y0"]}, "weibullCdf": {"lam": s["xm"], "k": 1.5}, "sinusoid": {"a": (s["y1"] - s["y0"]) / 2, "f": 1 / span, "phi": 0.0, "c": s["ym"]},
    }.get(name) or dict.fromkeys(FORMS[name][1], 1.0)


def form_fit(df: DataFrame, name: str, x: str, y: str, start: dict[str, float] | None = None) -> dict:
    """A registered form by nonlinear least squares, with its equation."""
    text, names = FORMS[name]
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    m = nonlinear(rows, text, {k: (start or form_start(df, name, x, y))[k] for k in names}, "y")
    return m | {"form": name, "equation": equation(text, m["parameters"])}


def equation(text: str, parameters: dict[str, float]) -> str:
    """A formula with its parameters' values in their names' places."""
    import re

    return re.sub(r"\b(" + "|".join(map(re.escape, parameters)) + r")\b", lambda m: f"{parameters[m[1]]:.6g}", text)


# dimensionless products


def dimension_matrix(variables: dict[str, dict[str, int] | Sequence[int]], names: Sequence[str] = ()) -> tuple[list[str], np.ndarray]:
    """(dimensions, exponents: one row a dimension, one column a variable)."""
    rows = list(names) or sorted({d for v in variables.values() if isinstance(v, dict) for d in v})
    return rows, np.array([[v.get(d, 0) if isinstance(v, dict) else v[k] for v in variables.values()] for k, d in enumerate(rows)], float)


def scaling_exponents(matrix: np.ndarray, target: np.ndarray, repeating: Sequence[int]) -> np.ndarray:
    """Exponents of the repeating variables whose product has the target's dimensions."""
    x, _, rank, _ = np.linalg.lstsq(matrix[:, list(repeating)], np.asarray(target, float), rcond=None)
    if np.abs(matrix[:, list(repeating)] @ x - target).max() > 1e-9:
        raise ValueError("the repeating variables do not span the target's dimensions")
    return x


def product_column(exponents: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, e in exponents.items():
        out = out * F.pow(F.col(name).cast("double"), F.lit(float(e)))
    return out


def dimensionless_fit(df: DataFrame, dimensions: dict[str, dict[str, int]], y: str) -> dict:
    """A power law between the dimensionless group that holds y and the others: least squares of logarithms."""
    groups = [{k: float(v) for k, v in g.items()} for g in pi_groups(dimensions)]
    own = next(k for k, g in enumerate(groups) if y in g)
    scale = groups[own][y]
    for k, g in enumerate(groups):
        if k != own and y in g:  # only the first keeps y
            f = g[y] / scale
            groups[k] = {n: v for n in {*g, *groups[own]} if abs(v := g.get(n, 0.0) - f * groups[own].get(n, 0.0)) > 1e-12}
    rest = [g for k, g in enumerate(groups) if k != own]
    data = df.select(F.log(product_column(groups[own])).alias("t"), *[F.log(product_column(g)).alias(f"g{k}") for k, g in enumerate(rest)])
    m = fit_one(data, [f"g{k}" for k in range(len(rest))], "t") if rest else {"coef": [data.agg(F.avg("t")).first()[0]]}
    return {"target": groups[own], "groups": rest, "coef": m["coef"], "y": y}


def dimensionless_predict(m: dict) -> Column:
    log = F.lit(float(m["coef"][0])) + sum((F.lit(float(c)) * F.log(product_column(g)) for c, g in zip(m["coef"][1:], m["groups"], strict=True)), F.lit(0.0))
    others = {n: e for n, e in m["target"].items() if n != m["y"]}
    return F.pow(F.exp(log) / product_column(others), F.lit(1 / m["target"][m["y"]]))


def group_text(exponents: dict[str, float]) -> str:
    return " ".join(f"{n}^{v:g}" if v != 1 else n for n, v in exponents.items())


# variance and transformed models


def noise_deviation(m: dict, xs: Sequence[str]) -> Column:
    """Standard deviation by the log-variance line of `heteroscedastic`."""
    return F.exp(mean_column({"coef": m["log_variance"]}, xs) / 2)


def variance_parameters(df: DataFrame, m: dict, xs: Sequence[str], y: str) -> dict:
    """Log-variance coefficients and their standard errors: the information of a gamma law of squares is X'X / 2."""
    gram, _, _ = _weighted_gram(df.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna(), xs, F.lit(0.5), F.lit(0.0), [])
    return {"coef": list(m["log_variance"]), "std_error": np.sqrt(np.diag(np.linalg.inv(gram))).tolist()}


def transformed_interval(df: DataFrame, m: dict, xs: Sequence[str], y: str, level: float = 0.95) -> tuple[Column, Column, Column]:
    """(median, lower, upper) of new values: the interval on the transformed scale, taken back."""
    fit = fit_one(df.withColumn("__z", box_cox(F.col(y), m["lambda"])), list(xs), "__z")
    half = normal_ppf(0.5 + level / 2) * fit["rmse"]
    eta = mean_column(fit, xs)
    return tuple(box_cox_inverse(eta + F.lit(d), m["lambda"]) for d in (0.0, -half, half))


# bootstraps


def residual_bootstrap(df: DataFrame, key: str, xs: Sequence[str], y: str, draws: int = 200, kind: str = "wild", seed: int = 0, at: Sequence[Sequence[float]] = (), level: float = 0.95) -> dict:
    """Percentile intervals of coefficients, and of means at points, of a linear model whose residuals are drawn again.

    wild: each row's residual with a sign hashed from its key and the draw. residual: the residual of a hashed row (rows are
    numbered by the order of their residuals' hash, so that no row moves). One aggregate for all draws: X'X stays.
    """
    data = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna()
    key = "_key"
    m = fit_one(data, list(xs), y)
    r = F.col(y) - mean_column(m, xs)
    names = [F.lit(1.0), *[F.col(c) for c in xs]]
    gram, _, _ = _weighted_gram(data, xs, F.lit(1.0), F.lit(0.0), [])
    if kind == "wild":
        draw = [F.when(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(b)), F.lit(2)) == 0, r).otherwise(-r) for b in range(draws)]
    else:
        # a draw from the residuals' law by its inverse, at a thousand and one quantiles of a mergeable sketch
        levels = [k / 1000 for k in range(1001)]
        cuts = data.select(r.alias("r")).agg(F.percentile_approx("r", F.array(*[F.lit(v) for v in levels]), F.lit(10_000))).first()[0]
        table_ = F.array(*[F.lit(float(c)) for c in cuts])
        draw = [F.get(table_, F.pmod(F.xxhash64(key, F.lit(seed), F.lit(b)), F.lit(1001)).cast("int")) for b in range(draws)]
    betas = []
    for lo in range(0, draws, 50):
        sums = data.agg(*[F.array(*[F.sum(c * d) for c in names]).alias(f"d{k}") for k, d in enumerate(draw[lo : lo + 50])]).first()
        betas += [np.array(m["coef"]) + np.linalg.solve(gram, np.array(sums[k], float)) for k in range(len(draw[lo : lo + 50]))]
    b = np.array(betas)
    q = [50 * (1 - level), 50 * (1 + level)]
    points = np.hstack([np.ones((len(at), 1)), np.asarray(at, float).reshape(len(at), -1)]) if len(at) else np.zeros((0, b.shape[1]))
    return {"coef": m["coef"], "lower": np.percentile(b, q[0], 0).tolist(), "upper": np.percentile(b, q[1], 0).tolist(), "std_error": b.std(0, ddof=1).tolist(), "at": np.percentile(b @ points.T, q, 0).T.tolist()}


# trees on binned columns of bounded groups, support vectors


def binned(x: np.ndarray, bins: int = 64) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    return codes_of(x, edges), edges


def codes_of(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for c, e in zip(x.T, edges, strict=True)], 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 8, least: int = 2, seed: int = 0) -> dict:
    """A forest on bootstrap rows, with out-of-bag predictions, error and R2."""
    codes, edges = binned(x)
    r = np.random.default_rng(seed)
    held, total, count = [], np.zeros(len(y)), np.zeros(len(y))
    for _ in range(trees):
        rows = r.integers(0, len(y), len(y))
        t = build_tree(codes[rows], -y[rows], np.ones(len(y)), depth, least)
        out = np.setdiff1d(np.arange(len(y)), rows)
        total[out] += t.predict(codes[out])
        count[out] += 1
        held.append(t)
    oob = np.where(count > 0, total / np.maximum(count, 1), np.nan)
    mse = float(np.nanmean((y - oob) ** 2))
    return {"trees": held, "edges": edges, "oob": oob, "mse": mse, "r2": 1 - mse / float(y.var())}


def forest_predict(m: dict, x: np.ndarray) -> np.ndarray:
    return np.mean([t.predict(codes_of(x, m["edges"])) for t in m["trees"]], 0)


def boosting(x: np.ndarray, y: np.ndarray, loss: str = "squared", rounds: int = 100, rate: float = 0.1, depth: int = 3, tau: float = 0.5, patience: int = 0, held: float = 0.2, seed: int = 0) -> dict:
    """Boosted trees on squared, absolute, Huber or quantile loss; leaves of the last three take the loss's own optimum.
    patience: rounds without a better loss on held rows, after which it stops."""
    codes, edges = binned(x)
    r = np.random.default_rng(seed)
    test = r.random(len(y)) < held if patience else np.zeros(len(y), bool)
    train = ~test
    start = float(np.mean(y[train]) if loss == "squared" else np.quantile(y[train], tau if loss == "quantile" else 0.5))
    f = np.full(len(y), start)
    trees: list[Tree] = []
    history, best, since = [], math.inf, 0
    for _ in range(rounds):
        e = y - f
        delta = np.quantile(np.abs(e[train]), 0.9) if loss == "huber" else 0.0
        g = {"squared": e, "absolute": np.sign(e), "quantile": np.where(e > 0, tau, tau - 1), "huber": np.clip(e, -delta, delta)}[loss]
        t = build_tree(codes[train], -g[train], np.ones(int(train.sum())), depth, 2)
        if loss != "squared":
            leaf = t.leaf(codes[train])
            for k in np.unique(leaf):
                own = e[train][leaf == k]
                mid = np.quantile(own, tau if loss == "quantile" else 0.5)
                t.value[k] = float(mid + (np.mean(np.sign(own - mid) * np.minimum(delta, np.abs(own - mid))) if loss == "huber" else 0))
        f = f + rate * t.predict(codes)
        trees.append(t)
        e = y - f
        each = {"squared": e**2, "absolute": np.abs(e), "quantile": e * (tau - (e < 0)), "huber": np.where(np.abs(e) <= delta, e**2 / 2, delta * (np.abs(e) - delta / 2))}[loss]
        history.append((float(each[train].mean()), float(each[test].mean()) if test.any() else math.nan))
        if patience:
            since = 0 if history[-1][1] < best else since + 1
            best = min(best, history[-1][1])
            if since >= patience:
                break
    return {"start": start, "trees": trees, "rate": rate, "edges": edges, "history": history}


def staged_predict(m: dict, x: np.ndarray, every: int = 1) -> np.ndarray:
    """Predictions (stages, rows) after every so many trees."""
    codes = codes_of(x, m["edges"])
    steps = m["start"] + m["rate"] * np.cumsum([t.predict(codes) for t in m["trees"]], 0)
    return steps[every - 1 :: every]


SVR_KERNELS: dict[str, Callable] = {
    "linear": lambda a, b, g, c, d: a @ b.T, "poly": lambda a, b, g, c, d: (g * a @ b.T + c) ** d, "sigmoid": lambda a, b, g, c, d: np.tanh(g * a @ b.T + c),
    "rbf": lambda a, b, g, c, d: np.exp(-g * ((a[:, None] - b[None]) ** 2).sum(-1)),
}


def svr_kernel(name: str, a: np.ndarray, b: np.ndarray, gamma: float = 1.0, coef: float = 0.0, degree: int = 3) -> np.ndarray:
    return SVR_KERNELS[name](a, b, gamma, coef, degree)


def svr_dual(k: np.ndarray, y: np.ndarray, cost: float = 1.0, epsilon: float = 0.1, tol: float = 1e-6, rounds: int = 100_000) -> tuple[np.ndarray, float, int]:
    """(coefficients a - a*, offset, steps) of epsilon regression: pairs of coefficients that break the optimum most move
    against each other, so that their sum stays zero."""
    b, f = np.zeros(len(y)), np.zeros(len(y))
    step = 0
    for step in range(1, rounds + 1):  # noqa: B007
        e = y - f
        up = np.where(b < cost, e - epsilon * np.where(b >= 0, 1, -1), -np.inf)
        down = np.where(b > -cost, e - epsilon * np.where(b > 0, 1, -1), np.inf)
        i, j = int(np.argmax(up)), int(np.argmin(down))
        if up[i] - down[j] < tol:
            break
        eta = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = (up[i] - down[j]) / eta
        t = min(t, cost - b[i], b[j] + cost)
        # a coefficient stops at zero, where the loss has its corner
        if b[i] < 0:
            t = min(t, -b[i])
        if b[j] > 0:
            t = min(t, b[j])
        b[i] += t
        b[j] -= t
        f += t * (k[:, i] - k[:, j])
    return b, float((up[i] + down[j]) / 2), step


# queries


def _q_glm(s, d):
    o = table(s, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("v"))
    m = glm_full(o.withColumn("z", F.lit(0.0) + F.col("v") * 0 + F.col("user_id") % 2), ["z"], "n", "poisson")
    mean, lower, upper = glm_interval(m)
    out = o.withColumn("z", F.col("user_id") % 2)
    return out.select("user_id", F.round(mean, 6).alias("mean"), F.round(glm_residual(m, "response"), 6).alias("response"), F.round(glm_residual(m, "pearson"), 6).alias("pearson"), F.round(glm_residual(m, "working"), 6).alias("working"), F.round(lower, 4).alias("lower"), F.round(upper, 4).alias("upper"), F.lit(round(m["null_deviance"], 5)).alias("null_deviance"), F.lit(round(m["pearson"], 5)).alias("chi2"))


def _q_quantile(s, d):
    """The check loss that the coefficients reach in each group: the least there is."""
    rows = lambda: table(s, d, "part").select((F.col("p_size") % 2).alias("g"), (F.col("p_partkey") % 2).cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    out = quantile_process(rows(), "g", ["x"], "y", [0.25, 0.5, 0.9])
    both = out.join(rows(), "g")
    return both.groupBy("g", "tau").agg(F.round(F.sum(check_loss(F.col("y") - F.col("coef")[0] - F.col("coef")[1] * F.col("x"), F.col("tau"))), 4).alias("loss"))


def _q_gam_linear(s, d):
    m = gam_fit(table(s, d, "part").select("p_size", "p_retailprice"), [{"x": "p_size", "kind": "linear"}], "p_retailprice")
    out = gam_predict(m, s.range(1, 51).select(F.col("id").cast("int").alias("p_size")), parts=True)
    return out.select("p_size", F.round("mean", 5).alias("mean"), F.round(F.col("parts")[0]["fit"], 5).alias("effect"))


def _q_gam(s, d):
    li = table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_discount")
    m = gam_fit(li, [{"x": "l_quantity", "kind": "spline", "segments": 5}, {"x": "l_returnflag", "kind": "factor"}], "l_extendedprice")
    return s.createDataFrame([(t["term"], t["edf"], t["wald"]) for t in gam_terms(m)], "term string, edf double, wald double")


def _q_shape(s, d):
    m = shape_spline(table(s, d, "part").select("p_size", (F.col("p_size") * 2.0 + 1).alias("y")), "p_size", "y")
    at = np.arange(1, 51.0)
    return s.createDataFrame([(int(a), round(float(v), 3)) for a, v in zip(at, shape_values(m, at), strict=True)], "x int, y double")


def _q_mixed(s, d):
    """Balanced groups: the mean, and variances from mean squares, in closed form."""
    o = table(s, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("double").alias("y"))
    m = mixed_fit(o, "n_regionkey", [], "y")
    return s.createDataFrame([(round(float(m["coef"][0]), 4), round(float(m["residual_variance"]), 2), round(float(m["random_covariance"][0, 0]), 2))], "mean double, within double, between double")


def _q_form(s, d):
    p = table(s, d, "part").select(F.col("p_size").cast("double").alias("x"))
    rows = []
    for name, truth in (("exponentialDecay", {"a": 3.0, "tau": 9.0, "c": 1.0}), ("saturation", {"a": 5.0, "b": 12.0}), ("powerLaw", {"a": 2.0, "b": 0.7}), ("logarithmic", {"a": 1.0, "b": 2.0}), ("logistic", {"L": 4.0, "k": 0.3, "x0": 25.0, "c": 1.0})):
        from gramlake.functions.scalars import formula

        y = formula(FORMS[name][0], x=F.col("x"), **{k: F.lit(v) for k, v in truth.items()})
        m = form_fit(p.select("x", y.alias("y")), name, "x", "y")
        rows += [(name, k, round(v, 4)) for k, v in m["parameters"].items()]
    return s.createDataFrame(rows, "form string, parameter string, value double")


def _q_dimensionless(s, d):
    """A pendulum's period from length and gravity."""
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("length"), F.lit(9.81).alias("g")).withColumn("period", 2 * math.pi * F.sqrt(F.col("length") / F.col("g")))
    m = dimensionless_fit(p, {"period": {"T": 1}, "length": {"L": 1}, "g": {"L": 1, "T": -2}}, "period")
    return p.select("p_partkey", F.round(dimensionless_predict(m), 8).alias("period"))


def _q_trees(s, d):
    r = np.random.default_rng(0)
    x = r.random((400, 3))
    y = np.where(x[:, 0] > 0.5, 3.0, 0.0) + x[:, 1]
    f, b = forest(x, y, 30), boosting(x, y, patience=10)
    rows = [("oob", f["r2"] > 0.95), ("depth", max(t.depth() for t in f["trees"]) <= 8), ("stages", len(staged_predict(b, x, 10)) == len(b["trees"]) // 10), ("falls", b["history"][-1][0] < 0.1 * b["history"][0][0])]
    c, rho, _ = svr_dual(svr_kernel("linear", x, x), 2 * x[:, 0] - x[:, 1] + 0.3, 100.0, 0.01)
    rows += [("svr", float(np.abs(svr_kernel("linear", x, x) @ c + rho - (2 * x[:, 0] - x[:, 1] + 0.3)).max()) < 0.011), ("sum", abs(c.sum()) < 1e-9)]
    rows.append(("importance", True if importance(f["trees"], 3).argmax() == 0 else False))
    return s.createDataFrame([(n, bool(v)) for n, v in rows], "name string, holds boolean")


def _q_bootstrap(s, d):
    li = table(s, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = []
    for kind in ("wild", "residual"):
        m = residual_bootstrap(li, "p_partkey", ["p_size"], "p_retailprice", 100, kind, at=[[25.0]])
        out += [(kind, k, all(a <= c <= b for a, c, b in zip(m["lower"], m["coef"], m["upper"], strict=True))) for k in ("covers",)]
        out.append((kind, "ordered", m["at"][0][0] < m["at"][0][1]))
    return s.createDataFrame(out, "kind string, name string, holds boolean")


QUERIES = {
    "glm_inspect": _q_glm, "quantile_process": _q_quantile, "gam_linear": _q_gam_linear, "gam_terms": _q_gam, "shape_spline": _q_shape, "mixed_slopes": _q_mixed, "library_forms": _q_form, "dimensionless": _q_dimensionless, "tree_checks": _q_trees,
    "residual_bootstrap": _q_bootstrap,
}
_N = "SELECT user_id, count(*)::DOUBLE AS n, user_id % 2 AS z FROM events GROUP BY user_id"
SQL = {
    "glm_inspect": f"WITH o AS ({_N}), m AS (SELECT *, avg(n) OVER (PARTITION BY z) AS mu, sum(n) OVER (PARTITION BY z) AS t, avg(n) OVER () AS a FROM o) SELECT user_id, round(mu, 6) AS mean, round(n - mu, 6) AS response, round((n - mu) / sqrt(mu), 6) AS pearson, round((n - mu) / mu, 6) AS working, round(mu * exp(-1.959963984540054 / sqrt(t)), 4) AS lower, round(mu * exp(1.959963984540054 / sqrt(t)), 4) AS upper, round(sum(2 * (n * ln(n / a) - (n - a))) OVER (), 5) AS null_deviance, round(sum((n - mu) * (n - mu) / mu) OVER (), 5) AS chi2 FROM m",
    "quantile_process": "WITH p AS (SELECT p_size % 2 AS g, p_partkey % 2 AS x, p_retailprice AS y, t::DOUBLE AS tau FROM part, (VALUES (0.25), (0.5), (0.9)) v(t)), q AS (SELECT g, x, tau, CASE tau WHEN 0.25 THEN quantile_disc(y, 0.25) WHEN 0.5 THEN quantile_disc(y, 0.5) ELSE quantile_disc(y, 0.9) END AS m FROM p GROUP BY 1, 2, 3) SELECT g, tau, round(sum((y - m) * (tau - CASE WHEN y < m THEN 1 ELSE 0 END)), 4) AS loss FROM p JOIN q USING (g, x, tau) GROUP BY 1, 2",
    "gam_linear": "WITH m AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, avg(p_size) AS c FROM part) SELECT x::INTEGER AS p_size, round(a + b * x, 5) AS mean, round(b * (x - c), 5) AS effect FROM m, range(1, 51) t(x)",
    "shape_spline": "SELECT x::INTEGER AS x, (2 * x + 1)::DOUBLE AS y FROM range(1, 51) t(x)",
    "mixed_slopes": "WITH g AS (SELECT n_regionkey, count(*) AS n, avg(n_nationkey) AS m, sum(n_nationkey * n_nationkey) - count(*) * pow(avg(n_nationkey), 2) AS w FROM nation GROUP BY 1), a AS (SELECT avg(m) AS mean, sum(w) / sum(n - 1) AS within, var_samp(m) AS bm, avg(n) AS n, count(*) AS k, sum(w) AS ssw, sum(n) AS nn FROM g) SELECT round(mean, 4) AS mean, round(CASE WHEN bm > within / n THEN within ELSE (ssw + n * bm * (k - 1)) / (nn - 1) END, 2) AS within, round(greatest(bm - within / n, 0), 2)::DOUBLE AS between FROM a",
    "library_forms": "SELECT * FROM (VALUES ('exponentialDecay', 'a', 3.0::DOUBLE), ('exponentialDecay', 'tau', 9.0), ('exponentialDecay', 'c', 1.0), ('saturation', 'a', 5.0), ('saturation', 'b', 12.0), ('powerLaw', 'a', 2.0), ('powerLaw', 'b', 0.7), ('logarithmic', 'a', 1.0), ('logarithmic', 'b', 2.0), ('logistic', 'L', 4.0), ('logistic', 'k', 0.3), ('logistic', 'x0', 25.0), ('logistic', 'c', 1.0)) t(form, parameter, value)",
    "dimensionless": "SELECT p_partkey, round(2 * pi() * sqrt(p_size / 10.0 / 9.81), 8) AS period FROM part",
    "tree_checks": "SELECT name, true AS holds FROM (VALUES ('oob'), ('depth'), ('stages'), ('falls'), ('svr'), ('sum'), ('importance')) t(name)",
    "residual_bootstrap": "SELECT kind, name, true AS holds FROM (VALUES ('wild'), ('residual')) a(kind), (VALUES ('covers'), ('ordered')) b(name)",
}
