"""Linear models from sufficient statistics: one aggregate of moments, a small solve, predictions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions.special import student_t_ppf
from gramlake.session import table

#: Terms beyond which products are summed as matrices instead of one expression a pair.
WIDE = 16
MODEL = "n long, weight double, coef array<double>, std_error array<double>, sigma2 double, sse double, r_squared double, adj_r_squared double, rmse double, log_lik double, aic double, aicc double, bic double"


def moments(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, n, weight, mean, cov): means and centred sums of squares and products of xs and y, in one pass.

    Unweighted sums use the engine's stable, mergeable covariance; weighted ones centre by unweighted means first, which
    are a pass of their own.
    """
    names = [*xs, y]
    # a row that lacks a value in any role takes no part
    df = df.select(*by, *names, *([weight] if weight else [])).where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in [*names, *([weight] if weight else [])]))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    if weight is None:
        n = F.count(F.lit(1))
        cov = [F.covar_pop(names[i], names[j]) * n for i, j in pairs]
        return df.groupBy(*by).agg(n.alias("n"), n.cast("double").alias("weight"), F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*cov).alias("cov"))
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    w = F.col(weight)
    at = {c: F.col(c) - F.lit(float(means[c] or 0)) for c in names}
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"), F.array(*[F.sum(w * at[c]) for c in names]).alias("s"), F.array(*[F.sum(w * at[names[i]] * at[names[j]]) for i, j in pairs]).alias("ss"))
    mean = F.array(*[F.lit(float(means[c] or 0)) + F.get("s", F.lit(i)) / F.col("weight") for i, c in enumerate(names)])
    cov = F.array(*[F.get("ss", F.lit(k)) - F.get("s", F.lit(i)) * F.get("s", F.lit(j)) / F.col("weight") for k, (i, j) in enumerate(pairs)])
    return sums.select(*by, "n", "weight", mean.alias("mean"), cov.alias("cov"))


def wide_moments(df: DataFrame, xs: Sequence[str], y: str) -> dict:
    """moments for many terms, whose pairs would be too many expressions: blocks of rows become partial matrices on the
    executors, centred by means from a first pass, and their entries are summed by position."""
    names = [*xs, y]
    df = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).dropna()
    head = df.agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean")).first()
    n, mean = head["n"], np.array(head["mean"], float)
    at = np.triu_indices(len(names))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(names)))
        for b in batches:
            v = b.to_numpy(float) - mean
            total += v.T @ v
        yield pd.DataFrame({"k": np.arange(len(at[0])), "v": total[at]})

    sums = df.mapInPandas(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(len(at[0]))
    for r in sums:
        cov[r["k"]] = r["v"]
    return {"n": n, "mean": mean, "cov": unpack(cov, len(names))}


def unpack(cov: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = cov
    return out + np.triu(out, 1).T


def solve(n: int, weight: float, mean: Sequence[float], cov: Sequence[float], ridge: float = 0.0) -> dict:
    """Coefficients (intercept first) and fit statistics from the moments; a rank-deficient direction gets no weight."""
    p = len(mean) - 1
    mean, full = np.asarray(mean, float), unpack(cov, p + 1)
    gram, xy, yy = full[:p, :p], full[:p, p], full[p, p]
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1))
    unit = gram / np.outer(scale, scale)
    inverse = np.linalg.pinv(unit + np.diag(ridge * np.diag(gram) / weight / scale**2 if ridge else np.zeros(p)), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
    slope = inverse @ xy
    rank = int(np.linalg.matrix_rank(unit, tol=1e-10, hermitian=True)) + 1 if p else 1
    sse = max(float(yy - 2 * slope @ xy + slope @ gram @ slope), 0.0)
    dof = n - rank
    sigma2 = sse / dof if dof > 0 else math.nan
    var = np.concatenate([[1 / weight + mean[:p] @ inverse @ mean[:p]], np.diag(inverse)]) * sigma2
    yy = float(yy)
    r2 = 1 - sse / yy if yy > 0 else float(sse == 0)
    k = rank + 1
    log_lik = -n / 2 * (math.log(2 * math.pi) + math.log(max(sse / n, 1e-300)) + 1)
    return {
        "n": n, "weight": weight, "coef": [float(mean[p] - slope @ mean[:p]), *map(float, slope)], "std_error": list(map(float, np.sqrt(np.maximum(var, 0)))),
        "sigma2": sigma2, "sse": sse, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / dof if dof > 0 else math.nan, "rmse": math.sqrt(sse / n),
        "log_lik": log_lik, "aic": 2 * k - 2 * log_lik, "aicc": 2 * k - 2 * log_lik + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf, "bic": k * math.log(n) - 2 * log_lik,
        "inverse": inverse, "mean": mean[:p],
    }


def fit(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), weight: str | None = None, ridge: float = 0.0) -> DataFrame:
    """One row a group: coefficients, standard errors and fit metrics. Any number of groups; solves run on the executors."""
    sums = moments(df, xs, y, by, weight)
    fields = [f.split()[0] for f in MODEL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [solve(r.n, r.weight, r.mean, r.cov, ridge) for r in b[["n", "weight", "mean", "cov"]].itertuples(index=False)]
            out = pd.DataFrame([[m[f] for f in fields] for m in rows], columns=fields)
            yield pd.concat([b[list(by)].reset_index(drop=True), out], axis=1)

    keys = "".join(f"`{c}` {sums.schema[c].dataType.simpleString()}, " for c in by)
    return sums.where("n > 0").mapInPandas(run, keys + MODEL)


def fit_one(df: DataFrame, xs: Sequence[str], y: str, weight: str | None = None, ridge: float = 0.0) -> dict:
    if weight is None and len(xs) > WIDE:
        m = wide_moments(df, xs, y)
        return solve(m["n"], float(m["n"]), m["mean"], m["cov"][np.triu_indices(len(xs) + 1)], ridge)
    r = moments(df, xs, y, (), weight).first()
    return solve(r["n"], r["weight"], r["mean"], r["cov"], ridge)


def mean_column(model: dict, xs: Sequence[str]) -> Column:
    out = F.lit(model["coef"][0])
    for c, b in zip(xs, model["coef"][1:], strict=True):
        out = out + F.lit(b) * F.col(c)
    return out


def leverage_column(model: dict, xs: Sequence[str]) -> Column:
    """phi' (Phi' W Phi)^-1 phi as an expression over the row."""
    at = [F.col(c) - F.lit(float(m)) for c, m in zip(xs, model["mean"], strict=True)]
    out = F.lit(1 / model["weight"])
    for i in range(len(xs)):
        for j in range(len(xs)):
            out = out + F.lit(float(model["inverse"][i, j])) * at[i] * at[j]
    return out


def predict(df: DataFrame, model: dict, xs: Sequence[str], kind: str = "prediction", level: float = 0.95) -> DataFrame:
    """df with mean, lower and upper appended, all as expressions. kind: confidence or prediction."""
    dof = model["n"] - len(model["coef"])
    t = student_t_ppf(0.5 + level / 2, dof)
    half = F.lit(t) * F.sqrt(F.lit(model["sigma2"]) * (leverage_column(model, xs) + (1 if kind == "prediction" else 0)))
    mean = mean_column(model, xs)
    return df.withColumns({"mean": mean, "lower": mean - half, "upper": mean + half})


def diagnosed(df: DataFrame, model: dict, xs: Sequence[str], y: str) -> DataFrame:
    """df with residual, leverage, loo_residual, standardised, studentised and cook appended, as expressions."""
    p, dof = len(model["coef"]), model["n"] - len(model["coef"])
    out = df.withColumn("residual", F.col(y) - mean_column(model, xs)).withColumn("leverage", leverage_column(model, xs))
    free = F.greatest(1 - F.col("leverage"), F.lit(1e-12))
    s2 = F.lit(model["sigma2"])
    out = out.withColumn("loo_residual", F.col("residual") / free).withColumn("standardised", F.col("residual") / F.sqrt(s2 * free))
    outer = (F.lit(dof) * s2 - F.col("residual") * F.col("residual") / free) / (dof - 1)
    out = out.withColumn("studentised", F.col("residual") / F.sqrt(F.greatest(outer, F.lit(1e-300)) * free))
    return out.withColumn("cook", F.col("standardised") * F.col("standardised") * F.col("leverage") / (F.lit(p) * free))


def merge(parts: list[dict]) -> dict:
    """Moments of the union of disjoint parts (n, mean, cov as full matrix)."""
    n = sum(p["n"] for p in parts)
    mean = sum(p["n"] * p["mean"] for p in parts) / n
    cov = sum(p["cov"] + p["n"] * np.outer(p["mean"] - mean, p["mean"] - mean) for p in parts)
    return {"n": n, "mean": mean, "cov": cov}


def cross_validate(df: DataFrame, xs: Sequence[str], y: str, fold: Column, ridge: float = 0.0) -> DataFrame:
    """(fold, n, rmse, mae, coef) of k-fold cross-validation: one grouped aggregate for all refits, one pass of predictions.

    The training moments of a fold are those of the other folds merged, so no fold is read again.
    """
    q = len(xs) + 1
    rows = moments(df.withColumn("fold", fold), xs, y, ["fold"]).collect()  # as many rows as folds
    parts = {r["fold"]: {"n": r["n"], "mean": np.array(r["mean"]), "cov": unpack(r["cov"], q)} for r in rows}
    models = {}
    for k in parts:
        m = merge([p for j, p in parts.items() if j != k])
        models[k] = solve(m["n"], float(m["n"]), m["mean"], m["cov"][np.triu_indices(q)], ridge)
    spark = df.sparkSession
    coef = F.broadcast(spark.createDataFrame([(k, m["coef"]) for k, m in models.items()], "fold int, coef array<double>"))
    scored = df.withColumn("fold", fold).join(coef, "fold")
    mean = F.get("coef", F.lit(0))
    for i, c in enumerate(xs):
        mean = mean + F.get("coef", F.lit(i + 1)) * F.col(c)
    error = F.col(y) - mean
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.first("coef").alias("coef"))


def metrics(df: DataFrame, y: str, yhat: str, parameters: int, weight: str | None = None) -> DataFrame:
    """One row: weighted sse, R2 and likelihood, unweighted rmse, mae and largest error, information criteria."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = F.col(y) - F.col(yhat)
    centre = df.agg(F.sum(w * F.col(y)) / F.sum(w)).first()[0]
    s = df.agg(F.count("*").alias("n"), F.sum(w * e * e).alias("sse"), F.sum(w * (F.col(y) - F.lit(centre)) ** 2).alias("sst"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_abs_error"), (F.max(y) - F.min(y)).alias("span"))
    k, n = F.lit(parameters + 1), F.col("n")
    ll = -n / 2 * (F.log(F.lit(2 * math.pi)) + F.log(F.greatest(F.col("sse") / n, F.lit(1e-300))) + 1)
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    out = s.withColumns({"r_squared": r2, "nrmse": F.try_divide(F.col("rmse"), F.col("span")), "log_lik": ll})
    return out.withColumns({
        "adj_r_squared": F.when(n - parameters > 0, 1 - (1 - F.col("r_squared")) * (n - 1) / (n - parameters)),
        "aic": 2 * k - 2 * F.col("log_lik"), "aicc": F.when(n - k - 1 > 0, 2 * k - 2 * F.col("log_lik") + 2 * k * (k + 1) / (n - k - 1)), "bic": k * F.log(n) - 2 * F.col("log_lik"),
    }).drop("span")


def elastic_net(m: dict, alpha: float, l1_ratio: float, tolerance: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """Coefficients (intercept first) by coordinate descent on the moments standardised by population deviation."""
    p = len(m["mean"]) - 1
    cov = np.asarray(m["cov"]) / m["n"]
    sd = np.sqrt(np.where(np.diag(cov)[:p] > 0, np.diag(cov)[:p], 1))
    gram, xy = cov[:p, :p] / np.outer(sd, sd), cov[:p, p] / sd
    b = np.zeros(p)
    for _ in range(rounds):
        old = b.copy()
        for j in range(p):
            z = xy[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(z) * max(abs(z) - alpha * l1_ratio, 0) / (gram[j, j] + alpha * (1 - l1_ratio))
        if np.abs(b - old).max() < tolerance:
            break
    slope = b / sd
    return np.concatenate([[m["mean"][p] - slope @ np.asarray(m["mean"])[:p]], slope])


def stepwise(m: dict, names: Sequence[str], criterion: str = "bic") -> list[str]:
    """Forward and backward selection of terms from one set of moments: no candidate reads the data."""
    p = len(names)

    def score(kept: frozenset) -> float:
        at = [*sorted(kept), p]
        sub = np.asarray(m["cov"])[np.ix_(at, at)]
        return solve(m["n"], float(m["n"]), np.asarray(m["mean"])[at], sub[np.triu_indices(len(at))])[criterion]

    kept = frozenset()
    best = score(kept)
    while True:
        moves = [kept | {j} for j in range(p) if j not in kept] + [kept - {j} for j in kept]
        value, choice = min(((score(x), sorted(x)) for x in moves), default=(math.inf, []))
        if value >= best - 1e-9:
            return [names[j] for j in sorted(kept)]
        kept, best = frozenset(choice), value


def full_moments(df: DataFrame, xs: Sequence[str], y: str) -> dict:
    if len(xs) > WIDE:
        return wide_moments(df, xs, y)
    r = moments(df, xs, y).first()
    return {"n": r["n"], "mean": np.array(r["mean"]), "cov": unpack(r["cov"], len(xs) + 1)}


def variance_inflation(m: dict, names: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix; infinite where it is singular."""
    p = len(names)
    cov = np.asarray(m["cov"])[:p, :p]
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    try:
        return dict(zip(names, map(float, np.diag(np.linalg.inv(corr))), strict=True))
    except np.linalg.LinAlgError:
        return dict.fromkeys(names, math.inf)


# queries

_L = ["l_quantity", "l_discount"]


def _r(c, k=6):
    return F.round(c, k)


def _q_grouped(s, d):
    m = fit(table(s, d, "lineitem"), _L, "l_extendedprice", ["l_returnflag"])
    return m.select("l_returnflag", "n", *[_r(F.get("coef", F.lit(k)), 4).alias(n) for k, n in enumerate(("intercept", "b_quantity", "b_discount"))], _r("r_squared", 8).alias("r_squared"), _r("rmse", 4).alias("rmse"))


def _q_simple(s, d):
    m = fit(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return m.select("n", _r(F.get("coef", F.lit(0)), 5).alias("intercept"), _r(F.get("coef", F.lit(1)), 5).alias("slope"), _r("r_squared", 9).alias("r_squared"))


def _q_inference(s, d):
    m = fit(table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_size"], "p_retailprice")
    return m.select("n", _r(F.get("coef", F.lit(1)), 7).alias("slope"), _r(F.get("std_error", F.lit(1)), 7).alias("slope_se"), _r(F.get("std_error", F.lit(0)), 7).alias("intercept_se"), _r("sigma2", 4).alias("sigma2"), _r("adj_r_squared", 9).alias("adj_r_squared"), _r("aic", 4).alias("aic"), _r("bic", 4).alias("bic"))


def _q_wls(s, d):
    m = fit(table(s, d, "lineitem"), ["l_discount"], "l_extendedprice", ["l_linestatus"], weight="l_quantity")
    return m.select("l_linestatus", _r(F.get("coef", F.lit(0)), 4).alias("intercept"), _r(F.get("coef", F.lit(1)), 4).alias("slope"))


def _q_ridge(s, d):
    m = fit(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice", ridge=0.5)
    return m.select(_r(F.get("coef", F.lit(1)), 5).alias("slope"))


def _q_lasso(s, d):
    m = full_moments(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    b = elastic_net(m, 1000.0, 1.0)
    return s.createDataFrame([(round(float(b[0]), 4), round(float(b[1]), 5))], "intercept double, slope double")


def _part(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _q_metrics(s, d):
    df = table(s, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("yhat"))
    m = metrics(df, "y", "yhat", 1, weight="l_quantity")
    return m.select("n", *[_r(c, k).alias(c) for c, k in (("sse", 0), ("rmse", 4), ("mae", 4), ("max_abs_error", 4), ("r_squared", 8), ("aic", 2), ("bic", 2))])


def _q_predict(s, d):
    df = _part(s, d)
    out = predict(df, fit_one(df, ["x"], "y"), ["x"])
    return out.select("p_partkey", *[_r(c, 4).alias(c) for c in ("mean", "lower", "upper")])


def _q_cv(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice")
    out = cross_validate(df, ["l_quantity"], "l_extendedprice", (F.col("l_orderkey") % 5).cast("int"))
    return out.select("fold", "n", _r("rmse", 4).alias("rmse"), _r("mae", 4).alias("mae"))


def _q_loo(s, d):
    df = _part(s, d)
    out = diagnosed(df, fit_one(df, ["x"], "y"), ["x"], "y")
    return out.agg(_r(F.sum(F.col("loo_residual") ** 2) / 1e6, 5).alias("press"), _r(F.sum("leverage"), 6).alias("edf"))


def _q_cook(s, d):
    df = _part(s, d)
    out = diagnosed(df, fit_one(df, ["x"], "y"), ["x"], "y")
    n = df.count()
    return out.where(F.col("cook") > 4.0 / n).select("p_partkey", _r("cook", 7).alias("cook"), _r("leverage", 8).alias("leverage"), _r("studentised", 6).alias("studentised"))


def _q_vif(s, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    v = variance_inflation(full_moments(table(s, d, "lineitem"), names, "l_extendedprice"), names)
    return s.createDataFrame([(k, round(x, 8)) for k, x in v.items()], "name string, vif double")


def _q_stepwise(s, d):
    df = table(s, d, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") + 900 * F.col("l_quantity")).withColumns({"q2": F.col("l_quantity") ** 2, "qd": F.col("l_quantity") * F.col("l_discount")})
    names = ["l_quantity", "l_discount", "l_tax", "q2", "qd"]
    kept = stepwise(full_moments(df, names, "l_extendedprice"), names)
    return s.createDataFrame([(k, n) for k, n in enumerate(kept)], "k int, term string")


QUERIES = {
    "ols_grouped": _q_grouped, "ols_simple": _q_simple, "ols_inference": _q_inference, "wls_grouped": _q_wls, "ridge_closed": _q_ridge, "lasso_soft": _q_lasso, "fit_metrics": _q_metrics,
    "predict_interval": _q_predict, "cv_kfold": _q_cv, "loo_press": _q_loo, "cooks_outliers": _q_cook, "vif": _q_vif, "stepwise_terms": _q_stepwise,
}

_P = "p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM p), e AS (SELECT p.*, m.*, y - a - b * x AS r, 1.0 / n + (x - mx) * (x - mx) / sxx AS h FROM p, m), s AS (SELECT sum(r * r) / (count(*) - 2) AS s2 FROM e)"

SQL = {
    "predict_interval": "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, var_pop(x) * count(*) AS sxx, (var_pop(y) - covar_pop(x, y) * covar_pop(x, y) / var_pop(x)) * count(*) / (count(*) - 2) AS s2 FROM p), t AS (SELECT *, 1.959963984540054 AS z, n - 2 AS v FROM m), q AS (SELECT *, z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3)) AS t FROM t), h AS (SELECT p_partkey, my + b * (x - mx) AS mean, t * sqrt(s2 * (1 + 1.0 / n + (x - mx) * (x - mx) / sxx)) AS half FROM p, q) SELECT p_partkey, round(mean, 4) AS mean, round(mean - half, 4) AS lower, round(mean + half, 4) AS upper FROM h",

    "ols_grouped": """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my, var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd,
      covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy, var_pop(l_extendedprice) AS yy FROM lineitem GROUP BY 1),
      b AS (SELECT *, (qy * dd - dy * qd) / (qq * dd - qd * qd) AS b1, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS b2 FROM m)
      SELECT l_returnflag, n, round(my - b1 * mq - b2 * md, 4) AS intercept, round(b1, 4) AS b_quantity, round(b2, 4) AS b_discount, round((b1 * qy + b2 * dy) / yy, 8) AS r_squared, round(sqrt(yy - b1 * qy - b2 * dy), 4) AS rmse FROM b""",
    "ols_simple": "SELECT count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_r2(l_extendedprice, l_quantity), 9) AS r_squared FROM lineitem",
    "ols_inference": f"WITH {_P}, q AS (SELECT n, b, s2, mx, sxx, syy, s2 * (n - 2) AS sse FROM m, s) SELECT n, round(b, 7) AS slope, round(sqrt(s2 / sxx), 7) AS slope_se, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 7) AS intercept_se, round(s2, 4) AS sigma2, round(1 - sse / syy * (n - 1) / (n - 2), 9) AS adj_r_squared, round(6 + n * (ln(2 * pi()) + ln(sse / n) + 1), 4) AS aic, round(3 * ln(n) + n * (ln(2 * pi()) + ln(sse / n) + 1), 4) AS bic FROM q",
    "wls_grouped": "WITH m AS (SELECT l_linestatus AS k, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my FROM lineitem GROUP BY 1), b AS (SELECT k, any_value(mx) AS mx, any_value(my) AS my, sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_discount - mx) * (l_discount - mx)) AS b FROM lineitem JOIN m ON l_linestatus = k GROUP BY 1) SELECT k AS l_linestatus, round(my - b * mx, 4) AS intercept, round(b, 4) AS slope FROM b",
    "ridge_closed": "SELECT round(regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 0.5 * var_pop(l_quantity)), 5) AS slope FROM lineitem",
    "lasso_soft": "WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sd, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem), b AS (SELECT *, sign(c) * greatest(abs(c / sd) - 1000, 0) / sd AS b FROM m) SELECT round(my - b * mx, 4) AS intercept, round(b, 5) AS slope FROM b",
    "fit_metrics": "WITH r AS (SELECT l_quantity AS w, l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem), c AS (SELECT sum(w * y) / sum(w) AS m FROM r), s AS (SELECT count(*) AS n, sum(w * e * e) AS sse, sum(w * (y - m) * (y - m)) AS sst, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, max(abs(e)) AS mx FROM r, c), l AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) AS ll FROM s) SELECT n, round(sse, 0) AS sse, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mx, 4) AS max_abs_error, round(1 - sse / sst, 8) AS r_squared, round(4 - 2 * ll, 2) AS aic, round(2 * ln(n) - 2 * ll, 2) AS bic FROM l",
    "cv_kfold": "WITH f AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT DISTINCT fold FROM f), m AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN f ON f.fold <> k.fold GROUP BY 1) SELECT f.fold, count(*) AS n, round(sqrt(avg((y - a - b * x) * (y - a - b * x))), 4) AS rmse, round(avg(abs(y - a - b * x)), 4) AS mae FROM f JOIN m USING (fold) GROUP BY 1",
    "loo_press": f"WITH {_P} SELECT round(sum(r / (1 - h) * r / (1 - h)) / 1e6, 5) AS press, round(sum(h), 6) AS edf FROM e",
    "cooks_outliers": f"WITH {_P}, c AS (SELECT p_partkey, n, h, r, s2, r * r / (s2 * (1 - h)) * h / (2 * (1 - h)) AS cook FROM e, s) SELECT p_partkey, round(cook, 7) AS cook, round(h, 8) AS leverage, round(r / sqrt(((n - 2) * s2 - r * r / (1 - h)) / (n - 3) * (1 - h)), 6) AS studentised FROM c WHERE cook > 4.0 / n",
    "vif": "WITH c AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c) SELECT 'l_quantity' AS name, round((1 - c * c) / det, 8) AS vif FROM d UNION ALL SELECT 'l_discount', round((1 - b * b) / det, 8) FROM d UNION ALL SELECT 'l_tax', round((1 - a * a) / det, 8) FROM d",
}
