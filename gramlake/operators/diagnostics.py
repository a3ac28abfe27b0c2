"""Tests of residuals and distributions: power sums, ordered windows, auxiliary regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.functions.special import chi2_sf2, normal_cdf
from gramlake.operators.linear import fit, fit_one, mean_column
from gramlake.session import table


def shape(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, skew, kurt, jb, jb_p): population skewness and kurtosis by the engine's stable aggregates, and Jarque-Bera."""
    out = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.skewness(column).alias("skew"), (F.kurtosis(column) + 3).alias("kurt"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + (F.col("kurt") - 3) ** 2 / 4)
    return out.withColumn("jb", jb).withColumn("jb_p", chi2_sf2(jb))


def skew_z(n: float, skew: float) -> float:
    """D'Agostino's z of a skewness; not defined under 8 values."""
    if n < 8:
        return math.nan
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    return math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))


def kurtosis_z(n: float, kurt: float) -> float:
    """Anscombe and Glynn's z of a kurtosis; not defined under 5 values."""
    if n < 5:
        return math.nan
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - mean) / math.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    cube = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    return (1 - 2 / (9 * a) - math.copysign(abs(cube) ** (1 / 3), cube)) / math.sqrt(2 / (9 * a))


def normal_test(df: DataFrame, column: str) -> dict[str, float]:
    """K2 of D'Agostino and Pearson, with its parts and p value."""
    r = shape(df, column).first()
    a, b = skew_z(r["n"], r["skew"]), kurtosis_z(r["n"], r["kurt"])
    k2 = a * a + b * b
    return {"z_skew": a, "z_kurt": b, "k2": k2, "p": math.exp(-k2 / 2)}


def durbin_watson(df: DataFrame, residual: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by, dw): squared steps over squares, in the given order in each group. Groups sort on their own; by is needed."""
    step = F.col(residual) - F.lag(residual).over(Window.partitionBy(*by).orderBy(*order))
    return df.select(*by, residual, step.alias("step")).groupBy(*by).agg((F.sum(F.col("step") ** 2) / F.sum(F.col(residual) ** 2)).alias("dw"))


def runs(df: DataFrame, residual: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by, n_pos, n_neg, runs, z): Wald and Wolfowitz's test of the signs in order, zeros left out."""
    signs = df.where(F.col(residual) != 0).withColumn("up", F.col(residual) > 0)
    before = F.lag("up").over(Window.partitionBy(*by).orderBy(*order))
    s = signs.select(*by, "up", F.when(before.isNull() | (before != F.col("up")), 1).otherwise(0).alias("starts"))
    s = s.groupBy(*by).agg(F.count_if("up").alias("n_pos"), F.count_if(~F.col("up")).alias("n_neg"), F.sum("starts").alias("runs"))
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n2
    mean, var = 2 * n1 * n2 / n + 1, F.try_divide(2 * n1 * n2 * (2 * n1 * n2 - n), n * n * (n - 1))
    return s.withColumn("z", F.try_divide(F.col("runs") - mean, F.sqrt(var)))


def breusch_pagan(df: DataFrame, residual: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, lm): n R2 of the squared residuals on the regressors."""
    m = fit(df.withColumn("e2", F.col(residual) ** 2), xs, "e2", by)
    return m.select(*by, (F.col("n") * F.col("r_squared")).alias("lm"))


def _residuals(s, d) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "value", F.hour("ts").cast("double").alias("hour"))
    return e.withColumn("r", F.col("value") - mean_column(fit_one(e, ["hour"], "value"), ["hour"]))


def _q_shape(s, d):
    return shape(table(s, d, "events"), "value", ["event_type"]).select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("skew", "kurt", "jb", "jb_p")])


def _q_normal(s, d):
    t = normal_test(table(s, d, "customer"), "c_acctbal")
    return s.createDataFrame([(k, round(v, 6)) for k, v in t.items()], "name string, value double")


def _q_dw(s, d):
    return durbin_watson(_residuals(s, d), "r", ["user_id"], ["event_id"]).select("user_id", F.round("dw", 6).alias("dw"))


def _q_runs(s, d):
    return runs(_residuals(s, d), "r", ["user_id"], ["event_id"]).select("user_id", "n_pos", "n_neg", "runs", F.round("z", 6).alias("z"))


def _q_bp(s, d):
    return breusch_pagan(_residuals(s, d), "r", ["hour"], ["event_type"]).select("event_type", F.round("lm", 6).alias("lm"))


QUERIES = {"shape_jarque_bera": _q_shape, "normal_test": _q_normal, "durbin_watson": _q_dw, "runs_test": _q_runs, "breusch_pagan": _q_bp}
_R = "e AS (SELECT event_id, user_id, event_type, value, hour(ts)::DOUBLE AS h FROM events), m AS (SELECT regr_slope(value, h) AS b, regr_intercept(value, h) AS a FROM e), r AS (SELECT e.*, value - a - b * h AS r FROM e, m)"
SQL = {
    "normal_test": "WITH m AS (SELECT count(*)::DOUBLE AS n, avg(c_acctbal) AS m FROM customer), c AS (SELECT any_value(n) AS n, avg(pow(c_acctbal - m, 3)) / pow(avg(pow(c_acctbal - m, 2)), 1.5) AS g, avg(pow(c_acctbal - m, 4)) / pow(avg(pow(c_acctbal - m, 2)), 2) AS k FROM customer, m), s AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b, (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM c), w AS (SELECT *, sqrt(2 * (b - 1)) - 1 AS w2, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS a FROM s), z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS zs, ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM w) SELECT name, round(CASE name WHEN 'z_skew' THEN zs WHEN 'z_kurt' THEN zk WHEN 'k2' THEN zs * zs + zk * zk ELSE exp(-(zs * zs + zk * zk) / 2) END, 6) AS value FROM z, (VALUES ('z_skew'), ('z_kurt'), ('k2'), ('p')) v(name)",

    "shape_jarque_bera": "WITH m AS (SELECT event_type AS k, avg(value) AS mu FROM events GROUP BY 1), s AS (SELECT event_type, count(*) AS n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4 FROM events JOIN m ON event_type = k GROUP BY 1), z AS (SELECT event_type, n, m3 / pow(m2, 1.5) AS skew, m4 / m2 / m2 AS kurt FROM s), j AS (SELECT *, n / 6.0 * (skew * skew + (kurt - 3) * (kurt - 3) / 4) AS jb FROM z) SELECT event_type, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(jb, 6) AS jb, round(exp(-jb / 2), 6) AS jb_p FROM j",
    "durbin_watson": f"WITH {_R}, w AS (SELECT user_id, r, r - lag(r) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM r) SELECT user_id, round(sum(s * s) / sum(r * r), 6) AS dw FROM w GROUP BY 1",
    "runs_test": f"WITH {_R}, w AS (SELECT user_id, r > 0 AS up, lag(r > 0) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM r WHERE r <> 0), c AS (SELECT user_id, count(*) FILTER (up) AS n_pos, count(*) FILTER (NOT up) AS n_neg, sum((b IS NULL OR b <> up)::INT)::BIGINT AS runs FROM w GROUP BY 1), k AS (SELECT *, n_pos::DOUBLE * n_neg * 2 AS p, (n_pos + n_neg)::DOUBLE AS n FROM c) SELECT user_id, n_pos, n_neg, runs, round((runs - p / n - 1) / nullif(sqrt(CASE WHEN n > 1 THEN p * (p - n) / (n * n * (n - 1)) END), 0), 6) AS z FROM k",
    "breusch_pagan": f"WITH {_R} SELECT event_type, round(count(*) * regr_r2(r * r, h), 6) AS lm FROM r GROUP BY 1",
}
