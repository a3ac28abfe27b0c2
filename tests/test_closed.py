"""Operators without SQL, against plain numpy or closed forms on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.functions import numerics
from gramlake.operators import additive, advanced, linear, models, sampling, spatial, tables
from gramlake.plans.service import Service


@pytest.fixture(scope="module")
def line(spark):
    r = np.random.default_rng(0)
    x = r.random((300, 2)) * 3
    y = 1 + 2 * x[:, 0] - x[:, 1] + r.standard_t(3, 300) * 0.3
    df = spark.createDataFrame([(k, *map(float, a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    return df, x, y


def test_exact_percentiles_by_bracketing(spark, monkeypatch):
    r = np.random.default_rng(1)
    for v in (r.normal(size=3000), np.round(r.normal(size=3000)), np.repeat([1.0, 2.0], [2900, 100])):
        df = spark.createDataFrame([(float(x),) for x in v], "v double").unionByName(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
        monkeypatch.setattr(tables, "SELECT_ROWS", 40)
        got = tables.percentiles(df, F.col("v"), [0.0, 0.1, 0.5, 0.97, 1.0])
        assert np.allclose(got, np.quantile(v, [0.0, 0.1, 0.5, 0.97, 1.0]))
    assert np.isnan(tables.percentiles(df.where("false"), F.col("v"), [0.5])[0])


def test_robust_is_its_fixed_point(line):
    df, x, y = line
    m = models.robust(df, ["a", "b"], "y", "huber")
    a = np.hstack([np.ones((300, 1)), x])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(100):
        r = y - a @ b
        s = 1.4826 * np.median(np.abs(r - np.median(r)))
        w = np.minimum(1, 1.345 / np.maximum(np.abs(r / s), 1e-12))
        b = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))
    assert np.allclose(m["coef"], b, atol=1e-4)


def test_quantiles_agree_with_the_exact_fit(line):
    df, x, y = line
    m = additive.quantile_fit(df, ["a", "b"], "y", 0.7)
    exact = additive.quantile_exact(x, y, 0.7)
    loss = lambda b: (lambda r: (r * (0.7 - (r < 0))).sum())(y - np.hstack([np.ones((300, 1)), x]) @ b)
    assert abs(loss(np.array(m["coef"])) / loss(exact) - 1) < 1e-4 and m["r1"] > 0.4
    r = np.random.default_rng(2)
    assert all(loss(exact) <= loss(exact + r.normal(size=3) * s) + 1e-9 for s in (1e-4, 1e-2, 0.3) for _ in range(50))
    one = additive.quantile_fit(df, ["a"], "y", 0.25)
    old = models.quantile_line(df, "a", "y", 0.25)
    assert np.allclose(one["coef"], old["coef"], atol=0.02)


def test_nonnegative_is_the_program_of_its_moments(line):
    df, x, y = line
    m = linear.full_moments(df, ["a", "b"], "y")
    got = advanced.nonnegative(m)
    c = np.asarray(m["cov"])
    slope = numerics.bounded_qp(c[:2, :2], -c[:2, 2], np.zeros(2))
    assert np.allclose(got[1:], slope, atol=1e-8)


def test_transformation_has_the_best_likelihood(spark):
    r = np.random.default_rng(3)
    x = r.random(400) * 2
    y = (1 + 0.5 * (0.3 + x + 0.1 * r.normal(size=400))) ** 2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    got = advanced.transformed(df, ["x"], "y")["lambda"]

    def score(lam):
        z = np.log(y) if lam == 0 else (y**lam - 1) / lam
        e = z - np.polyval(np.polyfit(x, z, 1), x)
        return -200 * np.log((e**2).mean()) + (lam - 1) * np.log(y).sum()

    assert score(got) >= max(score(v) for v in np.linspace(-1, 2, 301)) - 1e-3


def test_intercepts_agree_with_the_slopes_model(spark):
    r = np.random.default_rng(4)
    g = np.repeat(np.arange(12), 20)
    x = r.random(240)
    u = r.normal(size=(12, 2)) * [0.8, 0.5]
    y = 1 + u[g, 0] + (2 + u[g, 1]) * x + 0.2 * r.normal(size=240)
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in zip(g, x, y, strict=True)], "g int, x double, y double")
    a, b = models.mixed_intercepts(df, "g", "x", "y"), additive.mixed_fit(df, "g", ["x"], "y")
    assert np.allclose(a["coef"], b["coef"], atol=2e-2)
    m = additive.mixed_fit(df, "g", ["x"], "y", ["x"])
    assert m["reml"] > b["reml"] and 0.02 < m["residual_variance"] < 0.06 and np.linalg.eigvalsh(m["random_covariance"]).min() > -1e-9
    effects = {r_["g"]: r_["effects"] for r_ in m["random_effects"].collect()}
    assert len(effects) == 12 and np.corrcoef([effects[k][0] for k in range(12)], u[:, 0])[0, 1] > 0.9


def test_additive_models(spark):
    r = np.random.default_rng(5)
    x, z = r.random(600) * 6, r.random(600)
    level = r.integers(0, 3, 600)
    eta = np.sin(x) + 0.5 * z + np.array([0.0, 0.4, -0.3])[level]
    df = spark.createDataFrame([(float(a), float(b), int(c), float(e + 0.1 * n), float(p), float(q)) for a, b, c, e, n, p, q in zip(x, z, level, eta, r.normal(size=600), r.poisson(np.exp(eta)), r.random(600) < 1 / (1 + np.exp(-2 * eta)), strict=True)], "x double, z double, f int, y double, n double, q double")
    terms = [{"x": "x", "kind": "spline"}, {"x": "z", "kind": "linear"}, {"x": "f", "kind": "factor"}]
    m = additive.gam_fit(df, terms, "y")
    got = np.array([row["mean"] for row in additive.gam_predict(m, df).collect()])
    assert np.sqrt(np.mean((got - eta) ** 2)) < 0.05 and {t["term"] for t in additive.gam_terms(m)} == {"x", "z", "f"} and additive.gam_summary(m)["criterion"] == "GCV"
    for family, y, truth in (("poisson", "n", np.exp(eta)), ("binomial", "q", 1 / (1 + np.exp(-2 * eta)))):
        m = additive.gam_fit(df, terms, y, family)
        got = np.array([row["mean"] for row in additive.gam_predict(m, df).collect()])
        assert np.corrcoef(got, truth)[0, 1] > 0.93 and m["criterion"] == "UBRE"


def test_links_and_families(spark):
    r = np.random.default_rng(6)
    x = r.random(500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, r.gamma(5, np.exp(0.3 + x) / 5), strict=True)], "x double, y double")
    for family in ("gamma", "gaussian", "inverse_gaussian"):
        m = additive.glm_full(df, ["x"], "y", family)
        assert m["aic"] < m["bic"] and 0 < m["deviance_explained"] < 1 and np.isfinite(m["loglik"])
        total = df.agg(F.sum(additive.glm_residual(m, "deviance") ** 2)).first()[0]
        assert abs(total - m["deviance"]) < 1e-6 * max(1, m["deviance"])
    inverse, slope, link = additive.power_link(0.5)
    row = df.select(F.lit(4.0).alias("m")).select(inverse(link(F.col("m"))).alias("back"), slope(F.col("m")).alias("d")).first()
    assert row["back"] == pytest.approx(4.0) and row["d"] == pytest.approx(0.25)
    row = df.limit(1).select(additive.PROBIT[0](additive.PROBIT[2](F.lit(0.3))).alias("back"), additive.PROBIT[1](F.lit(0.5)).alias("d")).first()
    assert row["back"] == pytest.approx(0.3) and row["d"] == pytest.approx(np.sqrt(2 * np.pi))


def test_kernels_are_positive(spark):
    r = np.random.default_rng(7)
    x = r.random((25, 2))
    base = {"name": "matern52", "length": 0.4}
    specs = [{"name": "matern", "nu": 1.2, "length": 0.3}, {"name": "power_exponential", "power": 1.4}, {"name": "periodic", "period": 0.7}, {"name": "gneiting"}, {"name": "sum", "parts": [base, {"name": "exponential"}]}, {"name": "product", "parts": [base, base]}, {"name": "warped", "base": base, "warp": np.sqrt}, {"name": "nonstationary", "base": {"name": "squared_exponential"}, "length": lambda v: 0.2 + v[:, 0]}]
    for s in specs:
        k = spatial.build_kernel(s)(x, x)
        assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1, atol=1e-6) and np.linalg.eigvalsh(k).min() > -1e-8, s["name"]
    assert np.allclose(spatial.build_kernel({"name": "matern", "nu": 2.5, "length": 0.4})(x, x), spatial.build_kernel(base)(x, x), atol=1e-8)
    assert spatial.weighted_sq_dist(x, x, np.array([1.0, -1.0])).min() < 0 and np.allclose(spatial.pairwise_distances(x, x)[0, 1], np.linalg.norm(x[0] - x[1]))
    order = spatial.maxmin_order(x)
    assert sorted(order) == list(range(25)) and len(spatial.previous_neighbors(x[order], 4)[10]) == 4


def test_neighbor_likelihood_finds_the_length(spark):
    r = np.random.default_rng(8)
    x = r.random((400, 2))
    k = np.exp(-spatial.pairwise_distances(x, x) / 0.2) + 1e-8 * np.eye(400)
    y = np.linalg.cholesky(k) @ r.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    m = spatial.vecchia_fit(df, "id", ["a", "b"], "y", 8, nugget=1e-8)
    assert 0.08 < m["length"] < 0.5
    full = [spatial._criterion(spatial._state(x, y, spatial.build_kernel({"name": "exponential", "length": v}), 1e-8, np.ones((400, 1))), "ml") for v in (0.04, 0.2, 1.5)]
    sets = [r_ for r_ in spatial.neighbor_sets(df, "id", ["a", "b"], 8).collect()]
    assert full[1] == min(full) and len(sets) == 400


def test_sensitivity_and_centres(spark):
    exact = sampling.ishigami_sobol()
    got = sampling.sobol_indices(spark, "ishigami", 20_000).collect()
    assert len(got) == 3 and set(exact) >= {"first", "total"}
    df = spark.createDataFrame([(float(k % 3) * 5 + (k % 7) * 0.01, float(k % 3)) for k in range(300)], "a double, b double")
    centres, _ = models.kmeans(df, ["a", "b"], 3)
    assert sorted(np.round(c[0]) for c in centres) == [0, 5, 10]


def test_catalogue_names_every_command(spark):
    names = [r["name"] for r in Service(spark).catalogue().collect()]
    assert len(names) == len(set(names)) and {"setData", "fitModel", "predict", "compareModels"} <= set(names)


def test_isotonic_pools_across_ranges(spark):
    r = np.random.default_rng(9)
    for y in (np.sort(r.normal(size=300)) + 0.3 * r.normal(size=300), -np.arange(300.0), np.arange(300.0), np.sin(np.arange(300) / 20) + np.arange(300) / 200):
        x = r.permutation(300)
        df = spark.createDataFrame([(float(k), float(y[k])) for k in x], "x double, y double")
        got = [row["fitted"] for row in models.isotonic(df, "x", "y").orderBy("x").collect()]
        assert np.allclose(got, models.pava(y, np.ones(300)))
    assert models.isotonic(df.where("false"), "x", "y").count() == 0


def test_columns_map_by_likeness(spark):
    df = spark.createDataFrame([(1.0, "2")], "inlet_temprature double, Flow string")
    rules = {"inlet_temperature": {"type": "double", "unit": None, "required": False}, "flow": {"type": "double"}}
    assert advanced.rules_of(advanced.rules_text(rules)) == rules
    out, report = advanced.map_columns(df, rules, fuzzy=85)
    assert {(r[0], r[1], r[2]) for r in report} == {("inlet_temperature", "inlet_temprature", "fuzzy"), ("flow", "Flow", "case")} and out.first()["flow"] == 2.0
    assert "inlet_temprature" not in [r[1] for r in advanced.map_columns(df, rules)[1]]


def test_hartmann_optimum(spark):
    best = [0.20169, 0.150011, 0.476874, 0.275332, 0.311652, 0.6573]
    assert spark.range(1).select(sampling.problem("hartmann6", *map(F.lit, best)).alias("v")).first()["v"] == pytest.approx(-3.32237, abs=1e-4)
