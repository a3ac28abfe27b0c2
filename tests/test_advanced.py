import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramlake.operators import advanced, linear, sampling
from gramlake.operators.mesh import clip, moments


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 4))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.3 * r.normal(size=300)
    return frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], d=x[:, 3], y=y), x, y


def test_wide_and_narrow_moments_agree(table):
    df, x, y = table
    a, b = linear.full_moments(df, list("abcd"), "y"), linear.wide_moments(df, list("abcd"), "y")
    assert a["n"] == b["n"]
    np.testing.assert_allclose(a["cov"], b["cov"], rtol=1e-9, atol=1e-9)


def test_bayes_shrinks_and_prunes(table):
    df, x, y = table
    m = linear.full_moments(df, list("abcd"), "y")
    full, ard = advanced.bayes(m), advanced.bayes(m, ard=True)
    np.testing.assert_allclose(full["coef"], [1, 2, -1, 0, 0], atol=0.1)
    assert full["noise_precision"] == pytest.approx(1 / 0.09, rel=0.2)
    assert max(abs(v) for v in ard["coef"][3:]) <= max(abs(v) for v in full["coef"][3:])


def test_constraints(table):
    df, x, y = table
    m = linear.full_moments(df, list("abcd"), "y")
    c = advanced.constrained(m, [[0, 1, 1, 0, 0]], [0.0])["coef"]
    assert c[1] + c[2] == pytest.approx(0)
    w = advanced.nonnegative(m)
    assert min(w[1:]) >= 0 and w[2] == 0 and w[1] == pytest.approx(2, abs=0.2)
    assert advanced.least_angle_order(m)[:2] == [0, 1]


def test_nonlinear_recovers_its_parameters(spark):
    x = np.linspace(0, 5, 60)
    df = frame(spark, x=x, y=3 * np.exp(-x / 1.7) + 0.5)
    p = advanced.nonlinear(df, "a * exp(-x / b) + c", {"a": 1.0, "b": 1.0, "c": 0.0}, "y")["parameters"]
    assert [p["a"], p["b"], p["c"]] == pytest.approx([3, 1.7, 0.5], rel=1e-5)


def test_deming_equals_orthogonal_regression(spark):
    r = np.random.default_rng(1)
    t = r.normal(size=500)
    x, y = t + 0.1 * r.normal(size=500), 2 * t + 0.1 * r.normal(size=500)
    got = advanced.errors_in_variables(frame(spark, x=x, y=y), "x", "y").first()
    axis = np.linalg.svd(np.stack([x - x.mean(), y - y.mean()], 1), full_matrices=False)[2][0]
    assert got["slope"] == pytest.approx(axis[1] / axis[0], rel=1e-9)


def test_chaos_indices_of_a_polynomial_are_exact(spark):
    pts = sampling.halton(spark, 400, [(-1, 1), (-1, 1)])
    m = advanced.chaos(pts.withColumn("y", 3 * F.col("x0") + F.col("x0") * F.col("x1")), ["x0", "x1"], "y", [(-1, 1), (-1, 1)], 2)
    assert m["r_squared"] == pytest.approx(1)
    assert m["first"] == pytest.approx([3 / (3 + 1 / 9), 0], abs=1e-9) and m["total"] == pytest.approx([1, (1 / 9) / (3 + 1 / 9)], abs=1e-9)


def test_projection_meets_its_constraints(spark):
    x = frame(spark, i=[0, 1, 2], x=[1.0, 2.0, 3.0], w=[1.0, 2.0, 1.0])
    c = frame(spark, k=[0, 0, 0, 1], i=[0, 1, 2, 0], c=[1.0, 1.0, 1.0, 1.0])
    got = [r["x"] for r in advanced.project(x, c, frame(spark, k=[0, 1], d=[9.0, 2.0])).orderBy("i").collect()]
    assert sum(got) == pytest.approx(9) and got[0] == pytest.approx(2)
    assert (got[1] - 2) * 2 == pytest.approx(got[2] - 3)


def test_dimension_groups():
    g = advanced.pi_groups({"F": {"M": 1, "L": 1, "T": -2}, "rho": {"M": 1, "L": -3}, "v": {"L": 1, "T": -1}, "d": {"L": 1}, "mu": {"M": 1, "L": -1, "T": -1}})
    assert len(g) == 2 and all(isinstance(v.denominator, int) for x in g for v in x.values())


def test_quadrature():
    x, w = advanced.gauss_legendre(5)
    assert w @ x**8 == pytest.approx(2 / 9)
    p, w = advanced.triangle_rule(4)
    assert w.sum() == pytest.approx(0.5) and w @ (p[:, 0] ** 2 * p[:, 1]) == pytest.approx(2 / math.factorial(5))


def test_triangles_and_polygons(spark):
    a, b, c = (np.array([v], float) for v in ([0, 0, 0], [1, 0, 0], [0, 1, 0]))
    for p, d in (([0.2, 0.2, 3], 9), ([-1, 0.5, 0], 1), ([1, 1, 0], 0.5), ([2, 0, 0], 1)):
        assert advanced.point_triangles(np.array(p, float), a, b, c)[0] == pytest.approx(d)
    got = advanced.closest_on_triangles(spark.createDataFrame([(1, [0.2, 0.2, 3.0])], "qid long, p array<double>"), spark.createDataFrame([(5, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "tid long, a array<double>, b array<double>, c array<double>")).first()
    assert (got["tid"], got["distance"]) == (5, pytest.approx(3))
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    area, centre = moments(clip(square, square + 0.5))
    assert area == pytest.approx(0.25) and centre == pytest.approx([0.75, 0.75])
    assert moments(clip(square, square + 2))[0] == 0


def test_dense_models_fit_smooth_functions():
    x = np.linspace(0, 1, 40)[:, None]
    y = np.sin(6 * x[:, 0])
    w, loo = advanced.radial(x, y, "squared_exponential", 0.2, 1e-8)
    assert loo < 1e-2
    b, _ = advanced.support_vectors(x, y, 100.0, 0.01, 0.2)
    fit = (np.exp(-((x - x.T) ** 2) / 0.08) + 1) @ b
    assert np.abs(fit - y).max() < 0.03
    assert np.abs(advanced.network_value(advanced.network(x, y), x) - y).mean() < 0.1


def test_columns_are_mapped_by_tiers(spark):
    df = frame(spark, **{"Inlet-Temp": ["20", "x"], "MASS": [1.0, 2.0]})
    out, report = advanced.map_columns(df, {"inletTemp": {"type": "double", "unit": ("degC", "K")}, "mass": {}, "extra": {"required": False}})
    assert [r[2] for r in report] == ["normalised", "case", "missing"]
    assert [r["inletTemp"] for r in out.collect()] == [pytest.approx(293.15), None]
    with pytest.raises(KeyError):
        advanced.map_columns(df, {"nope": {}})
