import base64
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramlake.functions import scalars, special
from gramlake.operators import diagnostics, joins, linear, mesh, models, sampling, tables
from gramlake.plans.registry import json_able
from gramlake.plans.service import Service, expand, exponents
from gramlake.sources import formats
from gramlake.streaming import trace


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.fixture(scope="module")
def cubic():
    r = np.random.default_rng(1)
    x = np.sort(r.uniform(0, 2, 40))
    return x, 1 + 2 * x - x**2 + 0.5 * x**3 + 0.05 * r.normal(size=40), r.uniform(0.2, 5, 40)


# linear models against the normal equations


def test_inference_equals_normal_equations(spark, cubic):
    x, y, _ = cubic
    m = linear.fit_one(frame(spark, x=x, x2=x**2, x3=x**3, y=y), ["x", "x2", "x3"], "y")
    phi = np.stack([np.ones_like(x), x, x**2, x**3], 1)
    beta = np.linalg.solve(phi.T @ phi, phi.T @ y)
    r = y - phi @ beta
    s2 = r @ r / 36
    np.testing.assert_allclose(m["coef"], beta, rtol=1e-8)
    np.testing.assert_allclose(m["std_error"], np.sqrt(s2 * np.diag(np.linalg.inv(phi.T @ phi))), rtol=1e-8)
    assert m["r_squared"] == pytest.approx(1 - r @ r / ((y - y.mean()) ** 2).sum()) and m["r_squared"] > 0.99


def test_weighted_fit_and_missing_rows(spark, cubic):
    x, y, w = cubic
    df = frame(spark, x=np.append(x, [np.nan, 1]), y=np.append(y, [1, np.nan]), w=np.append(w, [1, 1]))
    m = linear.fit(df, ["x"], "y", weight="w").first()
    phi = np.stack([np.ones_like(x), x], 1)
    np.testing.assert_allclose(m["coef"], np.linalg.solve(phi.T * w @ phi, phi.T * w @ y), rtol=1e-9)
    assert m["n"] == 40


def test_a_collinear_term_gets_the_least_norm_share(spark, cubic):
    x, y, _ = cubic
    one, two = linear.fit_one(frame(spark, x=x, y=y), ["x"], "y"), linear.fit_one(frame(spark, x=x, z=3 * x, y=y), ["x", "z"], "y")
    assert two["sse"] == pytest.approx(one["sse"]) and two["aic"] == pytest.approx(one["aic"])


def test_diagnostics_find_the_outlier_and_loo_equals_refits(spark, cubic):
    x, y, _ = cubic
    y = y.copy()
    y[10] += 1.5
    df = frame(spark, i=np.arange(40), x=x, x2=x**2, y=y)
    d = linear.diagnosed(df, linear.fit_one(df, ["x", "x2"], "y"), ["x", "x2"], "y").toPandas().sort_values("i")
    assert list(np.flatnonzero(d["studentised"].abs() > 3)) == [10]
    k = np.arange(40) != 7
    phi = np.stack([np.ones_like(x), x, x**2], 1)
    beta = np.linalg.lstsq(phi[k], y[k], rcond=None)[0]
    assert d["loo_residual"].iloc[7] == pytest.approx(y[7] - phi[7] @ beta, rel=1e-7)
    assert d["leverage"].sum() == pytest.approx(3)


def test_folds_from_merged_moments_equal_refits(spark, cubic):
    x, y, _ = cubic
    got = {r["fold"]: r for r in linear.cross_validate(frame(spark, i=np.arange(40), x=x, y=y), ["x"], "y", (F.col("i") % 4).cast("int")).collect()}
    for k in range(4):
        out = np.arange(40) % 4 == k
        slope, at = np.polyfit(x[~out], y[~out], 1)
        np.testing.assert_allclose(got[k]["coef"], [at, slope], rtol=1e-9)
        assert got[k]["rmse"] == pytest.approx(np.sqrt(((y[out] - at - slope * x[out]) ** 2).mean()))


def test_intervals_cover(spark, cubic):
    x, y, _ = cubic
    df = frame(spark, x=x, x2=x**2, x3=x**3, y=y)
    p = linear.predict(df, linear.fit_one(df, ["x", "x2", "x3"], "y"), ["x", "x2", "x3"]).toPandas()
    assert ((p["y"] > p["lower"]) & (p["y"] < p["upper"])).mean() > 0.85


def test_selection(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4))
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], d=x[:, 3], y=2 * x[:, 0] - 3 * x[:, 2] + 0.1 * r.normal(size=400))
    m = linear.full_moments(df, list("abcd"), "y")
    assert linear.stepwise(m, list("abcd")) == ["a", "c"]
    b = linear.elastic_net(m, 0.2, 1.0)
    assert abs(b[2]) < 1e-12 and abs(b[4]) < 1e-12 and 1.7 < b[1] < 1.9
    assert all(1 <= v < 1.1 for v in linear.variance_inflation(m, list("abcd")).values())


def test_groups_equal_filters_whatever_the_partitions(spark, cubic):
    x, y, _ = cubic
    df = frame(spark, g=np.arange(40) % 3, x=x, y=y)
    for n in (1, 7):
        for r in linear.fit(df.repartition(n), ["x"], "y", ["g"]).collect():
            np.testing.assert_allclose(r["coef"], linear.fit_one(df.where(F.col("g") == r["g"]), ["x"], "y")["coef"], rtol=1e-10)


# other models


def test_glm_solves_the_score_equations(spark):
    r = np.random.default_rng(5)
    x = r.uniform(-1, 1, 500)
    y = r.poisson(np.exp(0.3 + 0.8 * x)).astype(float)
    m = models.glm(frame(spark, x=x, y=y), ["x"], "y", "poisson")
    mu = np.exp(m["coef"][0] + m["coef"][1] * x)
    assert abs((y - mu).sum()) < 1e-5 and abs((x * (y - mu)).sum()) < 1e-5
    z = (r.uniform(size=500) < 1 / (1 + np.exp(-1 - 2 * x))).astype(float)
    m = models.glm(frame(spark, x=x, y=z), ["x"], "y", "binomial")
    assert abs((z - 1 / (1 + np.exp(-m["coef"][0] - m["coef"][1] * x))).sum()) < 1e-5


def test_robust_and_quantile_ignore_outliers(spark):
    x = np.arange(100.0)
    y = 3 + 2 * x + np.random.default_rng(2).normal(size=100)
    y[:8] += 500
    df = frame(spark, x=x, y=y)
    for kind in ("huber", "bisquare", "cauchy"):
        assert models.robust(df, ["x"], "y", kind)["coef"][1] == pytest.approx(2, abs=0.15 if kind == "huber" else 0.02)
    q = models.quantile_line(df, "x", "y", 0.5)
    assert q["coef"][1] == pytest.approx(2, abs=0.05) and (y < q["coef"][0] + q["coef"][1] * x).mean() == pytest.approx(0.5, abs=0.03)


def test_order_fits(spark):
    np.testing.assert_allclose(models.pava([1, 3, 2, 4, 3.5, 5], [1] * 6), [1, 2.5, 2.5, 3.75, 3.75, 5])
    np.testing.assert_allclose(models.pava([3, 1], [1, 3]), [1.5, 1.5])


def test_splines_are_exact_where_they_must_be():
    x = np.array([0.0, 1.0, 2.5, 4.0, 4.5])
    f = lambda t: 1 + t - t**2 + 0.3 * t**3
    np.testing.assert_allclose(models.cubic_value(x, f(x), np.linspace(0, 4.5, 20)), f(np.linspace(0, 4.5, 20)), rtol=1e-9)
    b = models.b_spline(np.linspace(0, 1, 30), 0, 1, 6)
    np.testing.assert_allclose(b.sum(1), 1)
    coef, edf = models.p_spline(np.linspace(0, 1, 30), 2 * np.linspace(0, 1, 30), 0, 1, 6, 1e6)
    np.testing.assert_allclose(b @ coef, 2 * np.linspace(0, 1, 30), atol=1e-4)
    assert edf == pytest.approx(2, abs=0.01)


def test_kriging_interpolates_and_variogram_fit_recovers(spark):
    p = frame(spark, g=[0] * 6, x=[0.0, 1.0, 2.0, 3.0, 4.0, 5.0], y=[0.0, 1.0, 0.5, 2.0, 1.0, 0.0])
    q = frame(spark, g=[0, 0], qid=[0, 1], x=[3.0, 2.5])
    got = {r["qid"]: r for r in models.kriging(p, q, "g", ["x"], "y", "matern52", 1e-9).collect()}
    assert got[0]["mean"] == pytest.approx(2, abs=1e-4) and got[0]["variance"] < 1e-4 < got[1]["variance"]
    h = np.linspace(0.05, 2, 25)
    fit = models.fit_variogram([(d, 0.1 + 0.9 * (1 - math.exp(-d / 0.6)), 50) for d in h])
    assert fit["range"] == pytest.approx(0.6, rel=0.02) and fit["nugget"] == pytest.approx(0.1, abs=0.01)
    assert models.practical_range("exponential", 1.0) == pytest.approx(-math.log(0.05), rel=1e-6)


def test_kmeans_finds_separate_groups(spark):
    r = np.random.default_rng(0)
    c = np.repeat([[0, 0], [10, 0], [0, 10]], 50, axis=0) + r.normal(size=(150, 2)) * 0.2
    centres, near = models.kmeans(frame(spark, x=c[:, 0], y=c[:, 1]), ["x", "y"], 3)
    assert sorted(np.round(centres).tolist()) == [[0, 0], [0, 10], [10, 0]]


# functions


def test_special_functions_have_their_closed_forms():
    assert special.betainc(1, 1, 0.3) == pytest.approx(0.3) and special.betainc(2, 1, 0.3) == pytest.approx(0.09)
    for x in (0.1, 1.0, 5.0, 40.0):
        assert special.gammainc(1, x) == pytest.approx(1 - math.exp(-x), rel=1e-12)
        assert special.gammainc(0.5, x) == pytest.approx(math.erf(math.sqrt(x)), rel=1e-10)
        assert special.bessel_k(0.5, x) == pytest.approx(math.sqrt(math.pi / 2 / x) * math.exp(-x), rel=1e-8)
    assert special.digamma(1) == pytest.approx(-0.5772156649015329) and special.trigamma(1) == pytest.approx(math.pi**2 / 6)
    assert special.student_t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert special.student_t_cdf(1, 1) == pytest.approx(0.75) and special.f_cdf(1, 5, 5) == pytest.approx(0.5)
    assert special.chi2_cdf(2, 2) == pytest.approx(1 - math.exp(-1)) and special.normal_ppf(0.975) == pytest.approx(1.959963984540054)


def test_transforms_invert(spark):
    df = frame(spark, y=[0.5, 1.0, 7.0])
    for lam in (0, 0.5, -1):
        back = df.select(special.box_cox_inverse(special.box_cox(F.col("y"), lam), lam).alias("b"), "y").collect()
        assert all(r["b"] == pytest.approx(r["y"]) for r in back)
    for lam in (0, 0.5, 2):
        back = df.select((F.col("y") - 2).alias("y")).select(special.yeo_johnson_inverse(special.yeo_johnson(F.col("y"), lam), lam).alias("b"), "y").collect()
        assert all(r["b"] == pytest.approx(r["y"]) for r in back)


def test_dates_units_and_formulas(spark):
    one = spark.sql("SELECT timestamp_ntz '2000-01-01 12:00:00' AS t, 'a' AS s")
    assert one.select(scalars.julian_date(F.col("t"))).first()[0] == 2451545.0
    assert one.select(scalars.parse_time(F.lit("2000_01_01_12_00_00")) == F.col("t").cast("timestamp")).first()[0]
    assert spark.range(1).select(scalars.convert(F.lit(100.0), "degC", "degF")).first()[0] == pytest.approx(212)
    with pytest.raises(ValueError):
        scalars.convert(F.lit(1.0), "m", "kg")
    assert spark.range(1).select(scalars.formula("2 ** 3 + minimum(1, x)", x=F.lit(5))).first()[0] == 9
    for bad in ("__import__('os')", "x.y", "open(1)", "lambda: 1", "'a'"):
        with pytest.raises(ValueError):
            scalars.formula(bad, x=F.lit(1))
    got = spark.createDataFrame([('see {"a": {"b": "}{"}} end',), ("none {x",), ("",), (None,)], "t string").select(scalars.extract_json(F.col("t"))).collect()
    assert [r[0] for r in got] == ['{"a": {"b": "}{"}}', None, None, None]


# tables and joins


def test_table_rules(spark):
    df = frame(spark, **{"p[MPa]": [1.0, 2.0], "name": ["a", "b"]})
    u = tables.with_units(df)
    assert u.columns == ["p", "name"] and tables.headers(u) == ["p[MPa]", "name"]
    with pytest.raises(KeyError):
        tables.named(df, ["nope"])
    assert tables.size_class(0, 3) == "empty" and tables.size_class(30, 8) == "small" and tables.size_class(31, 8) == "medium" and tables.size_class(201, 2) == "large"
    text = tables.markdown(spark.range(30).select("id", (F.col("id") / 3).alias("x")), 6)
    assert "| ... |" in text and "30 rows x 2 columns" in text
    key = spark.createDataFrame([("a10",), ("a9",), ("A2b",)], "s string").orderBy(tables.natural_key(F.col("s"))).collect()
    assert [r[0] for r in key] == ["A2b", "a9", "a10"]


def test_variogram_of_a_plane_has_its_direction(spark):
    g = [(6 * i + j, float(i), float(j), 2.0 * i) for i in range(6) for j in range(6)]
    p = spark.createDataFrame(g, "pid long, x double, y double, v double")
    along = joins.variogram(p, ["x", "y"], "v", [0.5, 1.2], direction=[1, 0], tolerance=10).first()
    across = joins.variogram(p, ["x", "y"], "v", [0.5, 1.2], direction=[0, 1], tolerance=10).first()
    assert (along["gamma"], along["pairs"]) == (2.0, 30) and (across["gamma"], across["pairs"]) == (0.0, 30)


def test_as_of_clamps_and_interpolates(spark):
    s = frame(spark, g=[1, 1], t=[0.0, 2.0], v=[300.0, 500.0])
    q = frame(spark, g=[1, 1, 1, 2], t=[0.5, 5.0, -1.0, 0.0], qid=[1, 2, 3, 4])
    assert {r["qid"]: r["estimate"] for r in joins.as_of(s, q, ["g"], "t", "v").collect()} == {1: 350.0, 2: 500.0, 3: 300.0, 4: None}


# sampling and meshes


def test_designs(spark):
    assert sampling.latin_hypercube(spark, 97, [(0, 1)]).select(F.floor(F.col("x0") * 97)).distinct().count() == 97
    s = {r["input"]: r for r in sampling.sobol_indices(spark, "ishigami", 20000).collect()}
    ref = sampling.ishigami_sobol()
    for k in range(3):
        assert s[k]["first"] == pytest.approx(ref["first"][k], abs=0.05) and s[k]["total"] == pytest.approx(ref["total"][k], abs=0.05)
    b = spark.range(1).select(sampling.problem("branin", F.lit(math.pi), F.lit(2.275))).first()[0]
    assert b == pytest.approx(0.397887, abs=1e-5)


def test_transfer_conserves_heat_of_each_sign(spark):
    p, c = mesh.plane_mesh(spark, 6, 5)
    q, t = mesh.plane_mesh(spark, 4, 3)
    src = mesh.with_corners(c, p).withColumn("q", F.when(F.col("cid") % 2 == 0, 1.5).otherwise(-0.5))
    got = mesh.transfer(src, mesh.with_corners(t, q), 0.3).agg(F.sum("plus"), F.sum("minus"), F.sum("missed")).first()
    assert got[0] == pytest.approx(0.75) and got[1] == pytest.approx(-0.25) and got[2] == 0


# sources, service, streams


def test_files_round_trip(spark, tmp_path):
    text = "# comment\nx;y;w\n1;2;1\nx;1;2\n3;4;5\n"
    (tmp_path / "t.csv").write_text(text)
    kept, counts = formats.load_table(spark, str(tmp_path / "t.csv"), ["x"], ["y"], "w")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 2, 1), (3, 4, 5)] and tuple(counts.first()) == (2, 1)
    assert formats.has_rows(spark, str(tmp_path / "t.csv"))
    value = {"solver": {"cfl": 0.8, "steps": 100, "on": True}, "names": ["a", "b"], "rows": [{"k": 1}, {"k": 2}]}
    for kind in ("json", "toml", "yaml"):
        formats.write_config(value, str(tmp_path / f"c.{kind}"))
        assert formats.read_config(str(tmp_path / f"c.{kind}")) == value
    formats.write_config({"a": {"@id": "7", "b": ["1", "2"]}}, str(tmp_path / "c.xml"))
    assert formats.read_config(str(tmp_path / "c.xml")) == {"a": {"@id": "7", "b": ["1", "2"]}}
    assert formats.flattened(value["solver"] and {"solver": value["solver"]}) == {"solver.cfl": 0.8, "solver.steps": 100, "solver.on": True}
    assert formats.nested({"a.b": 1, "a.c": 2}) == {"a": {"b": 1, "c": 2}}
    paths = formats.input_files({"solver": {"cfl": 1.0}}, spark.createDataFrame([(0.5,), (0.6,)], "`solver.cfl` double"), str(tmp_path))
    assert formats.read_config(paths[1]) == {"solver": {"cfl": 0.6}}
    assert formats.from_base64(spark, "data:text/csv;base64," + base64.b64encode(b"a,b\n1,2\n").decode()).first()["b"] == "2"
    with pytest.raises(ValueError):
        formats.read_config(str(tmp_path / "t.csv"))


def test_mesh_files(spark, tmp_path):
    pts = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0.5]])
    grid = {"points": pts, "connectivity": [0, 1, 2, 0, 2, 3], "offsets": [3, 6], "types": [5, 5], "cell_data": {"q": np.array([1.0, 2.0])}, "point_data": {}}
    data = formats.format_vtu(grid)
    (tmp_path / "a.vtu").write_bytes(data)
    back = formats.parse_vtu(data)
    np.testing.assert_allclose(back["points"], pts)
    assert back["connectivity"].tolist() == [0, 1, 2, 0, 2, 3] and back["cell_data"]["q"].tolist() == [1, 2]
    points, cells = formats.read_meshes(spark, str(tmp_path / "a.vtu"))
    assert points.count() == 4 and [list(r["nodes"]) for r in cells.orderBy("cid").collect()] == [[0, 1, 2], [0, 2, 3]]
    formats.write_series([(0.0, "a.vtu"), (0.5, "b.vtu")], str(tmp_path / "s.pvd"))
    assert [(r["time"], r["file"]) for r in formats.read_series(spark, str(tmp_path / "s.pvd")).orderBy("time").collect()] == [(0.0, "a.vtu"), (0.5, "b.vtu")]


def test_stations(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"stations": [{"name": "a", "position": [0, 0, 0], "time": [0, 1], "depth": [0, 0.5], "temperature": [[300, 310], [320, 330]]}]}))
    got = formats.load_stations(spark, str(tmp_path / "s.json")).orderBy("t", "depth").collect()
    assert [(r["t"], r["depth"], r["temperature"]) for r in got] == [(0, 0, 300), (0, 0.5, 310), (1, 0, 320), (1, 0.5, 330)]
    (tmp_path / "p.csv").write_text("time,0.0,0.5\n0,300,310\n1,320,330\n")
    assert formats.read_profiles(spark, str(tmp_path / "p.csv")).agg(F.sum("value")).first()[0] == 1260


def test_service(spark, tmp_path, cubic):
    x, y, _ = cubic
    e = Service(spark)
    assert "fitModel" not in e.applicable()
    e.invoke("setData", df=frame(spark, x=x, y=y), inputs=["x"], outputs=["y"])
    rows = e.invoke("compareModels", candidates=["linear", "quadratic", "poly3"], modelName="best")
    assert rows[0]["model"] == "poly3" and e.invoke("getModelSummary", modelName="best")["r_squared"] > 0.99
    e.invoke("saveModel", modelName="best", path=str(tmp_path / "m.json"))
    e.invoke("loadModel", modelName="again", path=str(tmp_path / "m.json"))
    at = frame(spark, x=[0.5, 1.5])
    a, b = (e.invoke("predict", modelName=m, df=at, interval="prediction").orderBy("x").collect() for m in ("best", "again"))
    assert a == b
    assert e.invoke("crossValidateModel", modelName="best").count() == 5 and e.invoke("diagnoseModel", modelName="best")["max_leverage"] < 1
    with pytest.raises(KeyError):
        e.invoke("predict", modelName="nope", df=at)
    assert [ok for _, ok in ((r["k"], r["ok"]) for r in e.trace().orderBy("k").collect())].count(False) == 1
    got = e.sweep("fitModel", [{"modelName": "p", "model": "poly2"}, {"modelName": "q", "model": "bad"}])
    assert got[0][1] is None and "ValueError" in got[1][1]
    assert expand("ridge-poly3") == {"degree": 3, "solver": "ridge"} and len(exponents(2, 2)) == 5
    assert json_able([math.nan, math.inf, {"a": -math.inf}]) == [None, "inf", {"a": "-inf"}]
    assert e.catalogue().count() >= 15


def test_stream_of_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", float(m), 1 + 2.0 * m) for m in range(20)]
    spark.createDataFrame(rows, "ts string, x double, y double").select(F.col("ts").cast("timestamp").alias("ts"), "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x double, y double").parquet(str(tmp_path / "in"))
    q = trace.windowed_fit(stream, "ts", "x", "y", "10 minutes", "1 minute").writeStream.format("memory").queryName("fits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("fits").collect()
    assert len(got) == 2 and all(r["slope"] == pytest.approx(2) and r["n"] == 10 for r in got)


def test_normality_statistics():
    # symmetric, mesokurtic values: both z near zero
    assert abs(diagnostics.skew_z(100, 0.0)) < 1e-12 and abs(diagnostics.kurtosis_z(200, 3 * 199 / 201)) < 0.5
    assert math.isnan(diagnostics.skew_z(7, 0.1)) and math.isnan(diagnostics.kurtosis_z(4, 3))


def test_latin_hypercube_fills_every_stratum_just_above_a_power_of_four(spark):
    for n in (1, 2, 5, 1025, 65537):
        for axis in ("x0", "x1"):
            got = sampling.latin_hypercube(spark, n, [(0, 1), (0, 1)], 5, centre=True).select(F.floor(F.col(axis) * n).alias("k"))
            assert got.where(f"k >= 0 AND k < {n}").distinct().count() == n


def test_nearest_does_not_depend_on_the_number_of_points(spark, monkeypatch):
    r = np.random.default_rng(3)
    points = frame(spark, pid=np.arange(400), x=r.uniform(0, 1, 400), y=r.uniform(0, 2, 400))
    at = np.array([(0.5, 0.5), (0.99, 1.99), (1.5, 1.0), (-2.5, 1.0), (9.0, -7.0), (0.5, 40.0), (-1e6, 3.0)])
    asked = frame(spark, qid=np.arange(len(at)), x=at[:, 0], y=at[:, 1])
    rows = lambda k: sorted((q.qid, q["rank"], q.pid, round(q.distance, 6)) for q in joins.nearest(asked, points, ["x", "y"], k).collect())
    want = {k: rows(k) for k in (5, 500)}
    monkeypatch.setattr(joins, "BROADCAST_POINTS", 10)
    assert len(want[5]) == 5 * len(at) and {k: rows(k) for k in (5, 500)} == want
