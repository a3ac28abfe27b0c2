"""Energy of layered profiles against fine sums, and the temperatures that have it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.operators import layers
from gramlake.operators.mesh import heat_energy

CP = ((300.0, 1000.0), (800.0, 1500.0), (2000.0, 1800.0))


def energy(t):
    at = np.linspace(300.0, t, 20_001)
    return np.trapezoid(np.interp(at, [c[0] for c in CP], [c[1] for c in CP]), at)


def test_integral_and_inverse(spark):
    t = spark.createDataFrame([(float(x),) for x in (-50, 300, 301, 799, 800, 1234, 2000, 2600)], "t double")
    for r in t.select("t", heat_energy(F.col("t"), CP).alias("e"), layers.energy_integral(F.col("t"), CP).alias("h"), layers.energy_temperature(heat_energy(F.col("t"), CP), CP).alias("back")).collect():
        assert r.e == pytest.approx(energy(r.t), rel=1e-6) and r.back == pytest.approx(r.t)
        at = np.linspace(300.0, r.t, 2001)
        assert r.h == pytest.approx(np.trapezoid([energy(x) for x in at[::40]], at[::40]), rel=1e-3, abs=1e-6)


def test_cells_hold_the_stations_energy(spark):
    depth, temps = [0.1, 0.3, 0.7], {"a": [1900.0, 900.0, 350.0], "b": [700.0, 700.0, 700.0]}
    prof = spark.createDataFrame([(n, float(k), 0.0, t, z, v + 10 * t) for k, (n, vs) in enumerate(temps.items()) for t in (0.0, 2.0) for z, v in zip(depth, vs, strict=True)], "name string, x double, y double, t double, depth double, temperature double")
    cells = [(1, 0.0, 0.0, 0.0, 0.5, 0), (2, 0.0, 0.0, 0.5, 1.5, 0), (3, 0.25, 0.0, 0.2, 0.4, 0), (4, 0.0, 0.0, 0.3, 0.3, 0), (5, 0.0, 0.0, 0.1, 0.2, 9)]
    got = {r.cid: r for r in layers.layered_energy(spark.createDataFrame(cells, "cid long, x double, y double, z0 double, z1 double, layer int"), prof, {0: (250.0, CP)}, 1.0, k=2).collect()}

    def mean(n, z0, z1):
        z = np.linspace(z0, z1, 4001)
        return np.mean([energy(t) for t in np.interp((z[1:] + z[:-1]) / 2, depth, np.array(temps[n]) + 10)[10::20]])

    for k in (1, 2):
        assert got[k].energy == pytest.approx(250 * mean("a", *cells[k - 1][3:5]), rel=2e-3)
    w = np.array([1 / 0.25**2, 1 / 0.75**2])
    assert got[3].energy == pytest.approx(250 * (w @ [mean("a", 0.2, 0.4), mean("b", 0.2, 0.4)]) / w.sum(), rel=2e-3)
    assert energy(got[3].temperature) * 250 == pytest.approx(got[3].energy, rel=1e-6)
    whole, halves = got[1].energy * 0.5 + got[2].energy * 1.0, layers.layered_energy(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.5, 0)], "cid long, x double, y double, z0 double, z1 double, layer int"), prof, {0: (250.0, CP)}, 1.0, k=2).first().energy * 1.5
    assert whole == pytest.approx(halves)  # cells of any size keep the sum
    assert got[4].energy is None and got[5].energy is None and got[5].temperature is None
