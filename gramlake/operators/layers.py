"""Station profiles mapped to the cells of layered solids so that energy is kept.

A station's temperature is linear between its depths; a material's heat capacity is linear in temperature, so its energy is
piecewise quadratic and the integral of the energy piecewise cubic. Over a stretch in which the temperature is linear the
mean energy is a difference quotient of that integral: no quadrature, and the fold over a station's sorted depths is one
Column expression. A cell takes the blend of its stations' mean energies over its own depths, and the temperature whose
energy that is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.joins import nearest
from gramlake.operators.mesh import heat_energy
from gramlake.session import table

Capacity = Sequence[tuple[float, float]]
#: Temperatures closer than this count as equal in a stretch.
EQUAL = 1e-4


def stations_at(profiles: DataFrame, t: float) -> DataFrame:
    """(name, x, y, at array<struct<depth, v>>): profiles (name, x, y, t, depth, temperature) at a time, linear in time and
    clamped at its ends, sorted by depth."""
    w = Window.partitionBy("name", "depth").orderBy("t")
    p = profiles.withColumn("t1", F.lead("t").over(w)).withColumn("v1", F.lead("temperature").over(w)).withColumn("first", F.row_number().over(w) == 1)
    inside = (F.col("t") <= t) & (F.col("t1") > t)
    p = p.where(inside | (F.col("t1").isNull() & (F.col("t") <= t)) | (F.col("first") & (F.col("t") > t)))
    value = F.when(inside, F.col("temperature") + (F.lit(t) - F.col("t")) / (F.col("t1") - F.col("t")) * (F.col("v1") - F.col("temperature"))).otherwise(F.col("temperature"))
    return p.select("name", "x", "y", "depth", value.alias("v")).groupBy("name", "x", "y").agg(F.array_sort(F.collect_list(F.struct("depth", "v"))).alias("at"))


def energy_integral(t: Column, cp: Capacity) -> Column:
    """The integral of `heat_energy` over temperature, from the table's first."""
    t0, c0 = cp[0]
    below, out = F.least(t - t0, F.lit(0.0)), F.lit(0.0)
    out = below * below * (c0 / 2)
    held = 0.0  # energy at the piece's lower end
    for (ta, ca), (tb, cb) in zip(cp, cp[1:], strict=False):
        u, slope = F.least(F.greatest(t - ta, F.lit(0.0)), F.lit(float(tb - ta))), (cb - ca) / (tb - ta)
        out = out + u * (held + u * (ca / 2 + u * (slope / 6)))
        held += (tb - ta) * (ca + cb) / 2
    above = F.greatest(t - cp[-1][0], F.lit(0.0))
    return out + above * (held + above * (cp[-1][1] / 2))


def energy_temperature(e: Column, cp: Capacity) -> Column:
    """The temperature whose `heat_energy` is e, in closed form."""
    t0, c0 = cp[0]
    pieces, held = [], 0.0
    for (ta, ca), (tb, cb) in zip(cp, cp[1:], strict=False):
        slope, more = (cb - ca) / (tb - ta), (tb - ta) * (ca + cb) / 2
        rest = e - held
        root = F.sqrt(F.greatest(F.lit(float(ca * ca)) + rest * (2 * slope), F.lit(0.0)))
        pieces.append((held + more, F.lit(float(ta)) + 2 * rest / (ca + root)))
        held += more
    out = F.lit(float(cp[-1][0])) + (e - held) / cp[-1][1]
    for top, value in reversed(pieces):
        out = F.when(e <= top, value).otherwise(out)
    return F.when(e <= 0, F.lit(float(t0)) + e / c0).otherwise(out)


def _stretches(rows: DataFrame) -> DataFrame:
    """rows (at, z0, z1) with stretches: what each piece of the profile `at` shares with [z0, z1], as depths lo and hi and the
    temperatures there. The profile is constant beyond its ends."""
    end = lambda k, z: F.struct(z.alias("depth"), F.element_at("at", k)["v"].alias("v"))
    first, last = end(1, F.least("z0", F.element_at("at", 1)["depth"])), end(-1, F.greatest("z1", F.element_at("at", -1)["depth"]))
    rows = rows.withColumn("every", F.concat(F.array(first), F.col("at"), F.array(last)))
    n = F.size("every") - 1
    rows = rows.withColumn("pair", F.zip_with(F.slice("every", F.lit(1), n), F.slice("every", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.greatest(a["depth"], F.col("z0")).alias("lo"), F.least(b["depth"], F.col("z1")).alias("hi"))))

    def value(p: Column, z: Column) -> Column:
        a, b = p["a"], p["b"]
        return a["v"] + (z - a["depth"]) / (b["depth"] - a["depth"]) * (b["v"] - a["v"])

    shared = F.filter("pair", lambda p: p["hi"] > p["lo"])
    return rows.withColumn("stretches", F.transform(shared, lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), value(p, p["lo"]).alias("ta"), value(p, p["hi"]).alias("tb")))).drop("every", "pair")


def mean_energy(stretches: Column, z0: Column, z1: Column, cp: Capacity) -> Column:
    """The mean energy between two depths of a profile's stretches."""

    def part(s: Column) -> Column:
        even = F.abs(s["tb"] - s["ta"]) < EQUAL
        quotient = (energy_integral(s["tb"], cp) - energy_integral(s["ta"], cp)) / F.when(even, F.lit(1.0)).otherwise(s["tb"] - s["ta"])
        return (s["hi"] - s["lo"]) * F.when(even, heat_energy((s["ta"] + s["tb"]) / 2, cp)).otherwise(quotient)

    return F.aggregate(stretches, F.lit(0.0), lambda acc, s: acc + part(s)) / (z1 - z0)


def layered_energy(cells: DataFrame, profiles: DataFrame, materials: dict[int, tuple[float, Capacity]], t: float, k: int = 3, power: float = 2.0) -> DataFrame:
    """(cid, energy, temperature, middle): volumetric energy of each cell (cid, x, y, z0, z1, layer), blended over the k nearest
    stations, the temperature that has it, and the blended temperature at the cell's middle, whose energy is another.

    materials: density and heat capacity by layer; cells of other layers have nulls, as have cells without a thickness. The
    sum of a cell's energy times its volume is the stations' energy over the same depths, whatever the cells are.
    """
    stations = stations_at(profiles, t).withColumn("sid", F.xxhash64("name", "x", "y"))
    near = nearest(cells.select(F.col("cid").alias("qid"), "x", "y"), stations.select("sid", "x", "y"), ["x", "y"], k, point_id="sid")
    rows = near.join(stations.select("sid", "at"), "sid").join(cells.select(F.col("cid").alias("qid"), "z0", "z1", "layer"), "qid")
    rows = _stretches(rows)
    z0, z1, mid = F.col("z0"), F.col("z1"), (F.col("z0") + F.col("z1")) / 2
    energy = F.lit(None).cast("double")
    for layer, (_, cp) in materials.items():
        energy = F.when((F.col("layer") == layer) & (z1 > z0), mean_energy(F.col("stretches"), z0, z1, cp)).otherwise(energy)
    lower, upper = F.filter("at", lambda a: a["depth"] <= mid), F.filter("at", lambda a: a["depth"] >= mid)
    a, b = F.coalesce(F.try_element_at(lower, F.lit(-1)), F.element_at("at", 1)), F.coalesce(F.try_element_at(upper, F.lit(1)), F.element_at("at", -1))
    middle = F.when(b["depth"] > a["depth"], a["v"] + (mid - a["depth"]) / (b["depth"] - a["depth"]) * (b["v"] - a["v"])).otherwise(F.coalesce(a["v"], b["v"]))
    w = 1 / F.pow(F.greatest("distance", F.lit(1e-12)), F.lit(power))
    rows = rows.select("qid", "layer", w.alias("w"), energy.alias("e"), middle.alias("m"))
    out = rows.groupBy("qid", "layer").agg((F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("e"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("middle"))
    density, back = F.lit(None).cast("double"), F.lit(None).cast("double")
    for layer, (rho, cp) in materials.items():
        density = F.when(F.col("layer") == layer, float(rho)).otherwise(density)
        back = F.when(F.col("layer") == layer, energy_temperature(F.col("e"), cp)).otherwise(back)
    return out.select(F.col("qid").alias("cid"), (density * F.col("e")).alias("energy"), back.alias("temperature"), "middle")


# queries


MATERIALS = {0: (250.0, ((300.0, 1000.0), (800.0, 1500.0), (2000.0, 1800.0))), 1: (1600.0, ((280.0, 700.0), (1200.0, 1100.0)))}


def _q_layers(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("cid"), (F.col("p_partkey") * 7919 % 1009 / 100).alias("x"), (F.col("p_retailprice") % 100 / 10).alias("y"), ((F.col("p_size") - 1) * 0.02).alias("z0"), (F.col("p_size") * 0.02 + 0.01).alias("z1"), (F.col("p_partkey") % 2).cast("int").alias("layer"))
    base = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), (F.col("s_suppkey") * 104729 % 1013 / 100).alias("x"), (F.col("s_nationkey") * 0.4).alias("y"), F.explode(F.array(F.lit(0.0), F.lit(10.0))).alias("t"), F.col("s_acctbal").alias("v"))
    prof = base.select("name", "x", "y", "t", F.posexplode(F.array(F.lit(0.05), F.lit(0.2), F.lit(0.45), F.lit(0.9))).alias("n", "depth"), "v")
    prof = prof.select("name", "x", "y", "t", "depth", (F.lit(1600.0) - F.col("n") * 400 + F.col("v") / 40 + F.col("t") * 5 * (F.col("n") - 1)).alias("temperature"))
    return layered_energy(part, prof, MATERIALS, 4.0).select("cid", F.round("energy", 2).alias("energy"), F.round("temperature", 5).alias("temperature"), F.round("middle", 6).alias("middle"))


def _sql() -> str:
    def pieces(cp, below, inside, above):
        held, out = 0.0, f"CASE WHEN t <= {cp[0][0]} THEN {below}"
        for (ta, ca), (tb, cb) in zip(cp, cp[1:], strict=False):
            out += f" WHEN t <= {tb} THEN {inside(ta, ca, (cb - ca) / (tb - ta), held)}"
            held += (tb - ta) * (ca + cb) / 2
        return f"{out} ELSE {above(held)} END"

    def integral(cp):
        total, held, starts = 0.0, 0.0, {}
        for (ta, ca), (tb, cb) in zip(cp, cp[1:], strict=False):
            starts[ta] = total
            h = tb - ta
            total += held * h + ca * h * h / 2 + (cb - ca) / h * h**3 / 6
            held += h * (ca + cb) / 2
        return pieces(cp, f"pow(t - {cp[0][0]}, 2) * {cp[0][1] / 2}", lambda ta, ca, m, e: f"{starts[ta]!r} + {e!r} * (t - {ta}) + pow(t - {ta}, 2) * {ca / 2!r} + pow(t - {ta}, 3) * {m / 6!r}", lambda e: f"{total!r} + {e!r} * (t - {cp[-1][0]}) + pow(t - {cp[-1][0]}, 2) * {cp[-1][1] / 2!r}")

    energy = lambda cp: pieces(cp, f"(t - {cp[0][0]}) * {cp[0][1]}", lambda ta, ca, m, e: f"{e!r} + (t - {ta}) * {ca!r} + pow(t - {ta}, 2) * {m / 2!r}", lambda e: f"{e!r} + (t - {cp[-1][0]}) * {cp[-1][1]}")

    def inverse(cp):
        held, out = 0.0, f"CASE WHEN e <= 0 THEN {cp[0][0]} + e / {cp[0][1]}"
        for (ta, ca), (tb, cb) in zip(cp, cp[1:], strict=False):
            m, more = (cb - ca) / (tb - ta), (tb - ta) * (ca + cb) / 2
            out += f" WHEN e <= {held + more!r} THEN {ta} + (sqrt({ca * ca} + 2 * {m!r} * (e - {held!r})) - {ca}) / {m!r}"
            held += more
        return f"{out} ELSE {cp[-1][0]} + (e - {held!r}) / {cp[-1][1]} END"

    both = lambda f: f"CASE WHEN layer = 0 THEN {f(MATERIALS[0][1])} ELSE {f(MATERIALS[1][1])} END"
    at = lambda f, t: both(f).replace("(t -", f"({t} -").replace("WHEN t <=", f"WHEN {t} <=")
    return f"""
WITH c AS (SELECT p_partkey AS cid, p_partkey * 7919 % 1009 / 100 AS x, p_retailprice % 100 / 10 AS y, (p_size - 1) * 0.02::DOUBLE AS z0, p_size * 0.02::DOUBLE + 0.01 AS z1, p_partkey % 2 AS layer FROM part),
s AS (SELECT s_suppkey AS sid, s_suppkey * 104729 % 1013 / 100 AS x, s_nationkey * 0.4::DOUBLE AS y, [1600 - n * 400 + s_acctbal / 40 + 4 * 5 * (n - 1) FOR n IN range(0, 4)] AS v FROM supplier),
g AS (SELECT sid, x, y, unnest([{{'a': -1.0::DOUBLE, 'b': 0.05::DOUBLE, 'u': v[1], 'w': v[1]}}, {{'a': 0.05, 'b': 0.2, 'u': v[1], 'w': v[2]}}, {{'a': 0.2, 'b': 0.45, 'u': v[2], 'w': v[3]}}, {{'a': 0.45, 'b': 0.9, 'u': v[3], 'w': v[4]}}, {{'a': 0.9, 'b': 9.0, 'u': v[4], 'w': v[4]}}]) AS g FROM s),
n AS (SELECT cid, sid, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) AS d, row_number() OVER (PARTITION BY cid ORDER BY pow(c.x - s.x, 2) + pow(c.y - s.y, 2), sid) AS r FROM c, s),
p AS (SELECT cid, sid, layer, z0, z1, 1 / pow(greatest(d, 1e-12), 2) AS wt, greatest(g.a, z0) AS lo, least(g.b, z1) AS hi, g.u + (greatest(g.a, z0) - g.a) / (g.b - g.a) * (g.w - g.u) AS ta, g.u + (least(g.b, z1) - g.a) / (g.b - g.a) * (g.w - g.u) AS tb,
  CASE WHEN g.a < (z0 + z1) / 2 AND (z0 + z1) / 2 <= g.b THEN g.u + ((z0 + z1) / 2 - g.a) / (g.b - g.a) * (g.w - g.u) END AS m FROM n JOIN c USING (cid) JOIN g USING (sid) WHERE r <= 3),
q AS (SELECT cid, sid, layer, wt, sum(CASE WHEN hi <= lo THEN 0 WHEN abs(tb - ta) < {EQUAL} THEN (hi - lo) * ({at(energy, '((ta + tb) / 2)')}) ELSE (hi - lo) * (({at(integral, 'tb')}) - ({at(integral, 'ta')})) / (tb - ta) END) / any_value(z1 - z0) AS e, max(m) AS m FROM p GROUP BY ALL),
b AS (SELECT cid, layer, sum(wt * e) / sum(wt) AS e, sum(wt * m) / sum(wt) AS middle FROM q GROUP BY ALL)
SELECT cid, round(e * CASE WHEN layer = 0 THEN {MATERIALS[0][0]} ELSE {MATERIALS[1][0]} END, 2) AS energy, round({both(inverse)}, 5) AS temperature, round(middle, 6) AS middle FROM b
"""


QUERIES = {"layered_conserving": _q_layers}
SQL = {"layered_conserving": _sql()}
