"""Linear constraints of fitted functions: values, derivatives, integrals, bounds, shapes and balances as rows of one matrix, least
squares under them, and projections of fields on linear and nonlinear balances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.functions.numerics import bounded_qp, box_quadrature, stencil
from gramlake.operators.linear import full_moments
from gramlake.session import table

#: Kinds of a row: its functional equals, is at least, or is at most the value.
EQUAL, AT_LEAST, AT_MOST = "=", ">=", "<="


@dataclass
class Constraint:
    """sum_k weight_k f_output(k)(point_k) (kind) value."""

    points: np.ndarray
    weights: np.ndarray
    outputs: np.ndarray
    kind: str
    value: float
    name: str = ""


def _one(points: np.ndarray, weights: np.ndarray, output: int, kind: str, value: float, name: str) -> Constraint:
    return Constraint(points, weights, np.full(len(points), output), kind, float(value), name)


def value_constraints(x: Sequence[Sequence[float]], values: Sequence[float], output: int = 0, kind: str = EQUAL) -> list[Constraint]:
    return [_one(np.asarray([p], float), np.ones(1), output, kind, v, f"value {k}") for k, (p, v) in enumerate(zip(x, values, strict=True))]


def derivative_constraints(x: Sequence[Sequence[float]], axis: int, values: Sequence[float], order: int = 1, output: int = 0, kind: str = EQUAL, step: float = 1e-3) -> list[Constraint]:
    out = []
    for k, (p, v) in enumerate(zip(x, values, strict=True)):
        points, weights = stencil(p, [order if j == axis else 0 for j in range(len(p))], step)
        out.append(_one(points, weights, output, kind, v, f"derivative {k}"))
    return out


def integral_constraint(lower: Sequence[float], upper: Sequence[float], value: float, output: int = 0, mean: bool = False, n: int = 8, kind: str = EQUAL) -> list[Constraint]:
    points, weights = box_quadrature(lower, upper, n)
    return [_one(points, weights / weights.sum() if mean else weights, output, kind, value, "mean" if mean else "integral")]


def bound_constraints(x: Sequence[Sequence[float]], lower: float | None = None, upper: float | None = None, output: int = 0) -> list[Constraint]:
    out = []
    if lower is not None:
        out += value_constraints(x, [lower] * len(x), output, AT_LEAST)
    if upper is not None:
        out += value_constraints(x, [upper] * len(x), output, AT_MOST)
    return out


def monotone_constraints(x: Sequence[Sequence[float]], axis: int, rising: bool = True, output: int = 0) -> list[Constraint]:
    return derivative_constraints(x, axis, [0.0] * len(x), 1, output, AT_LEAST if rising else AT_MOST)


def convex_constraints(x: Sequence[Sequence[float]], axis: int, convex: bool = True, output: int = 0) -> list[Constraint]:
    return derivative_constraints(x, axis, [0.0] * len(x), 2, output, AT_LEAST if convex else AT_MOST)


def output_sum_constraints(x: Sequence[Sequence[float]], coefficients: Sequence[float], value: float, kind: str = EQUAL) -> list[Constraint]:
    """sum over outputs of coefficient * f at every point."""
    m = len(coefficients)
    return [Constraint(np.repeat(np.asarray([p], float), m, 0), np.asarray(coefficients, float), np.arange(m), kind, float(value), f"sum {k}") for k, p in enumerate(x)]


BUILDERS: dict[str, Callable[..., list[Constraint]]] = {
    "value": value_constraints, "derivative": derivative_constraints, "integral": integral_constraint, "mean": lambda **k: integral_constraint(mean=True, **k), "bound": bound_constraints,
    "monotone": monotone_constraints, "convex": convex_constraints, "outputSum": output_sum_constraints,
}


def build_constraints(specs: Sequence[dict]) -> list[Constraint]:
    """Constraints of specs {type, ...the builder's arguments}."""
    out = []
    for s in specs:
        if s.get("type") not in BUILDERS:
            raise ValueError(f"no constraint {s.get('type')}; there are {sorted(BUILDERS)}")
        out += BUILDERS[s["type"]](**{k: v for k, v in s.items() if k != "type"})
    return out


def expand(constraints: Sequence[Constraint], basis: Callable[[np.ndarray], np.ndarray], outputs: int = 1) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(C, d, kinds): rows over the coefficients of all outputs in turn."""
    width = basis(constraints[0].points[:1]).shape[1]
    c = np.zeros((len(constraints), width * outputs))
    for k, q in enumerate(constraints):
        values = basis(q.points) * q.weights[:, None]
        for o in np.unique(q.outputs):
            c[k, o * width : (o + 1) * width] += values[q.outputs == o].sum(0)
    return c, np.array([q.value for q in constraints]), [q.kind for q in constraints]


def feasibility(c: np.ndarray, d: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> list[dict]:
    """Of each row the range of its functional over a box of coefficients, and whether its value lies inside."""
    lo = np.minimum(c * lower, c * upper).sum(1)
    hi = np.maximum(c * lower, c * upper).sum(1)
    return [{"lower": float(a), "upper": float(b), "inside": bool(a - 1e-12 <= v <= b + 1e-12)} for a, b, v in zip(lo, hi, d, strict=True)]


def constrained_least_squares(gram: np.ndarray, cross: np.ndarray, c: np.ndarray, d: np.ndarray, kinds: Sequence[str]) -> dict:
    """min b'Gb / 2 - v'b under the rows: {coef, multipliers, active}. The dual of the inequalities is a program in a box."""
    sign = np.array([1.0 if k in (EQUAL, AT_LEAST) else -1.0 for k in kinds])
    a, t = c * sign[:, None], d * sign
    scale = np.trace(gram) / len(gram)
    inv = np.linalg.inv(gram + 1e-12 * scale * np.eye(len(gram)))
    free = inv @ cross
    lower = np.array([-np.inf if k == EQUAL else 0.0 for k in kinds])
    lam = bounded_qp(a @ inv @ a.T, -(t - a @ free), lower, None, 1e-13)
    return {"coef": free + inv @ a.T @ lam, "multipliers": lam * sign, "active": [k == EQUAL or bool(v > 1e-10) for k, v in zip(kinds, lam, strict=True)]}


def report(fit: dict, constraints: Sequence[Constraint], c: np.ndarray) -> list[dict]:
    """Of each constraint its value, what the fit achieves, the residual, the multiplier and whether it is active."""
    got = c @ fit["coef"]
    return [{"name": q.name, "kind": q.kind, "target": q.value, "achieved": float(g), "residual": float(g - q.value), "multiplier": float(m), "active": a} for q, g, m, a in zip(constraints, got, fit["multipliers"], fit["active"], strict=True)]


def polynomial_basis(degree: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.stack([x[:, 0] ** k for k in range(degree + 1)], 1)


def constrained_polynomial(df: DataFrame, x: str, y: str, degree: int, specs: Sequence[dict]) -> dict:
    """A polynomial in one input under constraints: the data are one aggregate of moments."""
    names = [f"__p{k}" for k in range(1, degree + 1)]
    data = df.withColumns({n: F.pow(F.col(x).cast("double"), F.lit(float(k + 1))) for k, n in enumerate(names)})
    m = full_moments(data, names, y)
    n, mean, cov = m["n"], np.asarray(m["mean"]), np.asarray(m["cov"])
    # raw second moments with the constant first
    full = np.zeros((degree + 2, degree + 2))
    full[1:, 1:] = cov + n * np.outer(mean, mean)
    full[0, 0], full[0, 1:], full[1:, 0] = n, n * mean, n * mean
    constraints = build_constraints(specs)
    c, d, kinds = expand(constraints, polynomial_basis(degree))
    out = constrained_least_squares(full[:-1, :-1], full[:-1, -1], c, d, kinds)
    return out | {"report": report(out, constraints, c)}


def project_nonlinear(x0: np.ndarray, w: np.ndarray, g: Callable[[np.ndarray], np.ndarray], jac: Callable[[np.ndarray], np.ndarray], d: np.ndarray, lower: np.ndarray | None = None, upper: np.ndarray | None = None, tol: float = 1e-10, rounds: int = 50) -> np.ndarray:
    """The least weighted change of x0 with g(x) = d inside bounds: linearised again at every step, held entries left out."""
    x = np.array(x0, float)
    lo = np.full(len(x), -np.inf) if lower is None else lower
    hi = np.full(len(x), np.inf) if upper is None else upper
    held = np.zeros(len(x), bool)
    for _ in range(rounds):
        gap = np.asarray(d, float) - g(x)
        if np.abs(gap).max() <= tol * max(np.abs(d).max(), 1.0):
            break
        j = np.atleast_2d(jac(x))
        # from x0 again: the step aims at g(x) + J (new - x) = d
        free = ~held
        rhs = gap + j @ (x - x0) - j[:, held] @ (x - x0)[held]
        a = (j[:, free] / w[free]) @ j[:, free].T
        lam = np.linalg.lstsq(a, rhs, rcond=None)[0]
        new = x.copy()
        new[free] = x0[free] + (j[:, free].T @ lam) / w[free]
        out = np.clip(new, lo, hi)
        held |= (out != new) & free
        x = out
    return x


# queries


def _q_fit(s, d):
    """A line through a fixed point: the slope is that of the shifted sums; and the balance of an integral."""
    p = table(s, d, "part").select("p_size", "p_retailprice")
    a = constrained_polynomial(p, "p_size", "p_retailprice", 1, [{"type": "value", "x": [[10.0]], "values": [1000.0]}])
    b = constrained_polynomial(p, "p_size", "p_retailprice", 2, [{"type": "mean", "lower": [0.0], "upper": [50.0], "value": 1500.0}, {"type": "derivative", "x": [[0.0]], "axis": 0, "values": [0.0]}])
    c = constrained_polynomial(p, "p_size", "p_retailprice", 1, [{"type": "monotone", "x": [[25.0]], "axis": 0, "rising": True}, {"type": "bound", "x": [[0.0], [50.0]], "lower": 0.0}])
    return s.createDataFrame([(round(float(a["coef"][1]), 5), round(float(a["report"][0]["residual"]), 6), round(b["report"][0]["achieved"], 4), round(b["report"][1]["achieved"], 4), all(r["achieved"] > -1e-6 for r in c["report"]))], "slope double, gap double, mean double, derivative double, holds boolean")


def _q_project(s, d):
    x0 = np.array([1.0, 2.0, 3.0])
    got = project_nonlinear(x0, np.ones(3), lambda x: np.array([x @ x]), lambda x: 2 * x[None], np.array([56.0]))
    f = feasibility(np.array([[1.0, 1.0, 0.0]]), np.array([3.0]), np.zeros(3), np.ones(3))[0]
    return s.createDataFrame([(k, round(float(v), 6), f["inside"]) for k, v in enumerate(got)], "k int, x double, inside boolean")


QUERIES = {"constrained_polynomial": _q_fit, "project_nonlinear": _q_project}
SQL = {
    "constrained_polynomial": "SELECT round(sum((p_size - 10) * (p_retailprice - 1000)) / sum((p_size - 10) * (p_size - 10)), 5) AS slope, 0.0::DOUBLE AS gap, 1500.0::DOUBLE AS mean, 0.0::DOUBLE AS derivative, true AS holds FROM part",
    "project_nonlinear": "SELECT k::INTEGER AS k, (2.0 * (k + 1))::DOUBLE AS x, false AS inside FROM range(3) t(k)",
}
