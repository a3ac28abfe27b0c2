"""Further commands of the modelling service: model catalogue, derivatives, joint covariances and draws, block means, tuning,
sensitivity, variograms, fidelities, inspections and reports; and the command surface of field mapping."""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions import records
from gramlake.functions.special import normal_ppf
from gramlake.operators import additive, advanced, elements, joins, linear, models, spatial
from gramlake.operators.mesh import boundary, interface, transfer, with_corners
from gramlake.operators.models import DENSE_ROWS
from gramlake.plans.registry import Engine, command
from gramlake.plans.service import Fitted, Service, exponents, fit, terms
from gramlake.session import table
from gramlake.sources.formats import format_vtu, parse_vtu, read_bytes, write_bytes
from gramlake.sources.workbooks import _folder

#: Model types by name, with the options that a spec of theirs takes.
TYPES = {
    "linearBasis": ["degree", "solver", "alpha", "l1_ratio", "loss"], "glm": ["family"], "quantile": ["tau"], "gam": ["segments"], "kriging": ["kernel", "trend", "nugget", "criterion"], "rbf": ["smoothing"],
    "chaos": ["degree"], "library": ["form"],
}
SHORT = ("linear", "quadratic", "polyN", "ridge-polyN", "lasso-polyN", "robust-polyN", "orthoN", "pceN", "logistic-regression", "poisson-regression", "gamma-regression", "median", "pspline", "gp", "tps", "rbf-smooth", "rbf-ridge")


def available_models() -> list[str]:
    return [*SHORT, *sorted(additive.FORMS)]


@dataclass
class Numeric:
    """A model whose predictor is numpy on bounded state, or Columns: predict(df) appends mean (and variance where it has one)."""

    kind: str
    inputs: list[str]
    output: str
    state: dict
    values: Callable[[dict, np.ndarray], tuple[np.ndarray, np.ndarray | None]] | None = None
    column: Callable[[dict], Column] | None = None
    result: dict = field(default_factory=dict)
    terms: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, kind: str | None = None, level: float = 0.95) -> DataFrame:
        if self.column is not None:
            return df.withColumn("mean", self.column(self.state))
        state, values, xs = {k: v for k, v in self.state.items() if k != "_cost"}, self.values, list(self.inputs)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                mean, var = values(state, b[xs].to_numpy(float))
                out = b.copy()
                out["mean"], out["variance"] = mean, np.nan if var is None else var
                yield out

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        out = df.mapInPandas(run, f"{kinds}, mean double, variance double")
        if kind:
            half = normal_ppf(0.5 + level / 2) * F.sqrt("variance")
            out = out.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})
        return out

    def equation(self) -> str:
        return self.state.get("equation", f"{self.output} = {self.kind}({', '.join(self.inputs)})")


def _rows(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """A bounded table's columns on the driver: over DENSE_ROWS rows raise."""
    got = df.select(*[F.col(n).cast("double") for n in names]).dropna().limit(DENSE_ROWS + 1).toPandas().to_numpy(float)
    if len(got) > DENSE_ROWS:
        raise ValueError(f"over {DENSE_ROWS} rows: a dense model takes no more")
    return got[np.lexsort(got.T[::-1])]


def thin_plate(x: np.ndarray, y: np.ndarray, smoothing: str | float = "gcv") -> dict:
    """Thin plate splines with a linear trend on inputs scaled by range; smoothing by GCV, leave-one-out, or given."""
    lo, span = x.min(0), np.maximum(np.ptp(x, axis=0), 1e-12)
    u = (x - lo) / span
    phi = lambda r: np.where(r > 0, r**2 * np.log(np.maximum(r, 1e-300)), 0.0)
    k, p = phi(spatial.pairwise_distances(u, u)), np.hstack([np.ones((len(u), 1)), u])
    n, q = p.shape
    best = None
    for lam in [smoothing] if isinstance(smoothing, (int, float)) else 10.0 ** np.arange(-10, 3, 1.0):
        a = np.block([[k + lam * np.eye(n), p], [p.T, np.zeros((q, q))]])
        inv = np.linalg.pinv(a)
        hat = np.hstack([k, p]) @ inv[:, :n]
        e = y - hat @ y
        free = 1 - np.diag(hat)
        score = float(n * (e**2).sum() / max(free.sum(), 1e-9) ** 2) if smoothing != "loo" else float(np.mean((e / np.maximum(free, 1e-9)) ** 2))
        if best is None or score < best[0]:
            best = score, inv[:, :n] @ y, float(lam)
    return {"centres": u, "coef": best[1], "lo": lo, "span": span, "smoothing": best[2], "score": best[0]}


def _thin_plate_values(s: dict, x: np.ndarray) -> tuple[np.ndarray, None]:
    u = (x - s["lo"]) / s["span"]
    r = spatial.pairwise_distances(u, s["centres"])
    phi = np.where(r > 0, r**2 * np.log(np.maximum(r, 1e-300)), 0.0)
    n = len(s["centres"])
    return phi @ s["coef"][:n] + s["coef"][n] + u @ s["coef"][n + 1 :], None


def _chaos_column(m: dict, xs: Sequence[str], limits: Sequence[tuple[float, float]]) -> Column:
    unit = [(F.col(c) - (lo + hi) / 2) * (2 / (hi - lo)) for c, (lo, hi) in zip(xs, limits, strict=True)]
    degree = max(max(e) for e in m["powers"])
    basis = [advanced.legendre(u, degree) for u in unit]
    out = F.lit(float(m["coef"][0]))
    for c, e in zip(m["coef"][1:], m["powers"], strict=True):
        part = F.lit(float(c))
        for b, k in zip(basis, e, strict=True):
            if k:
                part = part * b[k]
        out = out + part
    return out


def fit_any(df: DataFrame, inputs: Sequence[str], output: str, spec: str | dict, weight: str | None = None) -> Fitted | Numeric:
    """A model of a full spec ({type, ...}) or a short form; polynomial and GLM forms are those of the service."""
    inputs = list(inputs)
    s = dict(spec) if isinstance(spec, dict) else {}
    name = spec if isinstance(spec, str) else s.get("type", "")
    if name == "gp" or name == "kriging":
        rows = _rows(df, [*inputs, output])
        m = spatial.gp_fit(rows[:, :-1], rows[:, -1], s.get("kernel", "matern52"), s.get("trend", "constant"), s.get("nugget"), s.get("criterion", "reml"))
        return Numeric("kriging", inputs, output, {k: v for k, v in m.items() if k != "cost"} | {"cost": None, "_cost": m["cost"]}, lambda st, x: spatial.gp_predict(st, x))
    if name in ("tps", "rbf-smooth", "rbf-ridge", "rbf"):
        rows = _rows(df, [*inputs, output])
        return Numeric("rbf", inputs, output, thin_plate(rows[:, :-1], rows[:, -1], s.get("smoothing", "loo" if name == "rbf-smooth" else "gcv")), _thin_plate_values)
    if name in ("pspline", "gam"):
        m = additive.gam_fit(df, [{"x": x, "kind": "spline", "segments": s.get("segments", 8)} for x in inputs], output, s.get("family", "gaussian"))
        return Gam("gam", inputs, output, m)
    if name in ("median", "quantile"):
        m = additive.quantile_fit(df, inputs, output, s.get("tau", 0.5))
        return Numeric("quantile", inputs, output, m, column=lambda st: linear.mean_column(st, inputs), result={"coef": m["coef"]}, terms=inputs)
    if (k := re.fullmatch(r"(ortho|pce)(\d+)", name)) or name == "chaos":
        box = df.agg(*[f(c).alias(f"{c}_{n}") for c in inputs for n, f in (("lo", F.min), ("hi", F.max))]).first()
        limits = [(float(box[f"{c}_lo"]), float(box[f"{c}_hi"])) for c in inputs]
        m = advanced.chaos(df, inputs, output, limits, int(k[2]) if k else s.get("degree", 2))
        return Numeric("chaos", inputs, output, m | {"limits": limits}, column=lambda st: _chaos_column(st, inputs, st["limits"]), result={"coef": m["coef"]})
    form = s.get("form", name)
    if form in additive.FORMS and name != "linear":
        m = additive.form_fit(df, form, inputs[0], output)
        text, _ = additive.FORMS[form]
        from gramlake.functions.scalars import formula

        return Numeric("library", inputs, output, m, column=lambda st: formula(text, x=F.col(inputs[0]), **{a: F.lit(float(v)) for a, v in st["parameters"].items()}), result=m["parameters"])
    return fit(df, inputs, output, spec, weight)


@dataclass
class Gam(Numeric):
    def predict(self, df: DataFrame, kind: str | None = None, level: float = 0.95) -> DataFrame:
        return additive.gam_predict(self.state, df, parts=kind == "terms")


def derivative_column(m: Fitted, axis: str) -> Column:
    """d mean / d axis of a polynomial model, term by term."""
    j = m.inputs.index(axis)
    out = F.lit(0.0)
    for b, e in zip(m.result["coef"][1:], exponents(len(m.inputs), m.spec["degree"]), strict=True):
        if e[j]:
            part = F.lit(float(b) * e[j])
            for k, (c, n) in enumerate(zip(m.inputs, e, strict=True)):
                power = n - (k == j)
                if power:
                    part = part * F.pow(F.col(c), F.lit(float(power)))
            out = out + part
    return out


def default_candidates(n: int, inputs: int) -> list[str]:
    """Short forms to compare, by the numbers of rows and inputs: polynomials that leave a degree of freedom or five a term,
    dense models only where they fit."""
    out = [f"poly{k}" for k in range(1, 6) if 5 * math.comb(inputs + k, k) <= n]
    if inputs == 1 and n >= 30:
        out.append("pspline")
    if n <= 500:
        out += ["gp", "tps"]
    return out or ["linear"]


@dataclass
class Modelling(Service):
    """The service with every command."""

    meshes: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def _fitted(self, name: str) -> Fitted:
        m = self._model(name)
        if not isinstance(m, Fitted):
            raise TypeError(f"{name} is no polynomial model")
        return m

    @command("fitModel", "model", requires={"data": True}, effect={"model": True})
    def fit_model(self, model_name: str, model: str | dict = "linear", data_name: str = "default", output: str | None = None) -> dict:
        """Fit a model of any type to a table and store it; a failed fit leaves the old one."""
        t = self._table(data_name)
        self.models[model_name] = fit_any(t["df"], t["inputs"], output or t["outputs"][0], model, t["weight"])
        return self.model_summary(model_name)

    @command("addModel", "model", effect={"model": True})
    def add_model(self, model_name: str, model: object) -> list[str]:
        """Register a trained model object."""
        self.models[model_name] = model
        return self.list_models()

    @command("listModelTypes", "model")
    def list_model_types(self) -> dict:
        """Model types with their options, and the short forms."""
        return {"types": TYPES, "short": list(SHORT)}

    @command("listLibraryForms", "model")
    def list_library_forms(self) -> DataFrame:
        """Nonlinear forms by name: (name, expression, parameters)."""
        return self.spark.createDataFrame([(n, t, list(p)) for n, (t, p) in sorted(additive.FORMS.items())], "name string, expression string, parameters array<string>")

    @command("predictDerivatives", "model", requires={"model": True})
    def predict_derivatives(self, model_name: str, df: DataFrame, axis: str | None = None) -> DataFrame:
        """Derivatives of the mean by an input, or the gradient: exact for polynomials, by central differences otherwise."""
        m = self._model(model_name)
        axes = [axis] if axis else m.inputs
        if isinstance(m, Fitted) and m.spec["solver"] != "glm":
            return df.withColumns({f"d_{a}": derivative_column(m, a) for a in axes})
        box = df.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
        out = df
        for a in axes:
            h = 1e-5 * float(box[a] or 1.0)
            mean = [m.predict(out.withColumn("_was", F.col(a)).withColumn(a, F.col(a) + F.lit(step))).drop("variance").withColumn(a, F.col("_was")).drop("_was") for step in (h,)]
            up = mean[0].withColumnRenamed("mean", "_up")
            down = m.predict(up.withColumn("_was", F.col(a)).withColumn(a, F.col(a) - F.lit(h))).drop("variance").withColumn(a, F.col("_was")).drop("_was")
            out = down.withColumn(f"d_{a}", (F.col("_up") - F.col("mean")) / (2 * h)).drop("_up", "mean")
        return out

    @command("predictCovariance", "model", requires={"model": True})
    def predict_covariance(self, model_name: str, df: DataFrame, key: str) -> DataFrame:
        """(i, j, covariance) of the means at the rows of a bounded table."""
        mean, cov, ids = self._joint(model_name, df, key)
        return self.spark.createDataFrame([(a, b, float(cov[i, j])) for i, a in enumerate(ids) for j, b in enumerate(ids)], "i long, j long, covariance double")

    def _joint(self, model_name: str, df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
        m = self._model(model_name)
        rows = df.select(F.col(key).cast("long").alias("_k"), *[F.col(c).cast("double") for c in m.inputs]).orderBy("_k").limit(DENSE_ROWS + 1).toPandas()
        if len(rows) > DENSE_ROWS:
            raise ValueError(f"over {DENSE_ROWS} rows: a joint covariance takes no more")
        ids, x = rows["_k"].tolist(), rows[m.inputs].to_numpy(float)
        if isinstance(m, Fitted):
            basis = np.stack([np.prod(x ** np.array(e), 1) for e in exponents(len(m.inputs), m.spec["degree"])], 1)
            at = basis - np.asarray(m.result["mean"])
            cov = m.result["sigma2"] * (1 / m.result["weight"] + at @ np.asarray(m.result["inverse"]) @ at.T)
            return m.result["coef"][0] + basis @ np.asarray(m.result["coef"][1:]), cov, ids
        if m.kind != "kriging":
            raise TypeError(f"{m.kind} has no joint covariance")
        mean, cov = spatial.gp_predict(m.state, x, joint=True)
        return mean, cov, ids

    @command("simulate", "model", requires={"model": True})
    def simulate(self, model_name: str, df: DataFrame, key: str, draws: int = 1, seed: int = 0) -> DataFrame:
        """(draw, key, value): joint draws of the means at the rows of a bounded table."""
        mean, cov, ids = self._joint(model_name, df, key)
        from gramlake.functions.numerics import cholesky_jitter

        low, _ = cholesky_jitter(cov + 1e-12 * max(np.trace(cov) / len(cov), 1e-300) * np.eye(len(cov)))
        z = mean + np.random.default_rng(seed).standard_normal((draws, len(mean))) @ low.T
        return self.spark.createDataFrame([(d, i, float(v)) for d, row in enumerate(z) for i, v in zip(ids, row, strict=True)], f"draw int, {key} long, value double")

    @command("predictBlock", "model", requires={"model": True})
    def predict_block(self, model_name: str, lower: list[float], upper: list[float], per_axis: int = 8) -> dict:
        """Mean and variance of the average over a box."""
        grids = [np.linspace(a, b, per_axis, endpoint=False) + (b - a) / per_axis / 2 for a, b in zip(lower, upper, strict=True)]
        at = np.stack(np.meshgrid(*grids, indexing="ij"), -1).reshape(-1, len(grids))
        m = self._model(model_name)
        df = self.spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(at)], "_id long, " + ", ".join(f"`{c}` double" for c in m.inputs))
        mean, cov, _ = self._joint(model_name, df, "_id")
        w = np.full(len(at), 1 / len(at))
        return {"mean": float(w @ mean), "variance": float(w @ cov @ w)}

    @command("predictTerms", "model", requires={"model": True})
    def predict_terms(self, model_name: str, df: DataFrame, data_name: str = "default") -> DataFrame:
        """Centred effects of each term: of an additive model with standard errors, of a polynomial as Columns."""
        m = self._model(model_name)
        if isinstance(m, Gam):
            return m.predict(df, "terms")
        m = self._fitted(model_name)
        basis = terms(m.inputs, m.spec["degree"])
        return df.withColumns({f"term_{t}": F.lit(float(b)) * (basis[t] - F.lit(float(c))) for t, b, c in zip(m.terms, m.result["coef"][1:], m.result["mean"], strict=True)})

    @command("tuneModel", "selection", requires={"data": True}, effect={"model": True})
    def tune(self, model_name: str, model: str | dict, grid: dict[str, list], data_name: str = "default", folds: int = 5) -> list[dict]:
        """Options of a grid by cross-validation, the best model kept. Ridge strengths share one set of fold moments a degree."""
        t = self._table(data_name)
        base = {"type": model} if isinstance(model, str) else dict(model)
        rows = []
        fold = F.pmod(F.xxhash64(*t["inputs"]), F.lit(folds)).cast("int")
        for values in itertools.product(*grid.values()):
            options = dict(zip(grid, values, strict=True))
            spec = {"degree": 1, "solver": "ridge"} | {k: v for k, v in base.items() if k != "type"} | options
            if base.get("type") in (None, "linear", "linearBasis", "ridge"):
                basis = terms(t["inputs"], spec["degree"])
                data = t["df"].withColumns({f"__t{k}": c for k, c in enumerate(basis.values())})
                cv = linear.cross_validate(data, [f"__t{k}" for k in range(len(basis))], t["outputs"][0], fold, spec.get("alpha", 0.0) if spec["solver"] == "ridge" else 0.0)
                s = cv.agg(F.sqrt(F.sum(F.col("n") * F.col("rmse") ** 2) / F.sum("n")).alias("rmse"), (F.stddev_samp("rmse") / F.sqrt(F.count("*"))).alias("se")).first()
                rows.append({"options": options, "rmse": s["rmse"], "std_error": s["se"], "spec": spec})
            else:
                errors = []
                for k in range(folds):
                    marked = t["df"].withColumn("_fold", fold)
                    m = fit_any(marked.where(F.col("_fold") != k).drop("_fold"), t["inputs"], t["outputs"][0], base | options)
                    errors.append(m.predict(marked.where(F.col("_fold") == k).drop("_fold")).agg(F.avg((F.col(t["outputs"][0]) - F.col("mean")) ** 2).alias("e"), F.count("*").alias("n")).first())
                n = sum(e["n"] for e in errors)
                each = [math.sqrt(e["e"]) for e in errors if e["n"]]
                rows.append({"options": options, "rmse": math.sqrt(sum(e["e"] * e["n"] for e in errors if e["n"]) / n), "std_error": float(np.std(each, ddof=1) / math.sqrt(len(each))), "spec": base | options})
        rows.sort(key=lambda r: r["rmse"])
        self.models[model_name] = fit_any(t["df"], t["inputs"], t["outputs"][0], rows[0]["spec"], t["weight"])
        return [{k: v for k, v in r.items() if k != "spec"} for r in rows]

    @command("bootstrapModel", "model", requires={"data": True})
    def bootstrap(self, key: str, data_name: str = "default", draws: int = 200, kind: str = "wild", at: list | None = None, seed: int = 0) -> dict:
        """Percentile intervals of a linear model's coefficients, and of means at points."""
        t = self._table(data_name)
        return additive.residual_bootstrap(t["df"], key, t["inputs"], t["outputs"][0], draws, kind, seed, at or ())

    @command("sensitivityAnalysis", "model", requires={"model": True})
    def sensitivity(self, model_name: str, limits: list[tuple[float, float]], n: int = 4096, seed: int = 0) -> DataFrame:
        """(input, first, total): Sobol indices over a box, exact for chaos models on it, otherwise by two sample matrices."""
        m = self._model(model_name)
        if getattr(m, "kind", "") == "chaos" and [tuple(x) for x in limits] == [tuple(x) for x in m.state["limits"]]:
            return self.spark.createDataFrame([(c, float(a), float(b)) for c, a, b in zip(m.inputs, m.state["first"], m.state["total"], strict=True)], "input string, first double, total double")
        u = lambda j, k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        scaled = lambda j, k: F.lit(float(limits[j][0])) + u(j, k) * float(limits[j][1] - limits[j][0])
        base = self.spark.range(n)
        d = len(m.inputs)

        def run(pick: Sequence[int], name: str) -> DataFrame:
            df = base.withColumns({c: scaled(j, pick[j]) for j, c in enumerate(m.inputs)})
            return m.predict(df).select("id", F.col("mean").alias(name))

        every = run([0] * d, "a").join(run([1] * d, "b"), "id")
        for j in range(d):
            every = every.join(run([1 if k == j else 0 for k in range(d)], f"c{j}"), "id")
        var = F.var_pop(F.col("a"))
        row = every.agg(var.alias("v"), *[F.avg(F.col("b") * (F.col(f"c{j}") - F.col("a"))).alias(f"f{j}") for j in range(d)], *[(F.avg((F.col("a") - F.col(f"c{j}")) ** 2) / 2).alias(f"t{j}") for j in range(d)]).first()
        return self.spark.createDataFrame([(c, row[f"f{j}"] / row["v"], row[f"t{j}"] / row["v"]) for j, c in enumerate(m.inputs)], "input string, first double, total double")

    @command("empiricalVariogram", "spatial", requires={"data": True})
    def empirical_variogram(self, edges: list[float], key: str, data_name: str = "default", output: str | None = None) -> DataFrame:
        """Binned semivariances of an output over the inputs' distance."""
        t = self._table(data_name)
        return joins.variogram(t["df"].withColumnRenamed(key, "pid"), t["inputs"], output or t["outputs"][0], edges)

    @command("fitVariogram", "spatial", requires={"data": True}, effect={"model": True})
    def fit_variogram(self, edges: list[float], key: str, data_name: str = "default", kernel: str = "exponential", model_name: str | None = None) -> dict:
        """A variogram's nugget, sill and range; with a model's name, Kriging with that covariance too."""
        bins = [(r["distance"], r["gamma"], r["pairs"]) for r in self.empirical_variogram(edges, key, data_name).orderBy("bin").collect()]
        out = models.fit_variogram(bins, kernel)
        if model_name:
            t = self._table(data_name)
            ratio = out["nugget"] / max(out["sill"], 1e-300)
            self.models[model_name] = fit_any(t["df"], t["inputs"], t["outputs"][0], {"type": "kriging", "kernel": kernel, "nugget": ratio})
        return out

    @command("quantileProcess", "model", requires={"data": True})
    def quantile_process(self, taus: list[float], data_name: str = "default") -> list[dict]:
        """Coefficients of several levels, with loss and R1."""
        t = self._table(data_name)
        return [additive.quantile_fit(t["df"], t["inputs"], t["outputs"][0], tau) for tau in taus]

    @command("fitMultiFidelity", "model", requires={"data": True}, effect={"model": True})
    def fit_multi_fidelity(self, model_name: str, data_names: list[str], rho: str = "constant") -> dict:
        """Recursive Kriging from tables of rising fidelity."""
        held = [self._table(n) for n in data_names]
        t = held[-1]
        levels = []
        for h in held:
            rows = _rows(h["df"], [*h["inputs"], h["outputs"][0]])
            levels.append((rows[:, :-1], rows[:, -1]))
        m = spatial.fidelity_fit(levels, rho)
        self.models[model_name] = Numeric("fidelity", t["inputs"], t["outputs"][0], {"levels": m}, lambda st, x: spatial.fidelity_predict(st["levels"], x))
        return {"rho": [float(s["beta"][0]) for s in m[1:]], "levels": len(m)}

    @command("inspectModel", "model", requires={"model": True})
    def inspect(self, model_name: str, aspect: str) -> object:
        """An aspect of a model from a fixed list: coefficients, intervals, correlation, table, hyperparameters, spatial, loo,
        intervals of hyperparameters, terms, summary, knots, equation."""
        m = self._model(model_name)
        if isinstance(m, Fitted):
            from gramlake.operators.linear import student_t_ppf  # the quantile that predictions use

            r = m.result
            at = {"equation": m.equation, "coefficients": lambda: dict(zip(["1", *m.terms], r["coef"], strict=True))}
            if "std_error" in r:
                t = [b / s if s else math.nan for b, s in zip(r["coef"], r["std_error"], strict=True)]
                q = student_t_ppf(0.975, r["n"] - len(r["coef"]))
                from gramlake.functions.special import betainc

                dof = r["n"] - len(r["coef"])
                at |= {
                    "tValues": lambda: t, "pValues": lambda: [betainc(dof / 2, 0.5, dof / (dof + v * v)) for v in t],
                    "intervals": lambda: [(b - q * s, b + q * s) for b, s in zip(r["coef"], r["std_error"], strict=True)],
                    "correlation": lambda: _correlation(r).tolist(),
                    "table": lambda: [{"name": n, "estimate": b, "stdError": s, "tValue": v} for n, b, s, v in zip(["1", *m.terms], r["coef"], r["std_error"], t, strict=True)],
                }
        elif m.kind == "kriging":
            st = m.state | {"cost": m.state["_cost"]}
            at = {"hyperparameters": lambda: spatial.gp_summary(st), "spatial": lambda: spatial.gp_summary(st), "loo": lambda: {k: v.tolist() for k, v in spatial.gp_loo(st).items()}, "intervals": lambda: spatial.gp_intervals(st)}
        elif m.kind == "gam":
            at = {"terms": lambda: additive.gam_terms(m.state), "summary": lambda: additive.gam_summary(m.state)}
        else:
            at = {"coefficients": lambda: m.result, "equation": m.equation}
        if aspect not in at:
            raise ValueError(f"no aspect {aspect}; there are {sorted(at)}")
        return at[aspect]()

    @command("getModelSummary", "model", requires={"model": True})
    def model_summary(self, model_name: str) -> dict:
        """Coefficients, metrics and equation of a fitted model."""
        m = self._model(model_name)
        if isinstance(m, Fitted):
            return super().model_summary(model_name)
        return {"equation": m.equation(), "type": m.kind, **{k: v for k, v in m.result.items() if not isinstance(v, np.ndarray)}}

    @command("exportReport", "model", requires={"model": True})
    def export_report(self, model_name: str, data_name: str = "default", path: str | None = None) -> str:
        """A Markdown report: equation, coefficients, cross-validation and diagnostics; to a file if a path is given."""
        m = self._model(model_name)
        lines = [f"# Model {model_name}", "", f"`{m.equation()}`", ""]
        if isinstance(m, Fitted) and "std_error" in m.result:
            lines += ["| term | estimate | std. error |", "|-|-|-|", *(f"| {n} | {b:.6g} | {s:.3g} |" for n, b, s in zip(["1", *m.terms], m.result["coef"], m.result["std_error"], strict=True)), ""]
            cv = self.cross_validate(model_name, data_name).agg(F.avg("rmse").alias("rmse")).first()["rmse"]
            lines += [f"R2 {m.result['r_squared']:.6f}, cross-validated RMSE {cv:.6g}", "", *(f"- {k}: {v}" for k, v in self.diagnose(model_name, data_name).items())]
        else:
            lines += [f"- {k}: {v}" for k, v in m.result.items()]
        text = "\n".join(lines) + "\n"
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return text

    # field mapping

    def _mesh(self, name: str) -> tuple[DataFrame, DataFrame]:
        if name not in self.meshes:
            raise KeyError(f"unknown mesh {name}; there are {sorted(self.meshes)}")
        return self.meshes[name]

    @command("addMesh", "mesh", effect={"mesh": True})
    def add_mesh(self, mesh_name: str, points: DataFrame, cells: DataFrame) -> list[str]:
        """Store a mesh (points, cells) under a name."""
        self.meshes[mesh_name] = (points, cells)
        return self.list_meshes()

    @command("loadMesh", "mesh", effect={"mesh": True})
    def load_mesh(self, path: str, mesh_name: str) -> list[str]:
        """Load a mesh file."""
        parsed = parse_vtu(read_bytes(self.spark, path))
        points = self.spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(parsed["points"])], "pid long, x double, y double, z double")
        cells = self.spark.createDataFrame([(k, int(t), list(map(int, n))) for k, (t, n) in enumerate(zip(parsed["types"], np.split(parsed["connectivity"], parsed["offsets"][:-1]), strict=True))], "cid long, type int, nodes array<long>")
        return self.add_mesh(mesh_name, points, cells)

    @command("listMeshes", "mesh")
    def list_meshes(self) -> list[str]:
        """Names of the meshes."""
        return sorted(self.meshes)

    @command("getMesh", "mesh", requires={"mesh": True})
    def get_mesh(self, mesh_name: str) -> tuple[DataFrame, DataFrame]:
        """Points and cells of a mesh."""
        return self._mesh(mesh_name)

    @command("meshSummary", "mesh", requires={"mesh": True})
    def mesh_summary(self, mesh_name: str) -> DataFrame:
        """Counts, cell types, bounds and measure of a mesh."""
        return elements.summary(*self._mesh(mesh_name))

    @command("deleteMesh", "mesh", requires={"mesh": True})
    def delete_mesh(self, mesh_name: str) -> None:
        """Remove a mesh."""
        self._mesh(mesh_name)
        del self.meshes[mesh_name]

    @command("writeMesh", "mesh", requires={"mesh": True})
    def write_mesh(self, mesh_name: str, path: str) -> str:
        """Write a bounded mesh to a file."""
        points, cells = self._mesh(mesh_name)
        p, c = points.orderBy("pid").collect(), cells.orderBy("cid").collect()
        place = {r["pid"]: k for k, r in enumerate(p)}
        nodes = [[place[n] for n in r["nodes"]] for r in c]
        mesh = {"points": np.array([[r["x"], r["y"], r["z"]] for r in p]), "connectivity": [n for row in nodes for n in row], "offsets": np.cumsum([len(row) for row in nodes]), "types": [r["type"] for r in c]}
        return write_bytes(self.spark, path, format_vtu(mesh))

    @command("extractSurface", "mesh", requires={"mesh": True})
    def extract_surface(self, mesh_name: str, surface_name: str, kind: str = "boundary", layer: str | None = None) -> list[str]:
        """The boundary, or the interface of a label, as a mesh of its own."""
        points, cells = self._mesh(mesh_name)
        faces = boundary(cells) if kind == "boundary" else interface(cells, layer)
        out = faces.select((F.col("cid") * 8 + F.col("face")).alias("cid"), F.when(F.size("nodes") == 3, 5).otherwise(9).alias("type"), "nodes")
        return self.add_mesh(surface_name, points.join(out.select(F.explode("nodes").alias("pid")).distinct(), "pid", "left_semi"), out)

    @command("mapSurfaceFlux", "mesh", requires={"mesh": True})
    def map_surface_flux(self, source_mesh: str, target_mesh: str, values: DataFrame, cell: float) -> DataFrame:
        """Heat of a planar source's cell flux (cid, q) on the target's cells, conserved."""
        sp, sc = self._mesh(source_mesh)
        tp, tc = self._mesh(target_mesh)
        return transfer(with_corners(sc, sp).join(values, "cid"), with_corners(tc, tp), cell)

    @command("mapLayeredProfiles", "mesh", requires={"mesh": True})
    def map_layered_profiles(self, target_mesh: str, profiles: DataFrame, t: float, k: int = 3) -> DataFrame:
        """Station profiles at a time on the nodes of a mesh whose z is the depth."""
        points, _ = self._mesh(target_mesh)
        return advanced.layered(points.withColumnRenamed("z", "depth"), profiles, t, k)


def _correlation(r: dict) -> np.ndarray:
    mean, inv = np.asarray(r["mean"]), np.asarray(r["inverse"])
    full = np.block([[np.array([[1 / r["weight"] + mean @ inv @ mean]]), -(mean @ inv)[None]], [-(inv @ mean)[:, None], inv]])
    sd = np.sqrt(np.diag(full))
    return full / np.outer(sd, sd)


def run(spark, arguments: Sequence[str]) -> dict:
    """One command of the command line: `info` (the catalogue), `template FOLDER`, `layered K=V...`, `flux K=V...`."""
    name, rest = arguments[0], " ".join(arguments[1:])
    engine = Modelling(spark)
    if name == "info":
        return {"commands": [r["name"] for r in engine.catalogue().orderBy("name").collect()]}
    if name == "template":
        return {"manifest": records.write_station_template(rest)}
    options = records.key_values(rest)
    if name == "flux":
        engine.load_mesh(options["source"], "s")
        engine.load_mesh(options["target"], "t")
        values = spark.read.parquet(options["values"])
        out = engine.map_surface_flux("s", "t", values, float(options.get("cell", 0.1)))
        return {"rows": out.count(), "heat": out.agg(F.sum(F.col("plus") + F.col("minus"))).first()[0]}
    if name == "layered":
        engine.load_mesh(options["target"], "t")
        out = engine.map_layered_profiles("t", spark.read.parquet(options["profiles"]), float(options.get("time", 0.0)))
        return {"rows": out.count()}
    raise ValueError(f"unknown command {name}")


def main(arguments: Sequence[str] | None = None) -> int:
    """Print a command's result as JSON; 1 on wrong input."""
    import sys

    from gramlake.session import session

    try:
        print(json.dumps(run(session(), arguments or sys.argv[1:])))
        return 0
    except (KeyError, ValueError, IndexError, OSError) as e:
        print(json.dumps({"error": f"{type(e).__name__}: {e}"}))
        return 1


# queries


def _engine(s, d):
    e = Modelling(s)
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_partkey") % 7 / 7.0).alias("b"), F.col("p_retailprice").alias("y0"))
    e.invoke("setData", df=p.withColumn("y", 2 + F.col("a") - 3 * F.col("a") * F.col("b") + F.col("b") ** 2).drop("y0", "p_partkey"), inputs=["a", "b"], outputs=["y"])
    return e


def _q_derivatives(s, d):
    e = _engine(s, d)
    e.invoke("fitModel", modelName="q", model="quadratic")
    at = s.range(11).select("id", (F.col("id") / 10).alias("a"), (F.col("id") / 20).alias("b"))
    out = e.invoke("predictDerivatives", modelName="q", df=at)
    e.invoke("fitModel", modelName="c", model="pce2")
    other = e.invoke("predictDerivatives", modelName="c", df=at, axis="a").select("id", F.round("d_a", 6).alias("chaos_a"))
    return out.select("id", F.round("d_a", 8).alias("d_a"), F.round("d_b", 8).alias("d_b")).join(other, "id")


def _q_checks(s, d):
    """What the commands must agree on, as booleans and numbers."""
    e = _engine(s, d)
    noisy = e.tables["default"]["df"].withColumn("y", F.col("y") + (F.pmod(F.xxhash64("a", "b"), F.lit(100)) - 50) / 500)
    e.invoke("setData", df=noisy, inputs=["a", "b"], outputs=["y"], dataName="n")
    e.invoke("fitModel", modelName="l", model="quadratic", dataName="n")
    at = s.createDataFrame([(k, 0.1 + 0.2 * k, 0.5) for k in range(4)], "k long, a double, b double")
    mean = [r["mean"] for r in e.invoke("predict", modelName="l", df=at).orderBy("k").collect()]
    half = e.invoke("predict", modelName="l", df=at, interval="confidence").orderBy("k").collect()
    cov = {(r["i"], r["j"]): r["covariance"] for r in e.invoke("predictCovariance", modelName="l", df=at, key="k").collect()}
    ratio = {round((half[k]["upper"] - half[k]["lower"]) / math.sqrt(cov[k, k]), 6) for k in range(4)}
    draws = e.invoke("simulate", modelName="l", df=at, key="k", draws=4000).groupBy("k").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).orderBy("k").collect()
    block = e.invoke("predictBlock", modelName="l", lower=[0.2, 0.2], upper=[0.6, 0.8], perAxis=12)
    tuned = e.invoke("tuneModel", modelName="t", model={"solver": "ridge"}, grid={"degree": [1, 2], "alpha": [0.0, 100.0]}, dataName="n")
    boot = e.invoke("bootstrapModel", key="a", dataName="n", draws=60)
    e.invoke("setData", df=noisy.distinct(), inputs=["a", "b"], outputs=["y"], dataName="u")
    e.invoke("fitModel", modelName="g", model="gp", dataName="u")
    e.invoke("fitModel", modelName="p", model="pspline", dataName="n")
    table_ = e.invoke("inspectModel", modelName="l", aspect="table")
    corr = np.array(e.invoke("inspectModel", modelName="l", aspect="correlation"))
    loo = e.invoke("inspectModel", modelName="g", aspect="loo")
    report = e.invoke("exportReport", modelName="l", dataName="n")
    true = lambda a, b: 2 + a - 3 * a * b + b * b
    sens = {r["input"]: r["first"] for r in e.invoke("sensitivityAnalysis", modelName="l", limits=[(0.0, 1.0), (0.0, 1.0)], n=3000).collect()}
    rows = [
        ("interval", len(ratio) == 1), ("draw mean", all(abs(r["m"] - m) < 0.01 for r, m in zip(draws, mean, strict=True))), ("draw variance", all(abs(r["v"] / cov[k, k] - 1) < 0.15 for k, r in enumerate(draws))),
        ("block", abs(block["mean"] - true(0.4, 0.5) - 0.03) < 0.08), ("block variance", block["variance"] < max(cov[k, k] for k in range(4)) * 2), ("tuned", tuned[0]["options"] == {"degree": 2, "alpha": 0.0} and len(tuned) == 4),
        ("bootstrap", len(boot["coef"]) == 3), ("gp", max(abs(r["mean"] - true(r["a"], r["b"])) for r in e.invoke("predict", modelName="g", df=at).collect()) < 0.2),
        ("pspline", "parts" in e.invoke("predictTerms", modelName="p", df=at).columns), ("table", len(table_) == 6), ("correlation", bool(np.allclose(np.diag(corr), 1))), ("loo", abs(float(np.mean(loo["standardised"]))) < 0.5),
        ("report", "cross-validated RMSE" in report), ("types", "kriging" in e.invoke("listModelTypes")["types"]), ("forms", e.invoke("listLibraryForms").count() >= 17), ("candidates", default_candidates(100, 2)[0] == "poly1"),
        ("sensitivity", sens["a"] > 0 and sens["b"] > 0), ("added", "x" in e.invoke("addModel", modelName="x", model=e.models["l"])),
        ("terms", abs(e.invoke("predictTerms", modelName="l", df=at).select(sum((F.col(f"`term_{t}`") for t in e.models["l"].terms), F.lit(0.0)).alias("s")).first()["s"] + float(np.mean([r["y"] for r in noisy.select("y").collect()])) - mean[0]) < 1e-6),
    ]
    return s.createDataFrame([(n, bool(v)) for n, v in rows], "name string, holds boolean")


def _q_spatial(s, d):
    e = Modelling(s)
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), F.col("label").cast("double").alias("y"))
    e.invoke("setData", df=v, inputs=["a", "b"], outputs=["y"], dataName="v")
    e.tables["v"]["df"] = v
    out = e.invoke("empiricalVariogram", edges=[0.0, 0.2, 0.4, 0.6], key="id", dataName="v")
    fitted = e.invoke("fitVariogram", edges=[0.0, 0.2, 0.4, 0.6, 0.8], key="id", dataName="v")
    return out.select("bin", "pairs", F.round("gamma", 8).alias("gamma"), F.lit(fitted["sill"] >= 0).alias("sill"))


def _q_mapping(s, d):
    from gramlake.operators.mesh import box_mesh, plane_mesh

    e = Modelling(s)
    e.invoke("addMesh", meshName="box", points=box_mesh(s, (3, 3, 3))[0], cells=box_mesh(s, (3, 3, 3))[1])
    e.invoke("extractSurface", meshName="box", surfaceName="skin")
    path = f"{_folder(s)}/mesh.vtu"
    e.invoke("writeMesh", meshName="box", path=path)
    e.invoke("loadMesh", path=path, meshName="again")
    e.invoke("addMesh", meshName="fine", points=plane_mesh(s, 6, 6)[0], cells=plane_mesh(s, 6, 6)[1])
    e.invoke("addMesh", meshName="coarse", points=plane_mesh(s, 4, 3)[0], cells=plane_mesh(s, 4, 3)[1])
    q = e.invoke("getMesh", meshName="fine")[1].select("cid", (F.col("cid") % 5 - 1.0).alias("q"))
    heat = e.invoke("mapSurfaceFlux", sourceMesh="fine", targetMesh="coarse", values=q, cell=0.3).agg(F.sum(F.col("plus") + F.col("minus")).alias("h")).first()["h"]
    e.invoke("deleteMesh", meshName="coarse")
    skin, again = (e.invoke("meshSummary", meshName=n).first() for n in ("skin", "again"))
    return s.createDataFrame([(skin["cells"], round(skin["measure"], 9), again["points"], round(again["measure"], 9), ",".join(e.invoke("listMeshes")), round(heat, 9))], "faces long, area double, points long, volume double, names string, heat double")


QUERIES = {"model_derivatives": _q_derivatives, "service_checks": _q_checks, "service_variogram": _q_spatial, "mapping_service": _q_mapping}
_HOLDS = ["interval", "draw mean", "draw variance", "block", "block variance", "tuned", "bootstrap", "gp", "pspline", "table", "correlation", "loo", "report", "types", "forms", "candidates", "sensitivity", "added", "terms"]
SQL = {
    "model_derivatives": "SELECT id, round(1 - 3 * id / 20.0, 8)::DOUBLE AS d_a, round(-3 * id / 10.0 + 2 * id / 20.0, 8)::DOUBLE AS d_b, round(1 - 3 * id / 20.0, 6)::DOUBLE AS chaos_a FROM range(11) t(id)",
    "service_checks": "SELECT name, true AS holds FROM (VALUES " + ", ".join(f"('{n}')" for n in _HOLDS) + ") t(name)",
    "service_variogram": "WITH v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, label::DOUBLE AS y FROM embeddings), p AS (SELECT sqrt(pow(l.a - r.a, 2) + pow(l.b - r.b, 2)) AS h, pow(l.y - r.y, 2) / 2 AS g FROM v l JOIN v r ON l.id < r.id) SELECT (CASE WHEN h <= 0.2 THEN 0 WHEN h <= 0.4 THEN 1 ELSE 2 END)::INTEGER AS bin, count(*) AS pairs, round(avg(g), 8) AS gamma, true AS sill FROM p WHERE h > 0 AND h <= 0.6 GROUP BY 1",
    "mapping_service": "SELECT 54::BIGINT AS faces, 6.0::DOUBLE AS area, 64::BIGINT AS points, 1.0::DOUBLE AS volume, 'again,box,fine,skin' AS names, round((SELECT sum((i % 5) - 1.0) / 72 FROM range(72) t(i)), 9)::DOUBLE AS heat",
}
