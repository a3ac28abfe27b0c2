"""The modelling service: named tables and models, specs in short form, ranking, diagnosis, and JSON persistence."""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.operators import diagnostics, linear, models
from gramlake.operators.tables import clean, summary
from gramlake.plans.registry import Engine, command
from gramlake.sources.formats import load_table


def expand(spec: str | dict) -> dict:
    """A full spec of a short form: linear, quadratic, polyN, ridge-polyN, lasso-polyN, robust-polyN, poisson-regression,
    logistic-regression, gamma-regression; or JSON text, or a spec."""
    if isinstance(spec, dict):
        return {"degree": 1, "solver": "ols"} | spec
    if spec.lstrip().startswith("{"):
        return expand(json.loads(spec))
    family = {"poisson-regression": "poisson", "logistic-regression": "binomial", "gamma-regression": "gamma"}.get(spec)
    if family:
        return {"degree": 1, "solver": "glm", "family": family}
    m = re.fullmatch(r"(?:(ridge|lasso|robust)-)?(linear|quadratic|poly(\d+))", spec)
    if not m:
        raise ValueError(f"unknown model {spec}")
    return {"degree": {"linear": 1, "quadratic": 2}.get(m[2]) or int(m[3]), "solver": m[1] or "ols"}


def exponents(n: int, degree: int) -> list[tuple[int, ...]]:
    """Monomials of total degree 1 to degree in n inputs."""
    return sorted((e for e in itertools.product(range(degree + 1), repeat=n) if 0 < sum(e) <= degree), key=lambda e: (sum(e), [-x for x in e]))


def terms(xs: Sequence[str], degree: int) -> dict[str, Column]:
    out = {}
    for e in exponents(len(xs), degree):
        name = "*".join(c if k == 1 else f"{c}^{k}" for c, k in zip(xs, e, strict=True) if k)
        col = F.lit(1.0)
        for c, k in zip(xs, e, strict=True):
            for _ in range(k):
                col = col * F.col(c)
        out[name] = col
    return out


@dataclass
class Fitted:
    """A model as data: enough to predict as an expression, to report and to save."""

    spec: dict
    inputs: list[str]
    output: str
    terms: list[str]
    result: dict

    def design(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        basis = terms(self.inputs, self.spec["degree"])
        return df.withColumns({f"__t{k}": basis[t] for k, t in enumerate(self.terms)}), [f"__t{k}" for k in range(len(self.terms))]

    def predict(self, df: DataFrame, kind: str | None = None, level: float = 0.95) -> DataFrame:
        data, names = self.design(df)
        if kind:
            out = linear.predict(data, self.result, names, kind, level)
        else:
            eta = linear.mean_column(self.result, names)
            link = models.LINKS[models.CANONICAL[self.spec["family"]]][0] if self.spec["solver"] == "glm" else lambda e: e
            out = data.withColumn("mean", link(eta))
        return out.drop(*names)

    def equation(self) -> str:
        b = self.result["coef"]
        return f"{self.output} = {b[0]:.6g}" + "".join(f" {'+' if v >= 0 else '-'} {abs(v):.6g} {t}" for v, t in zip(b[1:], self.terms, strict=True))

    def to_json(self) -> str:
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.result.items()}
        return json.dumps({"spec": self.spec, "inputs": self.inputs, "output": self.output, "terms": self.terms, "result": plain})

    @classmethod
    def from_json(cls, text: str) -> Fitted:
        d = json.loads(text)
        d["result"] |= {k: np.array(d["result"][k]) for k in ("inverse", "mean") if k in d["result"]}
        return cls(**d)


def fit(df: DataFrame, inputs: Sequence[str], output: str, spec: str | dict, weight: str | None = None) -> Fitted:
    spec = expand(spec)
    out = Fitted(spec, list(inputs), output, list(terms(inputs, spec["degree"])), {})
    data, names = out.design(df)
    if spec["solver"] in ("ols", "ridge"):
        out.result = linear.fit_one(data, names, output, weight, spec.get("alpha", 0.0 if spec["solver"] == "ols" else 1e-3))
    elif spec["solver"] == "lasso":
        m = linear.full_moments(data, names, output)
        out.result = {"coef": list(map(float, linear.elastic_net(m, spec.get("alpha", 1e-3 * math.sqrt(m["cov"][-1, -1] / m["n"])), spec.get("l1_ratio", 1.0))))}
    elif spec["solver"] == "robust":
        out.result = models.robust(data, names, output, spec.get("loss", "huber"))
    else:
        out.result = models.glm(data, names, output, spec["family"])
    return out


@dataclass
class Service(Engine):
    tables: dict[str, dict] = field(default_factory=dict)
    models: dict[str, Fitted] = field(default_factory=dict)

    def _table(self, name: str) -> dict:
        if name not in self.tables:
            raise KeyError(f"unknown data {name}; there are {sorted(self.tables)}")
        return self.tables[name]

    def _model(self, name: str) -> Fitted:
        if name not in self.models:
            raise KeyError(f"unknown model {name}; there are {sorted(self.models)}")
        return self.models[name]

    @command("setData", "data", effect={"data": True})
    def set_data(self, df: DataFrame, inputs: list[str], outputs: list[str], data_name: str = "default", weight: str | None = None) -> dict:
        """Register a table with the roles of its columns."""
        self.tables[data_name] = {"df": clean(df, inputs, outputs, weight), "inputs": inputs, "outputs": outputs, "weight": weight}
        self.tables[data_name]["df"].createOrReplaceTempView(data_name)
        return {"dataName": data_name}

    @command("loadDataFromFile", "data", effect={"data": True})
    def load_data(self, path: str, inputs: list[str], outputs: list[str], data_name: str = "default", weight: str | None = None) -> dict:
        """Load delimited text; rows with a missing or non-numeric value are dropped and counted."""
        df, counts = load_table(self.spark, path, inputs, outputs, weight)
        self.tables[data_name] = {"df": df, "inputs": inputs, "outputs": outputs, "weight": weight}
        r = counts.first()
        return {"nSamples": r["n_samples"], "droppedRows": r["dropped_rows"]}

    @command("listData", "data")
    def list_data(self) -> list[str]:
        """List registered tables."""
        return sorted(self.tables)

    @command("deleteData", "data")
    def delete_data(self, data_name: str) -> None:
        """Remove a table."""
        self._table(data_name)
        del self.tables[data_name]

    @command("getDataSummary", "data")
    def data_summary(self, data_name: str = "default") -> DataFrame:
        """Count, missing values, mean, deviation and extremes of each column."""
        t = self._table(data_name)
        return summary(t["df"], [*t["inputs"], *t["outputs"]], population=True)

    @command("fitModel", "model", requires={"data": True}, effect={"model": True})
    def fit_model(self, model_name: str, model: str | dict = "linear", data_name: str = "default", output: str | None = None) -> dict:
        """Fit a model to a table and store it; a failed fit leaves the old one."""
        t = self._table(data_name)
        self.models[model_name] = fit(t["df"], t["inputs"], output or t["outputs"][0], model, t["weight"])
        return self.model_summary(model_name)

    @command("listModels", "model")
    def list_models(self) -> list[str]:
        """List fitted models."""
        return sorted(self.models)

    @command("deleteModel", "model")
    def delete_model(self, model_name: str) -> None:
        """Remove a fitted model."""
        self._model(model_name)
        del self.models[model_name]

    @command("getModelSummary", "model", requires={"model": True})
    def model_summary(self, model_name: str) -> dict:
        """Coefficients, metrics and equation of a fitted model."""
        m = self._model(model_name)
        return {"equation": m.equation(), "terms": ["1", *m.terms], **{k: v for k, v in m.result.items() if not isinstance(v, np.ndarray)}}

    @command("predict", "model", requires={"model": True})
    def predict(self, model_name: str, df: DataFrame, interval: str | None = None, level: float = 0.95) -> DataFrame:
        """Predictions as a lazy table, with an interval if asked for."""
        return self._model(model_name).predict(df, interval, level)

    @command("crossValidateModel", "model", requires={"model": True})
    def cross_validate(self, model_name: str, data_name: str = "default", folds: int = 5) -> DataFrame:
        """k-fold errors from one grouped aggregate."""
        m, t = self._model(model_name), self._table(data_name)
        data, names = m.design(t["df"])
        fold = F.pmod(F.xxhash64(*t["inputs"]), F.lit(folds)).cast("int")
        return linear.cross_validate(data, names, m.output, fold)

    @command("compareModels", "selection", requires={"data": True})
    def compare(self, candidates: list, data_name: str = "default", criterion: str = "bic", model_name: str | None = None) -> list[dict]:
        """Rank least-squares candidates by a criterion: every candidate is a sub-matrix of one set of moments."""
        t = self._table(data_name)
        specs = [expand(c) for c in candidates]
        basis = terms(t["inputs"], max(s["degree"] for s in specs))
        data = t["df"].withColumns({f"__t{k}": c for k, c in enumerate(basis.values())})
        full = linear.full_moments(data, [f"__t{k}" for k in range(len(basis))], t["outputs"][0])
        rows = []
        for c, s in zip(candidates, specs, strict=True):
            own = list(terms(t["inputs"], s["degree"]))
            at = [*(list(basis).index(x) for x in own), len(basis)]
            r = linear.solve(full["n"], float(full["n"]), full["mean"][at], full["cov"][np.ix_(at, at)][np.triu_indices(len(at))])
            rows.append({"model": c, "parameters": len(own) + 1, "score": r[criterion], "r_squared": r["r_squared"], "rmse": r["rmse"]})
        rows.sort(key=lambda r: (r["score"], r["parameters"]))
        if model_name:
            self.fit_model(model_name, rows[0]["model"], data_name)
        return rows

    @command("autoFit", "selection", requires={"data": True}, effect={"model": True})
    def auto_fit(self, model_name: str, data_name: str = "default", degree: int = 3) -> dict:
        """The best polynomial up to a degree by BIC."""
        best = self.compare([f"poly{k}" for k in range(1, degree + 1)], data_name)[0]["model"]
        return self.fit_model(model_name, best, data_name)

    @command("stepwiseSelect", "selection", requires={"data": True})
    def stepwise(self, data_name: str = "default", degree: int = 2, criterion: str = "bic") -> list[str]:
        """Terms chosen forward and backward."""
        t = self._table(data_name)
        basis = terms(t["inputs"], degree)
        data = t["df"].withColumns({f"__t{k}": c for k, c in enumerate(basis.values())})
        m = linear.full_moments(data, [f"__t{k}" for k in range(len(basis))], t["outputs"][0])
        return linear.stepwise(m, list(basis), criterion)

    @command("diagnoseModel", "model", requires={"model": True})
    def diagnose(self, model_name: str, data_name: str = "default") -> dict:
        """Outliers, influence, normality and heteroscedasticity of the residuals."""
        m, t = self._model(model_name), self._table(data_name)
        data, names = m.design(t["df"])
        d = linear.diagnosed(data, m.result, names, m.output)
        n = m.result["n"]
        s = d.agg(F.count_if(F.abs("studentised") > 3).alias("outliers"), F.count_if(F.col("cook") > 4.0 / n).alias("influential"), F.max("leverage").alias("max_leverage")).first().asDict()
        bp = diagnostics.breusch_pagan(d, "residual", names).first()["lm"]
        return s | {"normality": diagnostics.normal_test(d, "residual"), "breusch_pagan": bp}

    @command("saveModel", "model", requires={"model": True})
    def save(self, model_name: str, path: str) -> str:
        """Save a fitted model as JSON."""
        with open(path, "w", encoding="utf-8") as f:
            f.write(self._model(model_name).to_json())
        return path

    @command("loadModel", "model", effect={"model": True})
    def load(self, model_name: str, path: str) -> dict:
        """Load a saved model."""
        with open(path, encoding="utf-8") as f:
            self.models[model_name] = Fitted.from_json(f.read())
        return self.model_summary(model_name)


# queries


def _service(s, d):
    from gramlake.session import table

    e = Service(s)
    e.invoke("setData", df=table(s, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), "l_discount", "l_extendedprice"), inputs=["q", "l_discount"], outputs=["l_extendedprice"])
    return e


def _q_compare(s, d):
    rows = _service(s, d).invoke("compareModels", candidates=["linear", "quadratic", "poly3"])
    return s.createDataFrame([(r["model"], r["parameters"], round(r["r_squared"], 8), round(r["rmse"], 3)) for r in rows], "model string, parameters int, r_squared double, rmse double").where("model = 'linear'")


def _q_compare_all(s, d):
    rows = _service(s, d).invoke("compareModels", candidates=["linear", "quadratic", "poly3"])
    return s.createDataFrame([(k, r["model"], r["parameters"], r["score"]) for k, r in enumerate(rows)], "rank int, model string, parameters int, score double")


def _q_catalogue(s, d):
    return Service(s).catalogue().select("name", "category", F.size("params").alias("params"))


def _q_trace(s, d):
    e = _service(s, d)
    e.invoke("fitModel", modelName="m", model="quadratic")
    try:
        e.invoke("fitModel", modelName="x", model="nonsense")
    except ValueError:
        pass
    return e.trace().select("k", "command", "ok")


def _q_fit_predict(s, d):
    e = _service(s, d)
    e.invoke("fitModel", modelName="m", model="quadratic")
    return e.invoke("predict", modelName="m", df=s.range(21).select("id", (F.col("id") / 20).alias("q"), F.lit(0.05).alias("l_discount")), interval="confidence").select("id", "mean", "lower", "upper")


QUERIES = {"compare_models_linear": _q_compare, "compare_models": _q_compare_all, "command_catalogue": _q_catalogue, "trace_events": _q_trace, "service_fit_predict": _q_fit_predict}
SQL = {
    "compare_models_linear": "WITH m AS (SELECT count(*) AS n, var_pop(l_quantity / 50) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity / 50, l_discount) AS qd, covar_pop(l_quantity / 50, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy, var_pop(l_extendedprice) AS yy FROM lineitem), b AS (SELECT *, (qy * dd - dy * qd) / (qq * dd - qd * qd) AS b1, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS b2 FROM m) SELECT 'linear' AS model, 3::INTEGER AS parameters, round((b1 * qy + b2 * dy) / yy, 8) AS r_squared, round(sqrt(yy - b1 * qy - b2 * dy), 3) AS rmse FROM b",
    "trace_events": "SELECT * FROM (VALUES (0::BIGINT, 'setData', true), (1::BIGINT, 'fitModel', true), (2::BIGINT, 'fitModel', false)) t(k, command, ok)",
}
