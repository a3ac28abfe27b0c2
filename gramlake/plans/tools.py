"""Around the command engine: tokens, settings, a registry of services, chains from JSON, sweeps on executors, events in a common
form, and a line interpreter."""

from __future__ import annotations

import hmac
import inspect
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions.records import key_values, map_paths, settings
from gramlake.plans.registry import Engine, command, json_able


def no_token(f: Callable) -> Callable:
    """Mark a command that a secured engine runs without a token."""
    f._open = True
    return f


@dataclass
class Secured(Engine):
    """An engine whose commands need a token, but for those marked `no_token`. Without a token of its own all are open."""

    token: str | None = None

    def verify(self, token: str | None) -> None:
        if self.token is not None and not hmac.compare_digest((token or "").encode(), self.token.encode()):
            raise PermissionError("wrong token")

    def invoke(self, name: str, job: str | None = None, token: str | None = None, **kw: object) -> object:
        call = self._commands().get(name)
        if call is not None and not getattr(call, "_open", False):
            self.verify(token)
        return super().invoke(name, job, **kw)

    def begin_job(self, name: str) -> str:
        """An id for the calls that belong together, and an event that opens it."""
        job = f"{name}-{len(self.events):06d}"
        self.events.append((job, len(self.events), "begin", 0.0, 0.0, True, "{}", "null", None))
        return job


def runtime_events(engine: Engine, run: str, trace: str) -> DataFrame:
    """The trace as runtime events: (version, run, trace, sequence, type, name, payload)."""
    kind = F.when(F.col("ok"), "command.completed").otherwise("command.failed")
    payload = F.to_json(F.struct("args", "result", "error", "seconds"))
    return engine.trace().select(F.lit("runtime-event.v1").alias("version"), F.lit(run).alias("run"), F.lit(trace).alias("trace"), F.col("k").alias("sequence"), kind.alias("type"), F.col("command").alias("name"), payload.alias("payload"))


def snapshot(engines: Iterable[Engine]) -> list[tuple[str, str]]:
    """(class, command) of the attached engines, each once."""
    return sorted({(type(e).__name__, n) for e in engines for n in e._commands()})


def tool_schemas(engine: Engine) -> list[dict]:
    """The commands as JSON tool descriptions: name, description, parameters with their types."""
    kinds = {int: "integer", float: "number", bool: "boolean", str: "string", list: "array", dict: "object"}
    out = []
    for name, m in sorted(engine._commands().items()):
        parameters = inspect.signature(m, eval_str=True).parameters
        origin = lambda t: getattr(t, "__origin__", t)
        props = {k: {"type": kinds.get(origin(p.annotation), "string")} for k, p in parameters.items()}
        out.append({"name": name, "description": (inspect.getdoc(m) or "").split("\n")[0], "parameters": {"type": "object", "properties": props, "required": [k for k, p in parameters.items() if p.default is p.empty]}})
    return out


def chain(engine: Engine, config: str | dict) -> list[object]:
    """Steps of a JSON chain {steps: [{command, args, map: {argument: path in the last result}}]}; the results in turn."""
    steps = (json.loads(config) if isinstance(config, str) else config)["steps"]
    results: list[object] = []
    for s in steps:
        args = dict(s.get("args", {}))
        if s.get("map"):
            args = map_paths(json_able(results[-1]), args, s["map"])
        results.append(engine.invoke(s["command"], **args))
    return results


def executor_sweep(spark: SparkSession, f: Callable[..., object], params: Sequence[dict]) -> DataFrame:
    """(k, result, error): a pure function of keyword arguments over parameter sets, one task each, results as JSON; a failure
    is a row, not the end of the job."""
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(params)], "k long, p string").repartitionById(max(len(params), 1), F.col("k").cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b["k"], b["p"], strict=True):
                try:
                    out.append((k, json.dumps(json_able(f(**json.loads(p)))), None))
                except Exception as e:
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["k", "result", "error"])

    return rows.mapInPandas(run, "k long, result string, error string")


@dataclass
class Settings:
    """Values with defaults and types: what a service lets its caller change."""

    spec: dict[str, object]
    values: dict[str, object] = field(default_factory=dict)

    def get(self, name: str) -> object:
        if name not in self.spec:
            raise KeyError(f"no setting {name}; there are {sorted(self.spec)}")
        return self.values.get(name, self.spec[name])

    def set(self, name: str, value: object) -> None:
        held = self.get(name)
        if held is not None and not isinstance(value, type(held)) and not (isinstance(held, float) and isinstance(value, int)):
            raise TypeError(f"{name} is {type(held).__name__}")
        self.values[name] = value

    def all(self, prefix: str | None = None, overrides: dict | None = None) -> dict:
        return settings(self.spec, prefix, self.values, overrides)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.values, f)

    def load(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            for k, v in json.load(f).items():
                self.set(k, v)


SERVICES: dict[str, type[Engine]] = {}


def service(name: str) -> Callable[[type[Engine]], type[Engine]]:
    """Register an engine class."""

    def mark(cls: type[Engine]) -> type[Engine]:
        SERVICES[name] = cls
        return cls

    return mark


def collect_all(include: Sequence[str] | None = None, exclude: Sequence[str] = (), packages: Sequence[str] | None = None, without: Sequence[str] = ()) -> dict[str, type[Engine]]:
    """Registered services by name and by the package that defines them."""
    fits = lambda m, parts: any(m == p or m.startswith(p + ".") for p in parts)
    return {n: c for n, c in sorted(SERVICES.items()) if (include is None or n in include) and n not in exclude and (packages is None or fits(c.__module__, packages)) and not fits(c.__module__, without)}


def interpret(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """One answer a line: `help`, `applicable`, or a command with key=value arguments; `quit` ends."""
    for line in lines:
        name, _, rest = line.strip().partition(" ")
        if not name or name.startswith("#"):
            continue
        if name in ("quit", "exit"):
            return
        try:
            result = sorted(engine._commands()) if name == "help" else engine.applicable() if name == "applicable" else engine.invoke(name, **key_values(rest))
            yield json.dumps(json_able(result))
        except Exception as e:
            yield f"error: {type(e).__name__}: {e}"


@service("arithmetic")
@dataclass
class Arithmetic(Secured):
    """A small service: what the tests and the example query call."""

    @no_token
    @command("add", "math")
    def add(self, a: float, b: float = 1.0) -> dict:
        """The sum of two numbers."""
        return {"value": a + b}

    @command("half", "math")
    def half(self, value: float) -> dict:
        """Half of a number."""
        return {"value": value / 2}


# queries


def _q_sweep(s, d):
    def square(x: float) -> dict:
        if x < 0:
            raise ValueError("negative")
        return {"y": x * x}

    out = executor_sweep(s, square, [{"x": float(k)} for k in range(-1, 6)])
    return out.select("k", F.get_json_object("result", "$.y").cast("double").alias("y"), "error")


def _q_chain(s, d):
    e = Arithmetic(s)
    results = chain(e, json.dumps({"steps": [{"command": "add", "args": {"a": 3.0, "b": 5.0}}, {"command": "half", "map": {"value": "value"}}, {"command": "half", "map": {"value": "value"}}]}))
    events = runtime_events(e, "r", "t")
    return events.select("sequence", "type", "name").join(s.createDataFrame([(k, r["value"]) for k, r in enumerate(results)], "sequence long, value double"), "sequence")


QUERIES = {"executor_sweep": _q_sweep, "tool_chain": _q_chain}
SQL = {
    "executor_sweep": "SELECT (x + 1)::BIGINT AS k, CASE WHEN x >= 0 THEN (x * x)::DOUBLE END AS y, CASE WHEN x < 0 THEN 'ValueError: negative' END AS error FROM range(-1, 6) t(x)",
    "tool_chain": "SELECT * FROM (VALUES (0::BIGINT, 'command.completed', 'add', 8.0::DOUBLE), (1, 'command.completed', 'half', 4.0), (2, 'command.completed', 'half', 2.0)) t(sequence, type, name, value)",
}
