"""Commands by name: a catalogue table, calls with checked arguments, sweeps, and a trace of every call as rows."""

from __future__ import annotations

import inspect
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

EVENT = "job string, k long, command string, started double, seconds double, ok boolean, args string, result string, error string"


def command(name: str, category: str, requires: dict | None = None, effect: dict | None = None) -> Callable:
    """Mark a method as a command; requires and effect are conditions on, and changes of, the engine's state."""

    def mark(f: Callable) -> Callable:
        f._command = {"name": name, "category": category, "requires": requires or {}, "effect": effect or {}}
        return f

    return mark


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def json_able(v: object) -> object:
    """NaN as null, infinities as text, frames as their schema."""
    if isinstance(v, float):
        return None if v != v else v if abs(v) != float("inf") else "inf" if v > 0 else "-inf"
    if isinstance(v, dict):
        return {str(k): json_able(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_able(x) for x in v]
    if isinstance(v, DataFrame):
        return v.schema.simpleString()
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


@dataclass
class Engine:
    """Holder of commands, state and trace. Subclasses add methods marked with @command."""

    spark: SparkSession
    state: dict = field(default_factory=dict)
    events: list[tuple] = field(default_factory=list)

    def _commands(self) -> dict[str, Callable]:
        found = (m for _, m in inspect.getmembers(self, callable) if hasattr(m, "_command"))
        return {m._command["name"]: m for m in found}

    def catalogue(self) -> DataFrame:
        """(name, category, description, params), by category and name."""
        rows = [(n, m._command["category"], (inspect.getdoc(m) or "").split("\n")[0], [p for p in inspect.signature(m).parameters]) for n, m in self._commands().items()]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0])), "name string, category string, description string, params array<string>")

    def applicable(self) -> list[str]:
        """Commands whose conditions the state meets."""
        return sorted(n for n, m in self._commands().items() if all(self.state.get(k) == v for k, v in m._command["requires"].items()))

    def invoke(self, name: str, job: str | None = None, **kw: object) -> object:
        """Call a command; argument names may be in camel case. Success or failure becomes an event; errors are raised again."""
        commands = self._commands()
        if name not in commands:
            raise KeyError(f"unknown command {name}; there are {sorted(commands)}")
        call = commands[name]
        names = inspect.signature(call).parameters
        args = {k if k in names else snake(k): v for k, v in kw.items()}
        job, began, result, error = job or uuid.uuid4().hex, time.time(), None, None
        try:
            result = call(**args)
            self.state.update({k: v for k, v in call._command["effect"].items() if v is not None})
            return result
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            self.events.append((job, len(self.events), name, began, time.time() - began, error is None, json.dumps(json_able(args)), json.dumps(json_able(result)), error))

    def sweep(self, name: str, each: Sequence[dict], workers: int = 4) -> list[tuple[object, str | None]]:
        """Results, or errors, of one command over several arguments, in their order; jobs share the session."""

        def one(kw: dict) -> tuple[object, str | None]:
            try:
                return self.invoke(name, **kw), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(one, each))

    def flow(self, steps: Sequence[tuple[str, dict, dict[str, str]]]) -> object:
        """Commands in turn: (name, arguments, argument taken from the last result by key)."""
        last: object = {}
        for name, kw, take in steps:
            last = self.invoke(name, **kw, **{k: last[v] for k, v in take.items()})
        return last

    def trace(self) -> DataFrame:
        return self.spark.createDataFrame(self.events, EVENT)
