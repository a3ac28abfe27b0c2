"""Text to typed values: numbers, lists, literals, lenient JSON, nested paths, unit-aware arguments, energy to temperature."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlake.functions.scalars import convert, values_and_unit
from gramlake.session import table

#: Month names, in order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def from_iso(text: Column) -> Column:
    """A time in ISO 8601; null for other text."""
    return text.try_cast("timestamp")


def named_month_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", cut: bool = False) -> Column:
    """Time of a text whose month may be an English short name; cut drops the last four characters first."""
    for k, name in enumerate(MONTHS):
        text = F.replace(text, F.lit(name), F.lit(f"{k + 1:02d}"))
    if cut:
        text = F.left(text, F.greatest(F.length(text) - 4, F.lit(0)))
    return F.try_to_timestamp(text, F.lit(pattern))


def number(text: Column) -> Column:
    """struct(kind, whole, real, text): float with a point in it, else int, else the text as it is."""
    trimmed = F.trim(text)
    real = F.when(F.contains(text, F.lit(".")) & trimmed.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    whole = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("long"))
    kind = F.when(real.isNotNull(), "float").when(whole.isNotNull(), "int").when(text.isNotNull(), "text")
    return F.struct(kind.alias("kind"), whole.alias("whole"), real.alias("real"), text.alias("text"))


def parse_list(text: Column) -> Column:
    """The parts of a text between commas, each as `number` gives it."""
    return F.transform(F.split(text, ","), number)


def typed_map(m: Column) -> Column:
    """Values of a map<string,string> as struct(number, values, unit): `1 2[mm]` has values and a unit."""

    def one(_: Column, v: Column) -> Column:
        held = values_and_unit(v)
        return F.struct(number(v).alias("number"), held["values"].alias("values"), held["unit"].alias("unit"))

    return F.transform_values(m, one)


def sanitized(text: Column) -> Column:
    """JSON out of its loose forms: doubled quotes halved unless they are an empty value, None and null empty, ' as ", True and False lower."""
    text = F.regexp_replace(text, r'""(?!"?[},])', '"')
    text = F.translate(F.regexp_replace(text, "None|null", '""'), "'", '"')
    return F.replace(F.replace(text, F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false"))


def literal(text: Column) -> Column:
    """A list, tuple, map or scalar literal as VARIANT; null for other text, and for strings that hold quotes."""
    text = F.translate(text, "'", '"')
    for name, value in (("True", "true"), ("False", "false"), ("None", "null")):
        text = F.regexp_replace(text, rf'(?<![\w"]){name}(?![\w"])', value)
    text = F.regexp_replace(F.regexp_replace(text, r"^\s*\(", "["), r",?\s*\)\s*$", "]")
    return F.try_parse_json(text)


def at_path(text: Column, path: str) -> Column:
    """Value at a/b/c of a JSON text, as text; null where there is none."""
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path.strip("/").split("/")))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def leaves(text: pd.Series) -> pd.Series:
    """(path, value) of every leaf of a JSON text, paths with slashes; null for other text."""

    def walk(x, path: str, out: dict) -> dict:
        if isinstance(x, (dict, list)) and x:
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                walk(v, f"{path}/{k}" if path else str(k), out)
        elif path:
            out[path] = x if isinstance(x, str) else json.dumps(x)
        return out

    def one(t):
        try:
            return walk(json.loads(t), "", {})
        except (TypeError, ValueError):
            return None

    return text.map(one)


def search(text: Column, glob: str) -> Column:
    """map of the leaves whose path fits a glob: * is within a step, ** is any number of steps."""
    parts = [r".*" if p == "**" else re.escape(p).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for p in glob.strip("/").split("/")]
    pattern = "^" + "/".join(parts).replace("/.*", "(?:/.*)?").replace(".*/", "(?:.*/)?") + "$"
    return F.map_filter(leaves(text), lambda k, _: k.rlike(pattern))


def unflattened(df: DataFrame, names: Sequence[str], alias: str = "nested") -> Column:
    """A nested struct of columns with dotted names: the inverse of flattening."""
    tree: dict = {}
    for n in names:
        *path, last = n.split(".")
        here = tree
        for p in path:
            here = here.setdefault(p, {})
        here[last] = F.col(f"`{n}`")
    build = lambda t: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
    return build(tree).alias(alias)


def put(column: Column, path: str, value: Column) -> Column:
    """A struct with the field at a/b/c set; steps above the last must be there."""
    return column.withField(".".join(f"`{p}`" for p in path.strip("/").split("/")), value)


def with_units(**units: str) -> Callable:
    """Decorator: keyword arguments (Columns) named in units are converted by "from->to" before the call."""
    pairs = {k: [u.strip() for u in v.split("->")] for k, v in units.items()}

    def wrap(f: Callable[..., Column]) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*args: Column, **kw: Column) -> Column:
            return f(*args, **{k: convert(v, *pairs[k]) if k in pairs else v for k, v in kw.items()})

        return call

    return wrap


def temperature_of(energy: Column, cp: Sequence[tuple[float, float]]) -> Column:
    """T at which the integral of cp from its first temperature is energy: the root of one quadratic in the segment that holds it."""
    ends = [0.0]
    for (ta, ca), (tb, cb) in zip(cp, cp[1:], strict=False):
        ends.append(ends[-1] + (tb - ta) * (ca + cb) / 2)
    out = F.lit(float(cp[-1][0])) + (energy - ends[-1]) / F.lit(float(cp[-1][1]))
    for k in reversed(range(len(cp) - 1)):
        (ta, ca), (tb, cb) = cp[k], cp[k + 1]
        slope, rest = (cb - ca) / (tb - ta), energy - ends[k]
        # the form without cancellation, which also holds at slope 0
        root = F.lit(float(ta)) + 2 * rest / (ca + F.sqrt(F.greatest(ca * ca + 2 * slope * rest, F.lit(0.0))))
        out = F.when(energy <= ends[k + 1], root).otherwise(out)
    return F.when(energy <= 0, F.lit(float(cp[0][0])) + energy / F.lit(float(cp[0][1]))).otherwise(out)


# queries


def _q_iso(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("o_orderdate", "yyyy-MMM-dd HH:mm:ss").alias("named"))
    return o.select("o_orderkey", from_iso(F.concat("iso", F.lit("Z"))).cast("timestamp_ntz").alias("iso"), named_month_time(F.concat("named", F.lit("_tag")), cut=True).cast("timestamp_ntz").alias("named"))


def _q_list(s, d):
    t = F.concat(F.col("p_size").cast("string"), F.lit(",2.5,"), F.col("p_brand"))
    p = table(s, d, "part").select("p_partkey", F.posexplode(parse_list(t)).alias("place", "x"))
    return p.select("p_partkey", "place", "x.kind", "x.whole", "x.real", "x.text")


def _q_typed(s, d):
    m = F.create_map(F.lit("size"), F.concat("p_size", F.lit(" 4[mm]")), F.lit("price"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    t = typed_map(m)
    return table(s, d, "part").select("p_partkey", t["size"]["unit"].alias("unit"), t["size"]["values"][1].alias("second"), t["price"]["number"]["real"].alias("price"))


def _q_sanitize(s, d):
    loose = F.concat(F.lit("{'user': ''"), F.lit(", 'n': "), F.col("user_id").cast("string"), F.lit(", 'ok': True, 'none': None, 'kind': '"), F.col("event_type"), F.lit("'}"))
    clean = sanitized(F.replace(loose, F.lit("''"), F.lit("'-'")))
    lit = literal(F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", 'a', False, None]")))
    return table(s, d, "events").select("event_id", clean.alias("json"), F.get_json_object(clean, "$.n").cast("long").alias("n"), F.try_variant_get(lit, "$[0]", "long").alias("first"), F.try_variant_get(lit, "$[2]", "boolean").alias("third"))


def _q_paths(s, d):
    j = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit(', "c": [1, {"k": 2}]}}'))
    e = table(s, d, "events").where("props IS NOT NULL").select("event_id", j.alias("j"))
    return e.select("event_id", at_path(F.col("j"), "a/b/k").cast("long").alias("k"), F.explode(search(F.col("j"), "a/**/k")).alias("path", "value"))


def _q_nested(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("meta.status"), F.col("o_orderpriority").alias("meta.deep.priority"))
    o = o.select("o_orderkey", unflattened(o, o.columns[1:]))
    o = o.withColumn("nested", put(F.col("nested"), "meta/deep/extra", F.col("o_orderkey") * 2))
    return o.select("o_orderkey", F.col("nested.meta.status").alias("status"), F.col("nested.meta.deep.priority").alias("priority"), F.col("nested.meta.deep.extra").alias("extra"))


@with_units(p="psi->kPa", t="degC->K")
def _gas(p: Column, t: Column) -> Column:
    return p / t


def _q_decorated(s, d):
    return table(s, d, "part").select("p_partkey", F.round(_gas(p=F.col("p_retailprice"), t=F.col("p_size").cast("double")), 9).alias("ratio"))


_CP = ((300.0, 1000.0), (800.0, 1500.0), (2000.0, 1800.0))


def _q_inverse(s, d):
    t = s.range(60).select("id", (F.col("id") * 50.0 - 100).alias("t"))
    from gramlake.operators.mesh import heat_energy

    return t.select("id", F.round(temperature_of(heat_energy(F.col("t"), _CP), _CP), 6).alias("t"))


QUERIES = {"iso_and_named_months": _q_iso, "parse_list": _q_list, "typed_map": _q_typed, "json_sanitize": _q_sanitize, "path_search": _q_paths, "unflatten_put": _q_nested, "unit_arguments": _q_decorated, "material_inverse": _q_inverse}
SQL = {
    "iso_and_named_months": "SELECT o_orderkey, date_trunc('second', o_orderdate)::TIMESTAMP AS iso, date_trunc('second', o_orderdate)::TIMESTAMP AS named FROM orders",
    "parse_list": "SELECT p_partkey, 0::INTEGER AS place, 'int' AS kind, p_size::BIGINT AS whole, NULL::DOUBLE AS real, p_size::VARCHAR AS text FROM part UNION ALL SELECT p_partkey, 1, 'float', NULL, 2.5, '2.5' FROM part UNION ALL SELECT p_partkey, 2, 'text', NULL, NULL, p_brand FROM part",
    "typed_map": "SELECT p_partkey, 'mm' AS unit, 4.0::DOUBLE AS second, round(p_retailprice, 2) AS price FROM part",
    "json_sanitize": """SELECT event_id, '{"user": "-", "n": ' || user_id || ', "ok": true, "none": "", "kind": "' || event_type || '"}' AS json, user_id AS n, user_id AS first, false AS third FROM events""",
    "path_search": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, unnest(['a/b/k', 'a/c/1/k']) AS path, unnest([json_extract_string(props, '$.k'), '2']) AS value FROM events WHERE props IS NOT NULL",
    "unflatten_put": "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey * 2 AS extra FROM orders",
    "unit_arguments": "SELECT p_partkey, round(p_retailprice * 6.894757293168361 / (p_size + 273.15), 9) AS ratio FROM part",
    "material_inverse": "SELECT i AS id, round(i * 50.0 - 100, 6)::DOUBLE AS t FROM range(60) t(i)",
}
