"""Scalar functions as Column expressions: dates, paths, units, text with values and units, nested data, safe formulas."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.session import table

# dates; a time without a zone is UTC


def utc(ts: Column) -> Column:
    return ts.cast("timestamp")


def jst(ts: Column) -> Column:
    """Wall-clock time in Japan, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), ts.cast("timestamp_ntz"))


def unix_seconds(ts: Column) -> Column:
    return F.unix_micros(utc(ts)) / 1e6


def from_unix_seconds(x: Column) -> Column:
    return F.timestamp_micros(F.round(x * 1_000_000).cast("long"))


def julian_date(ts: Column) -> Column:
    return F.unix_micros(utc(ts)) / 86_400e6 + 2_440_587.5


def from_julian_date(j: Column) -> Column:
    return F.timestamp_micros(F.floor((j - 2_440_587.5) * 86_400).cast("long") * 1_000_000)


def iso(ts: Column) -> Column:
    return F.date_format(utc(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_time(text: Column) -> Column:
    """The longest of the known formats that fits; null if none does."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy_MM_dd_HH_mm_ss", "d MMM yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy_MM_dd"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def directory_time(name: Column) -> Column:
    """Time of YYYY_MM_DD[_HH_MM_SS][_label]; the long form is tried first."""
    stamp = F.regexp_extract(name, r"^(\d{4}_\d{2}_\d{2}(?:_\d{2}_\d{2}_\d{2})?)(?:_|$)", 1)
    return F.when(F.length(stamp) == 19, F.try_to_timestamp(stamp, F.lit("yyyy_MM_dd_HH_mm_ss"))).when(F.length(stamp) == 10, F.try_to_timestamp(stamp, F.lit("yyyy_MM_dd")))


def directory_kind(name: Column) -> Column:
    return F.when(name.rlike(r"^\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}"), "YMDHMS").when(name.rlike(r"^\d{4}_\d{2}_\d{2}"), "YMD").otherwise("None")


# paths


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_base(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$"), F.lit(False))


# units: factor to the base unit of a quantity, and offset

#: Quantity -> unit -> (factor, offset).
UNITS = {
    "length": {"m": (1, 0), "mm": (1e-3, 0), "cm": (1e-2, 0), "km": (1e3, 0), "in": (0.0254, 0), "ft": (0.3048, 0)},
    "mass": {"kg": (1, 0), "g": (1e-3, 0), "mg": (1e-6, 0), "t": (1e3, 0), "lb": (0.45359237, 0)},
    "time": {"s": (1, 0), "ms": (1e-3, 0), "min": (60, 0), "h": (3600, 0), "day": (86400, 0)},
    "pressure": {"Pa": (1, 0), "kPa": (1e3, 0), "MPa": (1e6, 0), "bar": (1e5, 0), "atm": (101325, 0), "psi": (6894.757293168361, 0)},
    "temperature": {"K": (1, 0), "degC": (1, 273.15), "C": (1, 273.15), "degF": (5 / 9, 459.67 * 5 / 9), "F": (5 / 9, 459.67 * 5 / 9), "R": (5 / 9, 0)},
    "current": {"A": (1, 0), "mA": (1e-3, 0)},
    "density": {"kg/m^3": (1, 0), "g/cm^3": (1e3, 0)},
    "angular rate": {"rad/s": (1, 0), "rpm": (math.pi / 30, 0), "Hz": (2 * math.pi, 0)},
    "force": {"N": (1, 0), "kN": (1e3, 0), "lbf": (4.4482216152605, 0)},
    "power": {"W": (1, 0), "kW": (1e3, 0), "MW": (1e6, 0), "hp": (745.6998715822702, 0)},
}


def quantity(unit: str) -> str | None:
    """The quantity class of a unit."""
    return next((q for q, units in UNITS.items() if unit in units), None)


def units_of(kind: str) -> list[str]:
    return sorted(UNITS[kind])


def convert(x: Column, source: str, target: str) -> Column:
    """x in target units; units of different quantities do not convert."""
    kind = quantity(source)
    if kind is None or quantity(target) != kind:
        raise ValueError(f"cannot convert {source} to {target}")
    (f, a), (g, b) = UNITS[kind][source], UNITS[kind][target]
    return (x * F.lit(float(f)) + F.lit(float(a - b))) / F.lit(float(g))


# text with values


def number_type(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), "int").when(text.try_cast("double").isNotNull(), "float")


def is_bool(text: Column) -> Column:
    return F.coalesce(text.isin("True", "False", "true", "false"), F.lit(False))


def has_unit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*\d+(\.\d+)?([ ,]+\d+(\.\d+)?)*\s*\[[^\]]*\]\s*$"), F.lit(False))


def values_and_unit(text: Column) -> Column:
    """struct(values array<double>, unit) of `1 2,3.5[unit]`, null for other text."""
    parts = F.filter(F.split(F.regexp_extract(text, r"^([^\[]*)\[", 1), r"[ ,]+"), lambda x: F.length(x) > 0)
    return F.when(has_unit(text), F.struct(F.transform(parts, lambda x: x.cast("double")).alias("values"), F.regexp_extract(text, r"\[([^\]]*)\]", 1).alias("unit")))


def first_number(text: Column) -> Column:
    """The first number in a text; of a range `300-1800` its start."""
    return F.regexp_extract(text, r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def variable_name(text: Column) -> Column:
    """Name for matching: camel case split, separators out, lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), r"[\s_\-./]+", "")


def key_values(text: Column) -> Column:
    """map of k=value pairs; a value may be quoted."""
    found = F.regexp_extract_all(text, F.lit(r"""([A-Za-z_]\w*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s,&]+))"""))
    return F.map_from_entries(F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"=(.*)$", 1)), r"""^["']|["']$""", "").alias("v"))))


def args_text(m: Column) -> Column:
    """k="v"&... of a map, in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), "&")


# nested data


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def extract_json(text: Column) -> Column:
    """The first balanced {...} of a text that holds at most three levels, if it is valid JSON; braces in strings count as text."""
    string = r'"(?:[^"\\]|\\.)*"'
    level = r"\{(?:[^{}\"]|" + string + r")*\}"
    for _ in range(2):
        level = r"\{(?:[^{}\"]|" + string + "|" + level + r")*\}"
    found = F.regexp_extract(text, "(" + level + ")", 1)
    return F.when(is_json(found) & (F.length(found) > 0), found)


def flatten(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, path, value) rows of the leaves of a struct column, with dotted paths: a fixed, planned projection."""
    from pyspark.sql.types import StructType

    leaves: list[tuple[str, Column]] = []

    def walk(kind, path: str, col: Column) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, StructType):
                walk(f.dataType, f"{path}{f.name}.", col[f.name])
            else:
                leaves.append((f"{path}{f.name}", col[f.name]))

    walk(df.schema[column].dataType, "", F.col(column))
    rows = F.array(*[F.struct(F.lit(p).alias("path"), c.cast("string").alias("value")) for p, c in leaves])
    return df.select(key, F.inline(rows))


def flat_json(text: Column) -> Column:
    """map of the top level of a JSON object, values as text."""
    return F.from_json(text, "map<string,string>")


def text_format(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*\{") & is_json(text), "stringJson").when(text.rlike(r"^\s*<[^>]+>[\s\S]*>\s*$"), "stringXml").otherwise("Unknown format")


def numeric_tags(xml: Column) -> Column:
    """<12> to <item12>, so that the text is XML."""
    return F.regexp_replace(xml, r"<(/?)(\d)", "<$1item$2")


# formulas


_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "exp": F.exp, "expm1": F.expm1, "log": F.log, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "sqrt": F.sqrt, "cbrt": F.cbrt, "abs": F.abs, "sign": F.signum,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arctan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "minimum": F.least, "maximum": F.greatest, "power": F.pow, "heaviside": lambda x, h: F.when(x < 0, 0.0).when(x > 0, 1.0).otherwise(h),
}


def formula(text: str, **columns: Column) -> Column:
    """An arithmetic text as a Column: numbers, the given names, pi, e, + - * / ** and a fixed list of functions; nothing else."""

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id in columns:
                return columns[n.id].cast("double")
            if n.id in ("pi", "e"):
                return F.lit(getattr(math, n.id))
            raise ValueError(f"unknown name {n.id}")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: F.try_divide(a, b)), (ast.Pow, lambda: F.pow(a, b))):
                if isinstance(n.op, kind):
                    return f()
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _FUNCTIONS and not n.keywords:
            return _FUNCTIONS[n.func.id](*map(walk, n.args))
        raise ValueError(f"not allowed in a formula: {ast.dump(n)[:60]}")

    return walk(ast.parse(text, mode="eval"))


# queries


def _q_dates(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.round(julian_date(F.col("ts")), 9).alias("julian"), jst(F.col("ts")).alias("jst"), F.round(unix_seconds(F.col("ts")), 6).alias("unix"), iso(F.col("ts")).alias("iso"))


def _q_back(s, d):
    e = table(s, d, "events")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    # whole seconds come back from a Julian date, whose double precision holds some 40 microseconds
    near = F.abs(micros(from_julian_date(julian_date(F.col("ts")))) - micros(F.col("ts"))) < 1_000_100
    return e.select("event_id", from_unix_seconds(unix_seconds(F.col("ts"))).cast("timestamp_ntz").alias("ts"), near.alias("near"))


def _names(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy_MM_dd")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit("_07_30_15_run"))).otherwise(F.concat(F.lit("run_"), F.col("o_orderkey"))).alias("dir"))


def _q_dirs(s, d):
    return _names(s, d).select("o_orderkey", directory_time(F.col("dir")).cast("timestamp_ntz").alias("t"), directory_kind(F.col("dir")).alias("kind"))


def _q_paths(s, d):
    p = table(s, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("u"))
    return p.select("page_id", extension(F.col("u")).alias("ext"), file_name(F.col("u")).alias("name"), file_base(F.col("u")).alias("base"), is_url(F.col("u")).alias("is_url"))


def _q_units(s, d):
    return table(s, d, "part").select("p_partkey", F.round(convert(F.col("p_size").cast("double"), "mm", "in"), 9).alias("size_in"), F.round(convert(F.col("p_size").cast("double"), "degC", "degF"), 9).alias("f"), F.round(convert(F.col("p_retailprice"), "psi", "kPa"), 6).alias("kpa"))


def _texts(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey") % 5
    return p.select("p_partkey", F.when(k == 0, F.concat("p_size", F.lit(" 2,3.5[mm]"))).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.concat("p_size", F.lit(".25"))).when(k == 3, F.lit("true")).otherwise(F.col("p_name")).alias("t"))


def _q_values(s, d):
    t = F.col("t")
    v = values_and_unit(t)
    return _texts(s, d).select("p_partkey", number_type(t).alias("type"), is_bool(t).alias("is_bool"), has_unit(t).alias("has_unit"), v["unit"].alias("unit"), F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x).alias("total"), first_number(t).alias("first"))


def _q_names(s, d):
    return table(s, d, "customer").select("c_custkey", variable_name(F.concat(F.lit("inletTemp_"), F.col("c_mktsegment"), F.lit(".max-K"))).alias("name"))


def _q_json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), is_json(F.col("props")).alias("valid"), text_format(F.col("props")).alias("format"), F.variant_get(F.try_parse_json("props"), "$.k", "int").alias("via_variant"))


def _q_extract(s, d):
    e = table(s, d, "events").select("event_id", F.concat(F.lit("note: "), F.col("props"), F.lit(" and {not json")).alias("t"))
    return e.select("event_id", extract_json(F.col("t")).alias("json"))


def _q_flatten(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority")).alias("deep")).alias("meta"), F.col("o_custkey").alias("cust")).alias("doc"))
    return flatten(o, "doc", "o_orderkey")


def _q_args(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("cust"), F.col("o_custkey").cast("string")).alias("m"))
    return o.select("o_orderkey", args_text(F.col("m")).alias("args"))


def _q_kv(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("status="), F.col("o_orderstatus"), F.lit(' priority="'), F.col("o_orderpriority"), F.lit('" n = 3')).alias("t"))
    m = key_values(F.col("t"))
    return o.select("o_orderkey", m["status"].alias("status"), m["priority"].alias("priority"), m["n"].alias("n"))


def _q_formula(s, d):
    c = {"q": F.col("l_quantity"), "p": F.col("l_extendedprice"), "r": F.col("l_discount")}
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(formula("sqrt(p) * exp(-r) + log1p(q ** 2) / maximum(q, 10) - cos(pi * r)", **c), 6).alias("v"))


def _q_xpath(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.xpath_string(F.concat(F.lit("<r><a k='"), F.col("page_id"), F.lit("'>x</a></r>")), F.lit("r/a/@k")).alias("attr"), numeric_tags(F.concat(F.lit("<"), F.col("page_id"), F.lit(">"))).alias("tag"))


QUERIES = {
    "date_functions": _q_dates, "date_round_trip": _q_back, "directory_dates": _q_dirs, "path_parts": _q_paths, "unit_convert": _q_units, "value_unit_parse": _q_values, "varname_normalize": _q_names,
    "json_path": _q_json, "json_extract": _q_extract, "flatten_struct": _q_flatten, "args_text": _q_args, "key_value_parse": _q_kv, "safe_formula": _q_formula, "xpath_text": _q_xpath,
}
SQL = {
    "date_round_trip": "SELECT event_id, ts, true AS near FROM events",

    "date_functions": "SELECT event_id, round(epoch_us(ts) / 86400e6 + 2440587.5, 9) AS julian, ts + INTERVAL 9 HOUR AS jst, round(epoch_us(ts) / 1e6, 6) AS unix, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events",
    "directory_dates": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL '7 hours 30 minutes 15 seconds' END::TIMESTAMP AS t, CASE o_orderkey % 3 WHEN 0 THEN 'YMD' WHEN 1 THEN 'YMDHMS' ELSE 'None' END AS kind FROM orders",
    "path_parts": r"WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages), n AS (SELECT *, regexp_extract(u, '([^/]*)$', 1) AS name FROM p) SELECT page_id, lower(regexp_extract(u, '\.([^./]*)$', 1)) AS ext, name, regexp_replace(name, '\.[^.]*$', '') AS base, regexp_full_match(u, '[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*') AS is_url FROM n",
    "unit_convert": "SELECT p_partkey, round(p_size * 0.001 / 0.0254, 9) AS size_in, round(p_size * 1.8 + 32, 9) AS f, round(p_retailprice * 6.894757293168361, 6) AS kpa FROM part",
    "value_unit_parse": "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'int' WHEN 2 THEN 'float' END AS type, p_partkey % 5 = 3 AS is_bool, p_partkey % 5 = 0 AS has_unit, CASE WHEN p_partkey % 5 = 0 THEN 'mm' END AS unit, CASE WHEN p_partkey % 5 = 0 THEN p_size + 5.5::DOUBLE END AS total, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size + 0.25::DOUBLE WHEN 4 THEN try_cast(regexp_extract(p_name, '([+-]?\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) END AS first FROM part".replace("\\\\", "\\"),
    "varname_normalize": "SELECT c_custkey, 'inlettemp' || lower(c_mktsegment) || 'maxk' AS name FROM customer",
    "json_path": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_valid(props) AS valid, 'stringJson' AS format, json_extract_string(props, '$.k')::INTEGER AS via_variant FROM events",
    "json_extract": "SELECT event_id, props AS json FROM events",
    "flatten_struct": "SELECT o_orderkey, 'meta.status' AS path, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'meta.deep.priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'cust', o_custkey::VARCHAR FROM orders",
    "args_text": "SELECT o_orderkey, 'cust=\"' || o_custkey || '\"&status=\"' || o_orderstatus || '\"' AS args FROM orders",
    "key_value_parse": "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, '3' AS n FROM orders",
    "safe_formula": "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice) * exp(-l_discount) + ln(1 + l_quantity * l_quantity) / greatest(l_quantity, 10) - cos(pi() * l_discount), 6) AS v FROM lineitem",
}
