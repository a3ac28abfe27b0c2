"""Records as nested dictionaries, XML documents, documentation texts and small files: what the service reads its inputs with."""

from __future__ import annotations

import ast
import base64
import datetime as dt
import fnmatch
import hashlib
import json
import os
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.sources.formats import dict_to_xml, read_config, write_config, xml_to_dict

# unit-aware dictionaries: an item is {"data": value, "unit": text} or any other value


def typed(value: object) -> object:
    """Text as a number, a boolean or `value[unit]` where it reads as one; everything else as it is, dictionaries by item."""
    if isinstance(value, dict):
        return {k: typed(v) for k, v in value.items()}
    if not isinstance(value, str):
        return value
    m = re.fullmatch(r"\s*(.*?)\s*\[([^\[\]]*)\]\s*", value, re.S)
    if m and isinstance(typed(m[1]), (int, float)):
        return {"data": typed(m[1]), "unit": m[2]}
    if value.strip().lower() in ("true", "false"):
        return value.strip().lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def is_item(value: object) -> bool:
    return isinstance(value, dict) and set(value) == {"data", "unit"}


def plain(value: object) -> object:
    """Items without their units, at any depth."""
    if is_item(value):
        return value["data"]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def raw(value: object) -> object:
    """Items with a unit as the text `data[unit]`, at any depth; without one as their data."""
    if is_item(value):
        return f"{value['data']}[{value['unit']}]" if value["unit"] else value["data"]
    if isinstance(value, dict):
        return {k: raw(v) for k, v in value.items()}
    return [raw(v) for v in value] if isinstance(value, list) else value


def item(value: dict, path: str, separator: str = ".") -> object:
    """The item at a path, unit and all; KeyError where a step is missing."""
    for step in path.split(separator):
        value = value[int(step)] if isinstance(value, list) else value[step]
    return value


def as_list(value: object) -> list:
    """A dictionary (one record) as a list of one; lists stay."""
    return value if isinstance(value, list) else [value]


def by_key(records: Sequence[dict], key: str) -> dict:
    """{record[key]: the rest of the record}; a key that comes again keeps its last record."""
    return {r[key]: {k: v for k, v in r.items() if k != key} for r in records}


def map_paths(source: dict, target: dict, paths: dict[str, str], separator: str = ".") -> dict:
    """A copy of target with target[path] = source[from] for each {path: from}; missing sources raise KeyError."""
    out = json.loads(json.dumps(target))
    for to, at in paths.items():
        *heads, last = to.split(separator)
        here = out
        for h in heads:
            here = here.setdefault(h, {})
        here[last] = item(source, at, separator)
    return out


def table_of(value: dict) -> list[dict]:
    """{item0: {..}, item1: {..}} as records with `key`, the word item removed from it."""
    return [{"key": k.replace("item", ""), **v} for k, v in value.items()]


def file_item(value: dict) -> tuple[object, object, object]:
    """(@type, @path, @content) of a file item; absent ones are None."""
    return tuple(value.get(k) for k in ("@type", "@path", "@content"))


def externalise(value: dict, name: str, folder: str) -> dict:
    """value with the table at `name` (a list of records) written to folder as delimited text, its path in the table's place."""
    rows = value[name]
    path = os.path.join(folder, f"{name}.csv")
    pd.DataFrame(rows).to_csv(path, index=False)
    return value | {name: path}


def read_zipped_config(path: str, password: str | None = None, member: str | None = None) -> dict:
    """A configuration file in a zip archive, protected or not; what is unpacked is deleted."""
    with zipfile.ZipFile(path) as z:
        name = member or z.namelist()[0]
        folder = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
        out = z.extract(name, folder, pwd=password.encode() if password else None)
    try:
        return read_config(out)
    finally:
        os.remove(out)
        for top, _, _ in os.walk(folder, topdown=False):
            os.rmdir(top)


def settings(defaults: dict, prefix: str | None = None, stored: dict | None = None, overrides: dict | None = None) -> dict:
    """defaults, then variables PREFIX_NAME of the environment (typed as text), then stored values, then overrides."""
    out = dict(defaults)
    if prefix:
        out |= {k: typed(os.environ[f"{prefix}_{k}".upper()]) for k in defaults if f"{prefix}_{k}".upper() in os.environ}
    return out | (stored or {}) | (overrides or {})


# matrices as arrays of tables {row: [..]}


def matrix_of(config: dict, name: str, row: str = "row") -> list[list[int]]:
    return [[int(x) for x in r[row]] for r in config[name]]


def set_matrix(config: dict, name: str, matrix: Sequence[Sequence[int]], row: str = "row") -> dict:
    return config | {name: [{row: [int(x) for x in r]} for r in matrix]}


def matrix_rows(column: Column) -> Column:
    """array<array<T>> as (row, col, value) rows: for select(F.inline(...))."""
    return F.flatten(F.transform(column, lambda r, i: F.transform(r, lambda v, j: F.struct(i.alias("row"), j.alias("col"), v.alias("value")))))


# XML: small documents in a column; edits run on executors, reads with Spark's own functions where they can


def xml_text(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path.rstrip("/") + "/text()"))


def xml_attributes(xml: Column, path: str, name: str) -> Column:
    return F.xpath(xml, F.lit(f"{path.rstrip('/')}/@{name}"))


def find(root: ET.Element, path: str) -> list[ET.Element]:
    """Elements by a path: /root/a/b (with the root's own name), or any path that the standard library knows."""
    if path.startswith("//"):
        return ([root] if root.tag == path[2:] else []) + root.findall("." + path)
    if path.startswith("/"):
        head, _, rest = path[1:].partition("/")
        return ([root] if not rest else root.findall("./" + rest)) if head in (root.tag, "*") else []
    return root.findall(path)


def _edited(edit: Callable[[ET.Element], None]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            root = ET.fromstring(t)
            edit(root)
            out.append(ET.tostring(root, encoding="unicode"))
        return pd.Series(out, dtype=object)

    return run


def xml_set_text(xml: Column, path: str, text: str) -> Column:
    """Every element at path with that text. Null documents stay null; malformed ones are an error."""

    def edit(root: ET.Element) -> None:
        for e in find(root, path):
            e.text = text

    return _edited(edit)(xml)


def xml_set_attribute(xml: Column, path: str, name: str, value: str, where: tuple[str, str] | None = None) -> Column:
    """Every element at path with an attribute set; where: (attribute, value) that the element must have."""

    def edit(root: ET.Element) -> None:
        for e in find(root, path):
            if where is None or e.get(where[0]) == where[1]:
                e.set(name, value)

    return _edited(edit)(xml)


def xml_set_attributes(xml: Column, path: str, key: str, name: str, values: dict[str, str]) -> Column:
    """An attribute of the elements at path, by the value of their key attribute; others stay."""

    def edit(root: ET.Element) -> None:
        for e in find(root, path):
            if e.get(key) in values:
                e.set(name, values[e.get(key)])

    return _edited(edit)(xml)


def xml_append(xml: Column, path: str, tag: str, text: str) -> Column:
    """A new last child with a text under every element at path."""

    def edit(root: ET.Element) -> None:
        for e in find(root, path):
            ET.SubElement(e, tag).text = text

    return _edited(edit)(xml)


def xml_wrap(xml: Column, path: str, child: str, tag: str) -> Column:
    """A new element between every element at path and its children of a name: each such child is wrapped."""

    def edit(root: ET.Element) -> None:
        for e in find(root, path):
            for k, c in enumerate(list(e)):
                if c.tag == child:
                    wrap = ET.Element(tag)
                    wrap.append(c)
                    e[k] = wrap

    return _edited(edit)(xml)


def xml_remove(xml: Column, path: str, child: str) -> Column:
    def edit(root: ET.Element) -> None:
        for e in find(root, path):
            for c in e.findall(child):
                e.remove(c)

    return _edited(edit)(xml)


def xml_nodes(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, path, depth, text, attributes) of every element of the documents, in document order of a row's k."""
    kind = df.schema[key].dataType.simpleString()

    def walk(e: ET.Element, path: str, depth: int) -> Iterator[tuple]:
        yield path, depth, (e.text or "").strip() or None, dict(e.attrib)
        for c in e:
            yield from walk(c, f"{path}/{c.tag}", depth + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b[key], b[xml], strict=True):
                if t is not None:
                    root = ET.fromstring(t)
                    rows += [(i, k, *n) for k, n in enumerate(walk(root, f"/{root.tag}", 1))]
            yield pd.DataFrame(rows, columns=[key, "k", "path", "depth", "text", "attributes"])

    return df.select(key, xml).mapInPandas(run, f"`{key}` {kind}, k int, path string, depth int, text string, attributes map<string,string>")


def xml_elements(root: ET.Element, path: str, child: str, value: str) -> list[ET.Element]:
    """Elements at path whose named child has a text."""
    return [e for e in find(root, path) if (e.findtext(child) or "").strip() == value]


def xml_numbers(text: str) -> list[float]:
    """Blank-separated numbers."""
    return [float(x) for x in text.split()]


def text_of_xml(xml: str) -> dict:
    root = ET.fromstring(xml)
    return {root.tag: xml_to_dict(root)}


def xml_of(value: dict, root: str = "root") -> str:
    return ET.tostring(dict_to_xml(value, root), encoding="unicode")


# documentation and command texts


def docstring(text: str | None, name: str = "") -> dict:
    """{name, summary, parameters: [{name, type, description}], returns} of a text with `Args:` and `Returns:`."""
    lines = [x.rstrip() for x in (text or "").strip().splitlines()]
    out = {"name": name, "summary": lines[0].strip() if lines else "", "parameters": [], "returns": ""}
    part = None
    for line in lines[1:]:
        s = line.strip()
        if s in ("Args:", "Arguments:", "Parameters:"):
            part = "args"
        elif s == "Returns:":
            part = "returns"
        elif s.endswith(":") and " " not in s and s[0].isupper():
            part = None
        elif part == "args" and (m := re.match(r"(\*{0,2}\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)", s)):
            out["parameters"].append({"name": m[1], "type": m[2] or "", "description": m[3]})
        elif part == "args" and s and out["parameters"]:
            out["parameters"][-1]["description"] += f" {s}"
        elif part == "returns" and s:
            out["returns"] = f"{out['returns']} {s}".strip()
    return out


def doc_tags(text: str | None) -> dict[str, str]:
    """`@key: value` pairs, one a line."""
    return {k: v.strip() for k, v in re.findall(r"^\s*@(\w+)\s*:\s*(.*)$", text or "", re.M)}


def methods(value: object) -> dict[str, dict]:
    """The public methods of an instance: their parsed documentation."""
    return {n: docstring(getattr(value, n).__doc__, n) for n in dir(value) if not n.startswith("_") and callable(getattr(value, n))}


def call(f: Callable, parameters: dict) -> object:
    """f with the keyword arguments of a dictionary; others than f takes are an error."""
    return f(**parameters)


def retry(f: Callable, *args: object, tries: int = 5, delay: float = 2.0, sleep: Callable[[float], None] | None = None, **kw: object) -> object:
    """f's result, called again after a constant delay when it raises; None when the last try raises too."""
    import time

    for k in range(tries):
        try:
            return f(*args, **kw)
        except Exception:
            if k + 1 < tries:
                (sleep or time.sleep)(delay)
    return None


def coerce(text: str, kind: str) -> object:
    """Text as a value of a JSON-schema type: integer, number, boolean, array, object or string."""
    if kind == "integer":
        return int(text)
    if kind == "number":
        return float(text)
    if kind == "boolean":
        return text.strip().lower() in ("true", "1", "yes", "on")
    if kind in ("array", "object"):
        value = json.loads(text)
        if not isinstance(value, list if kind == "array" else dict):
            raise ValueError(f"not an {kind}: {text}")
        return value
    return text


def key_values(text: str, kinds: dict[str, str] | None = None) -> dict:
    """`a=1 b="x y" c=[1, 2]`: values in quotes, JSON, or up to a blank; typed by kinds, or as they read."""
    out, k = {}, 0
    while m := re.compile(r"\s*([\w.-]+)=").match(text, k):
        k = m.end()
        if k < len(text) and text[k] in "\"'":
            end = text.index(text[k], k + 1)
            value, quoted, k = text[k + 1 : end], True, end + 1
        elif k < len(text) and text[k] in "[{":
            _, end = json.JSONDecoder().raw_decode(text, k)
            value, quoted, k = text[k:end], False, end
        else:
            end = re.compile(r"\s|$").search(text, k).start()
            value, quoted, k = text[k:end], False, end
        kind = (kinds or {}).get(m[1])
        out[m[1]] = coerce(value, kind) if kind else value if quoted else json.loads(value) if value[:1] in "[{" else typed(value)
    if text[k:].strip():
        raise ValueError(f"not key=value: {text[k:].strip()}")
    return out


def literals(value: object, keys: Sequence[str] | None = None) -> object:
    """Text that is a literal of the host language as its value, quotes and all, at any depth; only under keys if given."""
    if isinstance(value, dict):
        return {k: literals(v, None if keys is None or k in keys else keys) if keys is None or k in keys or isinstance(v, (dict, list)) else v for k, v in value.items()}
    if isinstance(value, list):
        return [literals(v, keys) for v in value]
    if isinstance(value, str) and not keys:
        try:
            return ast.literal_eval(value)
        except (ValueError, SyntaxError):
            return value
    return value


# actions {category, reads, writes}


def actions_by_category(actions: dict[str, dict]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in sorted(actions):
        out.setdefault(actions[name].get("category", ""), []).append(name)
    return out


def propositions(actions: dict[str, dict]) -> set[str]:
    """Keys that any action reads or writes."""
    return {k for a in actions.values() for part in ("requires", "effect") for k in a.get(part, {})}


def actions_from(catalogue: DataFrame, commands: dict) -> dict[str, dict]:
    """The catalogue's commands as actions with their conditions and effects."""
    return {r["name"]: {"category": r["category"], **{k: commands[r["name"]]._command[k] for k in ("requires", "effect")}} for r in catalogue.collect()}


def by_input_type(services: dict[str, Sequence[str]], kind: str) -> list[str]:
    return sorted(n for n, kinds in services.items() if kind in kinds)


def input_types(services: dict[str, Sequence[str]]) -> list[str]:
    return sorted({k for kinds in services.values() for k in kinds})


# files


def write_base64(content: str, path: str) -> str:
    """The bytes of a base64 text, with or without a data-url head, as a file."""
    with open(path, "wb") as f:
        f.write(base64.b64decode(content.split(",", 1)[1] if content.startswith("data:") else content))
    return path


def relative_path(path: str, base: str) -> str:
    return os.path.relpath(path, base)


def entity_id(kind: str, name: str, now: dt.datetime, node: int, random: str) -> str:
    """kind_YYYYmmdd_HHMMSS_node_hash_random: the parts that vary are arguments."""
    return f"{kind}_{now:%Y%m%d_%H%M%S}_{node:012x}_{hashlib.md5(name.encode()).hexdigest()[:8]}_{random[:8]}"


def find_items(folder: str, pattern: str, depth: int, files: bool = True) -> list[str]:
    """Paths of directories (and files) whose name fits a pattern, down to a depth below folder, in order."""
    out = []
    for top, dirs, names in os.walk(folder):
        level = 0 if os.path.samefile(top, folder) else os.path.relpath(top, folder).count(os.sep) + 1
        if level >= depth:
            dirs.clear()
        out += [os.path.join(top, n) for n in [*(dirs if level < depth else []), *(names if files else [])] if fnmatch.fnmatch(n, pattern)]
    return sorted(out)


def has_keyword(path: str, keyword: str) -> bool:
    """Whether a line of an ASCII file holds the keyword; False for a file that is not there or not ASCII."""
    try:
        with open(path, encoding="ascii") as f:
            return any(keyword in line for line in f)
    except (OSError, UnicodeDecodeError):
        return False


def add_line(path: str, line: str) -> None:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{line}\n{text}")


def delete_line(path: str) -> None:
    """Drop the first line, and every other line equal to it."""
    with open(path, encoding="utf-8") as f:
        lines = f.readlines()
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(x for x in lines[1:] if x.rstrip("\n") != lines[0].rstrip("\n"))


def dated_paths(spark: SparkSession, pattern: str, expression: str = r"(\d{8})[_T-]?(\d{6})", form: str = "yyyyMMdd HHmmss") -> DataFrame:
    """(path, name, time, modified, length) of the files under a pattern, time read from the name, in its order; no content is read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"), "length")
    name = F.element_at(F.split("path", "/"), -1)
    stamp = F.concat_ws(" ", F.regexp_extract(name, expression, 1), F.regexp_extract(name, expression, 2))
    return files.select("path", name.alias("name"), F.try_to_timestamp(stamp, F.lit(form)).alias("time"), "modified", "length").orderBy("time", "name")


def between_dates(df: DataFrame, start: dt.datetime, end: dt.datetime, time: str = "time") -> DataFrame:
    """Rows with start <= time <= end."""
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))


def now(spark: SparkSession, zone: str = "UTC") -> DataFrame:
    """One row: the query's time as a clock in the zone shows it."""
    return spark.range(1).select(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS"))).alias("now"))


def time_span(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, start, end, seconds) of a table's time."""
    out = df.groupBy(*by).agg(F.min(time).alias("start"), F.max(time).alias("end"))
    return out.withColumn("seconds", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6)


def write_station_template(folder: str) -> str:
    """An example of a station manifest with its profile table; returns the manifest's path."""
    depth = [0.0, 0.1, 0.2]
    with open(os.path.join(folder, "station_a.csv"), "w", encoding="utf-8") as f:
        f.write("time," + ",".join(map(str, depth)) + "\n0.0,300,310,320\n60.0,305,312,321\n")
    path = os.path.join(folder, "stations.json")
    write_config({"stations": [{"name": "a", "position": [0.0, 0.0, 0.0], "file": "station_a.csv", "interfaces": [0.1, 0.2]}]}, path)
    return path


# queries


def _docs(s, d):
    from gramlake.session import table

    return table(s, d, "nation").select("n_nationkey", F.concat(F.lit('<n key="'), "n_nationkey", F.lit('"><name>'), "n_name", F.lit("</name><region>"), "n_regionkey", F.lit("</region></n>")).alias("xml"))


def _q_xml_read(s, d):
    return _docs(s, d).select("n_nationkey", F.get(xml_text(F.col("xml"), "/n/name"), 0).alias("name"), F.get(xml_attributes(F.col("xml"), "/n", "key"), 0).alias("key"))


def _q_xml_edit(s, d):
    x = xml_set_text(F.col("xml"), "/n/region", "7")
    x = xml_append(xml_set_attribute(x, "/n", "seen", "1", ("key", "3")), "/n", "end", "x")
    x = xml_set_attributes(xml_wrap(x, "/n", "name", "box"), "/n", "key", "tag", {"1": "one", "2": "two"})
    return _docs(s, d).select("n_nationkey", xml_remove(x, "/n", "nothing").alias("xml"))


def _q_xml_nodes(s, d):
    return xml_nodes(_docs(s, d), "n_nationkey", "xml").select("n_nationkey", "k", "path", "depth", "text", F.col("attributes").getItem("key").alias("key"))


def _q_span(s, d):
    from gramlake.session import table

    return time_span(table(s, d, "events"), "ts", ["user_id"])


def _q_matrix(s, d):
    from gramlake.session import table

    return table(s, d, "nation").groupBy("n_regionkey").agg(F.array(F.array(F.min("n_nationkey"), F.max("n_nationkey")), F.array(F.count("*").cast("int"))).alias("m")).select("n_regionkey", F.inline(matrix_rows(F.col("m"))))


QUERIES = {"xml_read": _q_xml_read, "xml_edit": _q_xml_edit, "xml_nodes": _q_xml_nodes, "time_span": _q_span, "matrix_rows": _q_matrix}
SQL = {
    "xml_read": "SELECT n_nationkey, n_name AS name, n_nationkey::VARCHAR AS key FROM nation",
    "xml_edit": "SELECT n_nationkey, '<n key=\"' || n_nationkey || '\"' || CASE n_nationkey WHEN 3 THEN ' seen=\"1\"' WHEN 1 THEN ' tag=\"one\"' WHEN 2 THEN ' tag=\"two\"' ELSE '' END || '><box><name>' || n_name || '</name></box><region>7</region><end>x</end></n>' AS xml FROM nation",
    "xml_nodes": "SELECT n_nationkey, k::INTEGER AS k, ['/n', '/n/name', '/n/region'][k + 1] AS path, CASE k WHEN 0 THEN 1 ELSE 2 END::INTEGER AS depth, [NULL, n_name, n_regionkey::VARCHAR][k + 1] AS text, CASE k WHEN 0 THEN n_nationkey::VARCHAR END AS key FROM nation, range(3) t(k)",
    "time_span": "SELECT user_id, min(ts) AS start, max(ts) AS \"end\", (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY 1",
    "matrix_rows": "WITH m AS (SELECT n_regionkey, min(n_nationkey) AS a, max(n_nationkey) AS b, count(*) AS c FROM nation GROUP BY 1) SELECT n_regionkey, 0 AS row, 0 AS col, a AS value FROM m UNION ALL SELECT n_regionkey, 0, 1, b FROM m UNION ALL SELECT n_regionkey, 1, 0, c FROM m",
}
