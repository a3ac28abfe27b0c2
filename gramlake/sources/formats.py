"""Files in and out: delimited text, configuration formats, mesh files, manifests, encoded payloads."""

from __future__ import annotations

import base64
import csv
import io
import json
import os
import tomllib
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.operators.tables import finite_rows, named


def sniff(line: str) -> str:
    """The separator of a line among comma, semicolon, tab and space: the most frequent, in this order at a tie."""
    return max(",;\t ", key=lambda c: (line.count(c), -",;\t ".index(c)))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line that is not a comment, through Spark's reader: the path may be in any store."""
    row = spark.read.text(path).where("value NOT LIKE '#%'").first()
    return row[0] if row else ""


def read_delimited(spark: SparkSession, path: str, header: bool = True, separator: str | None = None) -> DataFrame:
    """Delimited text with `#` comments. Blank cells stay ''. A ragged row is an error."""
    sep = separator or sniff(first_line(spark, path))
    return spark.read.csv(path, header=header, sep=sep, comment="#", emptyValue="", nullValue="\x00", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def load_table(spark: SparkSession, path: str, inputs: Sequence[str], outputs: Sequence[str], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Named columns as doubles without the rows that miss one; and a one-row table of kept and dropped counts."""
    names = [*inputs, *outputs, *([weight] if weight else [])]
    raw = named(read_delimited(spark, path), names)
    kept, ok = finite_rows(raw, names)
    return kept, raw.agg(F.count_if(ok).alias("n_samples"), F.count_if(~ok).alias("dropped_rows"))


def has_rows(spark: SparkSession, path: str) -> bool:
    if not path.lower().endswith((".csv", ".txt")):
        raise ValueError(f"not a delimited file: {path}")
    return not read_delimited(spark, path).isEmpty()


def read_sheets(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """Several delimited files as the sheets of one workbook, named by file."""
    return {os.path.splitext(os.path.basename(p))[0]: read_delimited(spark, p) for p in paths}


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Bytes as a file, through Spark's file systems: the path may be in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


#: Rows that a text form on the driver takes; larger tables are written by executors.
TEXT_ROWS = 100_000


def _few(df: DataFrame) -> DataFrame:
    if df.limit(TEXT_ROWS + 1).count() > TEXT_ROWS:
        raise ValueError(f"over {TEXT_ROWS} rows: give a path, which executors write to")
    return df


def to_csv(df: DataFrame, float_format: str | None = None, separator: str = ",", path: str | None = None) -> str:
    """Small tables as text; with a path a folder of delimited files of any size, written where the rows are."""
    if path is None:
        return _few(df).toPandas().to_csv(index=False, float_format=float_format, sep=separator)
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")} if float_format else set()
    out = df.select(*[F.format_string(float_format, c).alias(c) if c in floats else F.col(c) for c in df.columns])
    out.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)
    return path


def to_json(df: DataFrame, orient: str = "records", path: str | None = None) -> str:
    """Small tables as text in any orientation; with a path a folder of one record a line, of any size."""
    if path is None:
        return _few(df).toPandas().to_json(orient=orient)
    df.write.mode("overwrite").json(path)
    return path


def from_base64(spark: SparkSession, content: str) -> DataFrame:
    """A table from a base64 text payload, with or without a data-url head."""
    text = base64.b64decode(content.split(",", 1)[1] if content.startswith("data:") else content).decode()
    rows = list(csv.reader(io.StringIO(text), delimiter=sniff(text.split("\n", 1)[0])))
    return spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))


def file_base64(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under a path, base64."""
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("content"))


# configuration files: small, read on the driver


def xml_to_dict(e: ET.Element) -> object:
    """Children by tag, lists where a tag repeats, attributes with '@', text beside them as '#text'."""
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for c in e:
        v = xml_to_dict(c)
        if c.tag in out:
            out[c.tag] = [*out[c.tag], v] if isinstance(out[c.tag], list) else [out[c.tag], v]
        else:
            out[c.tag] = v
    text = (e.text or "").strip()
    if not out:
        return text
    return out | ({"#text": text} if text else {})


def dict_to_xml(value: object, tag: str = "root") -> ET.Element:
    e = ET.Element(tag)
    if isinstance(value, dict):
        for k, v in value.items():
            if k.startswith("@"):
                e.set(k[1:], str(v))
            elif k == "#text":
                e.text = str(v)
            else:
                e.extend(dict_to_xml(x, k) for x in (v if isinstance(v, list) else [v]))
    else:
        e.text = "" if value is None else str(value)
    return e


def read_config(path: str) -> dict:
    kind = os.path.splitext(path)[1].lower()
    with open(path, "rb") as f:
        data = f.read()
    if kind == ".json":
        return json.loads(data)
    if kind == ".toml":
        return tomllib.loads(data.decode())
    if kind in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(data)
    if kind == ".xml":
        root = ET.fromstring(data)
        return xml_to_dict(root) if root.tag == "root" else {root.tag: xml_to_dict(root)}
    raise ValueError(f"unknown configuration format {kind}")


def to_toml(value: dict, prefix: str = "") -> str:
    def leaf(v: object) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        return json.dumps(v) if isinstance(v, str) else "[" + ", ".join(map(leaf, v)) + "]" if isinstance(v, list) else repr(v)

    plain = {k: v for k, v in value.items() if not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict))}
    out = "".join(f"{k} = {leaf(v)}\n" for k, v in plain.items())
    for k, v in value.items():
        if isinstance(v, dict):
            out += f"\n[{prefix}{k}]\n" + to_toml(v, f"{prefix}{k}.")
        elif k not in plain:
            out += "".join(f"\n[[{prefix}{k}]]\n" + to_toml(x, f"{prefix}{k}.") for x in v)
    return out


def write_config(value: dict, path: str) -> None:
    kind = os.path.splitext(path)[1].lower()
    if kind == ".json":
        text = json.dumps(value, indent=2)
    elif kind == ".toml":
        text = to_toml(value)
    elif kind in (".yaml", ".yml"):
        import yaml

        text = yaml.safe_dump(value, sort_keys=False)
    elif kind == ".xml":
        text = ET.tostring(dict_to_xml(value), encoding="unicode")
    else:
        raise ValueError(f"unknown configuration format {kind}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def input_files(template: dict, table: DataFrame, folder: str) -> list[str]:
    """One TOML file a table row, columns `group.name` overwriting the template's values. Tables of up to TEXT_ROWS rows."""
    paths = []
    for k, row in enumerate(_few(table).toLocalIterator()):
        value = json.loads(json.dumps(template))
        for c, v in row.asDict().items():
            *groups, name = c.split(".")
            at = value
            for g in groups:
                at = at.setdefault(g, {})
            at[name] = v
        paths.append(f"{folder}/input_{k:04d}.toml")
        write_config(value, paths[-1])
    return paths


def nested(flat: dict, separator: str = ".") -> dict:
    out: dict = {}
    for k, v in flat.items():
        *heads, last = k.split(separator)
        at = out
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = v
    return out


def flattened(value: dict, separator: str = ".", prefix: str = "") -> dict:
    out: dict = {}
    for k, v in value.items():
        out |= flattened(v, separator, f"{prefix}{k}{separator}") if isinstance(v, dict) and v else {f"{prefix}{k}": v}
    return out


# meshes

#: Number types of VTK files.
_TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}


def _blocks(raw: bytes, width: str, packed: bool, text: bool) -> bytes:
    """One array's bytes, from raw or base64 data, with or without zlib blocks."""
    head = np.dtype(width).itemsize

    def take(data: bytes, n: int) -> bytes:
        return base64.b64decode(data[: -(-n // 3) * 4]) if text else data[:n]

    if not packed:
        n = int(np.frombuffer(take(raw, head)[:head], width)[0])
        return take(raw, head + n)[head : head + n]
    count = int(np.frombuffer(take(raw, head)[:head], width)[0])
    size = head * (3 + count)
    sizes = np.frombuffer(take(raw, size)[:size], width)[3:]
    rest = raw[-(-size // 3) * 4 :] if text else raw[size:]
    body, out, at = take(rest, int(sizes.sum())), b"", 0
    for n in sizes:
        out += zlib.decompress(body[at : at + int(n)])
        at += int(n)
    return out


def parse_vtu(data: bytes) -> dict:
    """points (n, 3), connectivity, offsets, types, and the named point and cell arrays of an unstructured grid; pieces are joined."""
    tail, split = b"", data.find(b"<AppendedData")
    raw = False
    if split >= 0:
        start = data.index(b"_", split) + 1
        end = data.rindex(b"</AppendedData>")
        raw = b'encoding="raw"' in data[split:start]
        tail = data[start:end]
        data = data[:split] + b"</VTKFile>"
    root = ET.fromstring(data)
    width = "u8" if root.get("header_type") == "UInt64" else "u4"
    order = ">" if root.get("byte_order") == "BigEndian" else "<"
    packed = root.get("compressor") is not None

    def array(e: ET.Element) -> np.ndarray:
        kind = order + _TYPES[e.get("type")]
        if e.get("format") == "ascii":
            out = np.array((e.text or "").split(), dtype=kind)
        elif e.get("format") == "appended":
            out = np.frombuffer(_blocks(tail[int(e.get("offset")) :], order + width, packed, not raw), kind)
        else:
            out = np.frombuffer(_blocks((e.text or "").strip().encode(), order + width, packed, True), kind)
        n = int(e.get("NumberOfComponents") or 1)
        return out.reshape(-1, n) if n > 1 else out

    found = []
    for piece in root.iter("Piece"):
        cells = {a.get("Name"): array(a) for a in piece.find("Cells")}
        found.append({
            "points": array(piece.find("Points")[0]).reshape(-1, 3), **{k: cells[k].astype(np.int64) for k in ("connectivity", "offsets", "types")},
            "point_data": {a.get("Name"): array(a) for a in piece.iterfind("PointData/DataArray")}, "cell_data": {a.get("Name"): array(a) for a in piece.iterfind("CellData/DataArray")},
        })
    out = found[0]
    for p in found[1:]:
        shift, at = len(out["points"]), len(out["connectivity"])
        out = {
            "points": np.concatenate([out["points"], p["points"]]), "connectivity": np.concatenate([out["connectivity"], p["connectivity"] + shift]),
            "offsets": np.concatenate([out["offsets"], p["offsets"] + at]), "types": np.concatenate([out["types"], p["types"]]),
            **{g: {k: np.concatenate([v, p[g][k]]) for k, v in out[g].items() if k in p[g]} for g in ("point_data", "cell_data")},
        }
    return out


def format_vtu(mesh: dict) -> bytes:
    """An unstructured grid as XML with inline base64 arrays."""
    names = {v: k for k, v in _TYPES.items()}

    def array(name: str, v: np.ndarray) -> str:
        kind = np.asarray(v).dtype.str[1:]
        body = np.ascontiguousarray(v).tobytes()
        n = f' NumberOfComponents="{v.shape[1]}"' if v.ndim > 1 else ""
        return f'<DataArray type="{names[kind]}" Name="{name}"{n} format="binary">{base64.b64encode(len(body).to_bytes(4, "little") + body).decode()}</DataArray>'

    cells = "".join(array(k, np.asarray(mesh[k], "i8" if k != "types" else "u1")) for k in ("connectivity", "offsets", "types"))
    data = {g: "".join(array(k, np.asarray(v)) for k, v in mesh.get(g, {}).items()) for g in ("point_data", "cell_data")}
    return (
        f'<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian"><UnstructuredGrid><Piece NumberOfPoints="{len(mesh["points"])}" NumberOfCells="{len(mesh["types"])}">'
        f'<PointData>{data["point_data"]}</PointData><CellData>{data["cell_data"]}</CellData><Points>{array("Points", np.asarray(mesh["points"], "f8"))}</Points><Cells>{cells}</Cells></Piece></UnstructuredGrid></VTKFile>'
    ).encode()


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, pid, x, y, z) and (file, cid, type, nodes) of every mesh file under a path; files decode in parallel."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                p = parse_vtu(bytes(data))["points"].astype(float)
                yield pd.DataFrame({"file": name, "pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                m = parse_vtu(bytes(data))
                yield pd.DataFrame({"file": name, "cid": np.arange(len(m["types"])), "type": m["types"].astype(np.int32), "nodes": np.split(m["connectivity"], m["offsets"][:-1])})

    return files.mapInPandas(points, "file string, pid long, x double, y double, z double"), files.mapInPandas(cells, "file string, cid long, type int, nodes array<long>")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(time, file, part) of a time-series manifest."""
    rows = spark.read.format("xml").option("rowTag", "DataSet").load(path)
    part = F.col("_part").cast("int") if "_part" in rows.columns else F.lit(0)
    return rows.select(F.col("_timestep").cast("double").alias("time"), F.col("_file").alias("file"), part.alias("part"))


def write_series(rows: Sequence[tuple[float, str]], path: str) -> None:
    body = "".join(f'<DataSet timestep="{t:g}" part="0" file="{os.path.relpath(f, os.path.dirname(path) or ".") if os.path.isabs(f) else f}"/>' for t, f in rows)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<?xml version="1.0"?><VTKFile type="Collection" version="0.1"><Collection>{body}</Collection></VTKFile>')


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(t, depth, value) of a wide table whose header is time and the depths."""
    wide = read_delimited(spark, path)
    t, *depths = wide.columns
    long = wide.unpivot([t], [f"`{d}`" for d in depths], "depth", "value")
    return long.select(F.col(f"`{t}`").cast("double").alias("t"), F.regexp_replace("depth", "`", "").cast("double").alias("depth"), F.col("value").cast("double").alias("value"))


def load_stations(spark: SparkSession, path: str) -> DataFrame:
    """(name, position, t, depth, temperature) from a JSON list of stations with inline arrays."""
    raw = spark.read.schema("stations array<struct<name:string,position:array<double>,time:array<double>,depth:array<double>,temperature:array<array<double>>>>").option("multiLine", True).json(path)
    one = raw.select(F.inline("stations")).select("name", "position", "depth", F.inline(F.arrays_zip("time", "temperature")))
    return one.select("name", "position", F.col("time").alias("t"), F.inline(F.arrays_zip("depth", "temperature")))
