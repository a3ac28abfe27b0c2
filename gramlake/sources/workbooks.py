"""Workbooks (.xlsx) by the standard library alone: a zip of XML parts. Sheets are read on executors, written on the driver."""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions.scalars import formula
from gramlake.sources.formats import read_bytes, read_delimited, write_bytes

#: Namespaces and part names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACK = "http://schemas.openxmlformats.org/package/2006/relationships"
CHART = "http://schemas.openxmlformats.org/drawingml/2006/chart"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
SHEET_DRAW = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: A sheet holds so many rows; larger tables belong in Parquet.
MAX_ROWS = 1_048_576


def column_name(k: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    name = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def column_number(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(at: str, v: object) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{at}"><v>{v!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _sheet(header: Sequence[str], rows: Sequence[Sequence[object]], drawing: bool) -> str:
    if len(rows) >= MAX_ROWS:
        raise ValueError(f"a sheet holds {MAX_ROWS - 1} rows below its header")
    lines = []
    for i, row in enumerate([header, *rows], 1):
        lines.append(f'<row r="{i}">' + "".join(_cell(f"{column_name(k)}{i}", v) for k, v in enumerate(row)) + "</row>")
    tail = '<drawing r:id="rId1"/>' if drawing else ""
    return f'{_HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{RELS}"><sheetData>{"".join(lines)}</sheetData>{tail}</worksheet>'


def _scatter(sheet: str, n: int, x: int, ys: Sequence[int], names: Sequence[str]) -> str:
    """A scatter chart of columns ys over column x; the first three series are red, green and blue."""
    quoted = "'" + sheet.replace("'", "''") + "'"
    series = ""
    for k, y in enumerate(ys):
        colour = ("FF0000", "00FF00", "0000FF")[k] if k < 3 else None
        line = f'<c:spPr><a:ln><a:solidFill><a:srgbClr val="{colour}"/></a:solidFill></a:ln></c:spPr>' if colour else ""
        ref = lambda c: escape(f"{quoted}!${column_name(c)}$2:${column_name(c)}${n + 1}")
        series += f'<c:ser><c:idx val="{k}"/><c:order val="{k}"/><c:tx><c:v>{escape(names[y])}</c:v></c:tx>{line}<c:xVal><c:numRef><c:f>{ref(x)}</c:f></c:numRef></c:xVal><c:yVal><c:numRef><c:f>{ref(y)}</c:f></c:numRef></c:yVal></c:ser>'
    axes = "".join(f'<c:valAx><c:axId val="{a}"/><c:scaling/><c:delete val="0"/><c:axPos val="{p}"/><c:crossAx val="{b}"/></c:valAx>' for a, b, p in ((1, 2, "b"), (2, 1, "l")))
    return f'{_HEAD}<c:chartSpace xmlns:c="{CHART}" xmlns:a="{DRAW}"><c:chart><c:plotArea><c:layout/><c:scatterChart><c:scatterStyle val="lineMarker"/>{series}<c:axId val="1"/><c:axId val="2"/></c:scatterChart>{axes}</c:plotArea></c:chart></c:chartSpace>'


def workbook_bytes(sheets: dict[str, tuple[Sequence[str], Sequence[Sequence[object]]]], plots: dict[str, tuple[int, Sequence[int]]] | None = None) -> bytes:
    """A workbook of sheets (header, rows). plots: of a sheet, its x column and y columns by position."""
    plots = plots or {}
    out = io.BytesIO()
    rel = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{RELS}/{kind}" Target="{target}"/>'
    rels = lambda body: f'{_HEAD}<Relationships xmlns="{PACK}">{body}</Relationships>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        kinds += '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        names = links = ""
        for k, (name, (header, rows)) in enumerate(sheets.items(), 1):
            names += f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>'
            links += rel(k, "worksheet", f"worksheets/sheet{k}.xml")
            kinds += f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            z.writestr(f"xl/worksheets/sheet{k}.xml", _sheet(header, rows, name in plots))
            if name in plots:
                x, ys = plots[name]
                z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", rels(rel(1, "drawing", f"../drawings/drawing{k}.xml")))
                place = "<xdr:from><xdr:col>{0}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>1</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:to><xdr:col>{1}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>20</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:to>".format(len(header) + 1, len(header) + 9)
                frame = f'<xdr:graphicFrame macro=""><xdr:nvGraphicFramePr><xdr:cNvPr id="2" name="Chart {k}"/><xdr:cNvGraphicFramePr/></xdr:nvGraphicFramePr><xdr:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/></xdr:xfrm><a:graphic><a:graphicData uri="{CHART}"><c:chart xmlns:c="{CHART}" r:id="rId1"/></a:graphicData></a:graphic></xdr:graphicFrame><xdr:clientData/>'
                z.writestr(f"xl/drawings/drawing{k}.xml", f'{_HEAD}<xdr:wsDr xmlns:xdr="{SHEET_DRAW}" xmlns:a="{DRAW}" xmlns:r="{RELS}"><xdr:twoCellAnchor>{place}{frame}</xdr:twoCellAnchor></xdr:wsDr>')
                z.writestr(f"xl/drawings/_rels/drawing{k}.xml.rels", rels(rel(1, "chart", f"../charts/chart{k}.xml")))
                z.writestr(f"xl/charts/chart{k}.xml", _scatter(name[:31], len(rows), x, ys, header))
                kinds += f'<Override PartName="/xl/drawings/drawing{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.drawing+xml"/><Override PartName="/xl/charts/chart{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.drawingml.chart+xml"/>'
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(links))
        z.writestr("_rels/.rels", rels(rel(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{TYPES}">{kinds}</Types>')
    return out.getvalue()


def parse_workbook(data: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet name -> rows of cells as text (numbers as written, booleans as 1 and 0), shared and inline strings resolved."""
    tag = lambda name: f"{{{MAIN}}}{name}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(tag("t"))) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(tag("sheet")):
            target = targets[s.get(f"{{{RELS}}}id")]
            rows: list[list[str | None]] = []
            for row in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(tag("row")):
                at = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(at - 1 - len(rows))]
                cells: list[str | None] = []
                for c in row.iter(tag("c")):
                    k = column_number(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else len(cells)
                    cells += [None] * (k - len(cells))
                    v = c.find(tag("v"))
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(tag("t"))))
                    elif v is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                rows.append(cells)
            out[s.get("name")] = rows
        return out


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells array<string>) of every workbook under a path or pattern, each parsed where its bytes are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                for sheet, rows in parse_workbook(content).items():
                    yield pd.DataFrame({"path": p, "sheet": sheet, "row": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row long, cells array<string>")


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a workbook's sheets in order; a delimited file has the one sheet Sheet1."""
    if path.lower().endswith((".csv", ".txt")):
        return ["Sheet1"]
    return list(parse_workbook(read_bytes(spark, path)))


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sheet name -> table of text columns, named by the sheet's first row (nameless columns are c0, c1, ...)."""
    if path.lower().endswith((".csv", ".txt")):
        return {"Sheet1": read_delimited(spark, path)}
    rows = sheet_rows(spark, path)
    out = {}
    for name in sheet_names(spark, path):
        own = rows.where(F.col("sheet") == name)
        first = own.orderBy("row").first()
        header = [h or f"c{k}" for k, h in enumerate(first["cells"])] if first else []
        out[name] = own.where(F.col("row") > first["row"]).select(*[F.get("cells", k).alias(h) for k, h in enumerate(header)]) if first else spark.createDataFrame([], "c0 string")
    return out


def read_all_sheets(spark: SparkSession, path: str) -> DataFrame:
    """All sheets one after the other, in the first sheet's columns, without rows that lack a value."""
    first, *rest = read_workbook(spark, path).values()
    for df in rest:
        first = first.unionByName(df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in first.columns]))
    return first.dropna()


def write_workbook(sheets: dict[str, DataFrame], path: str, plots: dict[str, tuple[int, Sequence[int]]] | None = None) -> str:
    """Small tables as the sheets of a workbook: up to MAX_ROWS rows each come to the driver, more raise."""
    held = {}
    for name, df in sheets.items():
        rows = [tuple(r) for r in df.limit(MAX_ROWS).collect()]
        held[name] = (df.columns, rows)
    return write_bytes(next(iter(sheets.values())).sparkSession, path, workbook_bytes(held, plots))


def delimited_to_workbook(spark: SparkSession, paths: Sequence[str], path: str, names: Sequence[str] | None = None) -> str:
    """Delimited files as the sheets of one workbook, named by file or by names."""
    names = names or [os.path.splitext(os.path.basename(p))[0] for p in paths]
    return write_workbook({n: read_delimited(spark, p) for n, p in zip(names, paths, strict=True)}, path)


def merge_workbooks(spark: SparkSession, paths: Sequence[str], path: str) -> str:
    """The sheets of several workbooks in one; a name that comes again gets the workbook's name before it."""
    sheets: dict[str, DataFrame] = {}
    for p in paths:
        for name, df in read_workbook(spark, p).items():
            sheets[name if name not in sheets else f"{os.path.splitext(os.path.basename(p))[0]}_{name}"] = df
    return write_workbook(sheets, path)


# items: columns with a unit and a formula, described by a sheet of three rows


def read_item_config(spark: SparkSession, path: str) -> list[dict]:
    """[{name, unit, formula}] of a sheet whose rows are names, units and formulas; an empty or `nan` formula is raw."""
    rows = next(iter(parse_workbook(read_bytes(spark, path)).values()))
    names, units, formulas = (r + [None] * (len(rows[0]) - len(r)) for r in (rows + [[], []])[:3])
    return [{"name": n, "unit": u or "", "formula": None if f in (None, "", "nan") else f} for n, u, f in zip(names, units, formulas, strict=True)]


def write_item_config(spark: SparkSession, items: Sequence[dict], path: str) -> str:
    return write_bytes(spark, path, workbook_bytes({"config": ([i["name"] for i in items], [[i.get("unit") or "" for i in items], [i.get("formula") or "nan" for i in items]])}))


def apply_items(df: DataFrame, items: Sequence[dict]) -> DataFrame:
    """df's columns as items: the formula in V applied, the unit in the metadata, headers `name[unit]`."""
    out = []
    for i in items:
        c = F.col(f"`{i['name']}`").cast("double")
        value = formula(i["formula"], V=c) if i.get("formula") else c
        out.append(value.alias(f"{i['name']}[{i['unit']}]" if i.get("unit") else i["name"], metadata={"unit": i.get("unit") or ""}))
    return df.select(*out)


# queries


def _folder(s) -> str:
    """A new place in the folder that all executors share, or of a local master's own."""
    import tempfile
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if base is None and not s.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp()}/books-{uuid.uuid4().hex}"


def _q_roundtrip(s, d):
    from gramlake.session import table

    path = write_workbook({"n": table(s, d, "nation").orderBy("n_nationkey"), "r": table(s, d, "region").orderBy("r_regionkey")}, _folder(s) + "/b.xlsx", {"n": (0, [2])})
    nation, region = read_workbook(s, path).values()
    return nation.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("r_regionkey")).join(region.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name"), "r_regionkey")


def _q_items(s, d):
    from gramlake.session import table

    path = write_item_config(s, [{"name": "p_size", "unit": "cm", "formula": "V * 2.54"}, {"name": "p_retailprice", "unit": "", "formula": None}], _folder(s) + "/c.xlsx")
    out = apply_items(table(s, d, "part"), read_item_config(s, path))
    return out.select(F.round("`p_size[cm]`", 9).alias("size_cm"), "p_retailprice").groupBy("size_cm").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))


QUERIES = {"workbook_roundtrip": _q_roundtrip, "item_config": _q_items}
SQL = {
    "workbook_roundtrip": "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "item_config": "SELECT round(p_size * 2.54, 9)::DOUBLE AS size_cm, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY 1",
}
