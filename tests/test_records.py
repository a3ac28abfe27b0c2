import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.functions import records
from gramlake.plans import modelling, tools
from gramlake.sources import workbooks


def test_unit_aware_dictionaries():
    held = records.typed({"a": "12", "b": "3.5[m]", "c": "true", "d": {"e": "x[y]"}, "f": "4[kg/m3]"})
    assert held == {"a": 12, "b": {"data": 3.5, "unit": "m"}, "c": True, "d": {"e": "x[y]"}, "f": {"data": 4, "unit": "kg/m3"}}
    assert records.plain(held) == {"a": 12, "b": 3.5, "c": True, "d": {"e": "x[y]"}, "f": 4}
    assert records.raw(held)["b"] == "3.5[m]" and records.item(held, "b") == {"data": 3.5, "unit": "m"}
    with pytest.raises(KeyError):
        records.item(held, "d.z")
    assert records.as_list({"a": 1}) == [{"a": 1}] and records.as_list([1]) == [1]
    assert records.by_key([{"id": 1, "v": 2}, {"id": 3, "v": 4}], "id") == {1: {"v": 2}, 3: {"v": 4}}
    assert records.map_paths({"a": {"b": [5, 6]}}, {"x": 1}, {"y.z": "a.b.1"}) == {"x": 1, "y": {"z": 6}}
    assert records.table_of({"item0": {"v": 1}}) == [{"key": "0", "v": 1}]
    assert records.file_item({"@type": "csv", "@path": "p"}) == ("csv", "p", None)
    assert records.literals({"a": "[1, 2]", "b": "x", "c": "'q'"}) == {"a": [1, 2], "b": "x", "c": "q"}
    assert records.set_matrix({}, "m", [[1, 2], [3, 4]]) == {"m": [{"row": [1, 2]}, {"row": [3, 4]}]} and records.matrix_of({"m": [{"row": [1, 2]}]}, "m") == [[1, 2]]


def test_settings_come_in_layers(monkeypatch, tmp_path):
    monkeypatch.setenv("APP_B", "7")
    assert records.settings({"a": 1, "b": 2, "c": 3, "d": 4}, "app", {"c": 8}, {"d": 9}) == {"a": 1, "b": 7, "c": 8, "d": 9}
    s = tools.Settings({"a": 1.0, "b": "x"})
    s.set("a", 2)
    with pytest.raises(TypeError):
        s.set("b", 3)
    with pytest.raises(KeyError):
        s.get("z")
    s.save(tmp_path / "s.json")
    again = tools.Settings({"a": 1.0, "b": "x"})
    again.load(tmp_path / "s.json")
    assert again.all(overrides={"b": "y"}) == {"a": 2, "b": "y"}


def test_documentation_and_arguments():
    text = """Sum of numbers.

    Args:
        a (int): the first,
            at least one
        b: the second
    Returns:
        the sum
    @unit: m
    """
    d = records.docstring(text, "add")
    assert d["summary"] == "Sum of numbers." and d["parameters"] == [{"name": "a", "type": "int", "description": "the first, at least one"}, {"name": "b", "type": "", "description": "the second"}]
    assert records.doc_tags(text) == {"unit": "m"} and records.docstring(None)["summary"] == ""
    assert records.key_values('a=1 b="x y" c=[1, 2] d={"k": 1} e=text', {"a": "number"}) == {"a": 1.0, "b": "x y", "c": [1, 2], "d": {"k": 1}, "e": "text"}
    with pytest.raises(ValueError):
        records.key_values("a=1 stray")
    assert [records.coerce(v, k) for v, k in (("3", "integer"), ("1e2", "number"), ("yes", "boolean"), ("[1]", "array"), ("x", "string"))] == [3, 100.0, True, [1], "x"]
    with pytest.raises(ValueError):
        records.coerce("[1]", "object")
    calls = []
    assert records.retry(lambda: calls.append(1) or 1 / (len(calls) > 2), tries=5, delay=0.1, sleep=lambda s: None) == 1 and len(calls) == 3
    assert records.retry(lambda: 1 / 0, tries=2, sleep=lambda s: None) is None
    assert records.call(lambda a, b: a - b, {"a": 3, "b": 1}) == 2 and "add" in records.methods(tools.Arithmetic(None))


def test_actions_and_services():
    actions = {"go": {"category": "move", "requires": {"a": True}, "effect": {"b": True}}, "stay": {"category": "move"}, "eat": {"category": "need", "effect": {"c": False}}}
    assert records.actions_by_category(actions) == {"move": ["go", "stay"], "need": ["eat"]} and records.propositions(actions) == {"a", "b", "c"}
    assert records.by_input_type({"x": ["csv", "json"], "y": ["csv"]}, "json") == ["x"] and records.input_types({"x": ["csv", "json"], "y": ["csv"]}) == ["csv", "json"]
    assert tools.collect_all(packages=["gramlake"])["arithmetic"] is tools.Arithmetic and not tools.collect_all(exclude=["arithmetic"])


def test_files(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    records.write_base64("data:text/plain;base64,aGVsbG8=", path)
    assert open(path).read() == "hello" and records.has_keyword(path, "ell") and not records.has_keyword(str(tmp_path / "no"), "x")
    records.add_line(path, "top")
    records.add_line(path, "hello")
    records.delete_line(path)
    assert open(path).read() == "top\n"
    os.makedirs(tmp_path / "d1" / "d2")
    (tmp_path / "d1" / "d2" / "deep.txt").write_text("x")
    assert records.find_items(str(tmp_path), "*.txt", 1) == [path] and len(records.find_items(str(tmp_path), "*.txt", 3)) == 2
    assert records.find_items(str(tmp_path), "d*", 2, files=False) == [str(tmp_path / "d1"), str(tmp_path / "d1" / "d2")]
    assert records.relative_path(path, str(tmp_path)) == "a.txt"
    assert records.entity_id("run", "n", dt.datetime(2024, 1, 2, 3, 4, 5), 1, "abcdefghij") == "run_20240102_030405_000000000001_7b8b965a_abcdefgh"
    for name in ("log_20240103_101500.csv", "log_20240101_000000.csv", "other.csv"):
        (tmp_path / name).write_text("a\n1\n")
    found = records.dated_paths(spark, str(tmp_path / "*.csv"))
    assert [r.name for r in found.collect()] == ["other.csv", "log_20240101_000000.csv", "log_20240103_101500.csv"]
    assert records.between_dates(found, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4)).count() == 1
    assert records.now(spark, "Asia/Tokyo").first()["now"].year >= 2024
    assert json.load(open(records.write_station_template(str(tmp_path))))["stations"][0]["name"] == "a"
    import zipfile

    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.json", '{"a": 1}')
    assert records.read_zipped_config(str(tmp_path / "c.zip")) == {"a": 1} and not [p for p in os.listdir(tmp_path) if p.startswith(".")]
    assert records.externalise({"t": [{"a": 1}]}, "t", str(tmp_path))["t"].endswith("t.csv")


def test_xml():
    assert records.text_of_xml("<a><b>1</b><b>2</b></a>") == {"a": {"b": ["1", "2"]}} and records.xml_of({"b": 1}, "a") == "<a><b>1</b></a>"
    import xml.etree.ElementTree as ET

    root = ET.fromstring("<a><b k='1'><c>x</c></b><b k='2'><c>y</c></b></a>")
    assert [e.get("k") for e in records.xml_elements(root, "/a/b", "c", "y")] == ["2"] and records.xml_numbers("1 2.5") == [1.0, 2.5]
    assert len(records.find(root, "//b")) == 2 and records.find(root, "/z/b") == []


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b & \"c\"", 2.5, None), (2, None, -1e-9, True)], "i int, s string, d double, b boolean")
    one = workbooks.write_workbook({"first": df, "it's": df.select("i", "d")}, str(tmp_path / "one.xlsx"), {"it's": (0, [1])})
    assert workbooks.sheet_names(spark, one) == ["first", "it's"]
    back = workbooks.read_workbook(spark, one)["first"].collect()
    assert [tuple(r) for r in back] == [("1", 'a<b & "c"', "2.5", None), ("2", None, "-1e-09", "1")]
    csv = str(tmp_path / "t.csv")
    with open(csv, "w") as f:
        f.write("i,d\n5,6\n")
    two = workbooks.delimited_to_workbook(spark, [csv], str(tmp_path / "two.xlsx"))
    three = workbooks.merge_workbooks(spark, [one, two, two], str(tmp_path / "three.xlsx"))
    assert workbooks.sheet_names(spark, three) == ["first", "it's", "t", "two_t"] and workbooks.sheet_names(spark, csv) == ["Sheet1"]
    assert workbooks.read_all_sheets(spark, two).collect()[0]["d"] == "6"
    assert workbooks.sheet_rows(spark, str(tmp_path / "*.xlsx")).select("path", "sheet").distinct().count() == 7
    assert [workbooks.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and workbooks.column_number("AAA") == 702


def test_secured_engine_and_interpreter(spark):
    e = tools.Arithmetic(spark, token="secret")
    assert e.invoke("add", a=1.0) == {"value": 2.0}
    with pytest.raises(PermissionError):
        e.invoke("half", value=2.0)
    assert e.invoke("half", token="secret", value=2.0) == {"value": 1.0}
    assert e.begin_job("j").startswith("j-") and e.trace().count() == 3
    assert list(tools.interpret(tools.Arithmetic(spark), ["help", "add a=2 b=3", "# no", "bad", "quit", "add a=1"])) == ['["add", "half"]', '{"value": 5}', "error: KeyError: \"unknown command bad; there are ['add', 'half']\""]
    schema = tools.tool_schemas(e)[0]
    assert schema["name"] == "add" and schema["parameters"]["required"] == ["a"] and schema["parameters"]["properties"]["a"]["type"] == "number"
    assert ("Arithmetic", "add") in tools.snapshot([e])


def test_command_line(spark, tmp_path):
    assert "fitModel" in modelling.run(spark, ["info"])["commands"] and modelling.run(spark, ["template", str(tmp_path)])["manifest"].endswith("stations.json")
    with pytest.raises(ValueError):
        modelling.run(spark, ["nothing"])


def test_short_forms_fit(spark):
    r = np.random.default_rng(0)
    x = np.sort(r.random((40, 1)), axis=0) * 4 + 0.5
    y = np.sin(x[:, 0]) + 2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:, 0], y, strict=True)], "x double, y double")
    for spec, bound in (("gp", 0.01), ("tps", 0.02), ("rbf-smooth", 0.02), ("pspline", 0.05), ("pce5", 0.02), ("ortho6", 0.02), ("median", 0.5), ("poly5", 0.02), ("saturation", 1.0)):
        m = modelling.fit_any(df, ["x"], "y", spec)
        assert m.predict(df).select(F.sqrt(F.avg((F.col("mean") - F.col("y")) ** 2))).first()[0] < bound, spec
    assert modelling.default_candidates(1000, 1) == ["poly1", "poly2", "poly3", "poly4", "poly5", "pspline"]
