import io
import json
import xml.dom.minidom
import zipfile

from lectern.sinks import docx as D
from lectern.sources import completions, files, registry

ROW = {"number": 1, "deviceName": " Pump & Co ", "maintenanceType": "Care", "maintenanceWorkDescription": ["wipe <it>", "dry"], "registrationNumber": "R1", "frequency": "daily"}
PLAN = {"sections": [{"name": "S", "rows": [ROW, ROW | {"number": 2, "registrationNumber": None}]}], "consumables": [{"name": "cloth"}]}


def test_files(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b b%20.pdf": b"", "e e.pdf": b"%PDF-", "c.pdf": b"text", "d.txt": b"%PDF-"}.items():
        (tmp_path / name).write_bytes(data)
    good, bad = files.read_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in good.collect()) == ["a.pdf", "e e.pdf"]
    assert sorted((r.path.rsplit("/", 1)[1], r.error) for r in bad.collect()) == [("b b%20.pdf", "FILE_EMPTY"), ("c.pdf", "UNSUPPORTED_FILE_TYPE")]


def test_registry(spark):
    answer = {"content": [{"id": 1, "noRu": "N1", "name": "A", "producer": {"name": "P"}, "status": {"code": "ACTIVE"}, "endDateRu": "2030-01-02"}, {"id": 2, "noRu": " ", "name": "B"}, {"id": 3, "noRu": "N3", "name": "C", "endDateRu": "soon"}]}
    got = registry.read_records(spark.createDataFrame([(json.dumps(answer),), ("bad",), (None,)], "json string")).collect()
    assert [(r.id, r.registration, r.producer, r.active, str(r.expires)) for r in got] == [(1, "N1", "P", True, "2030-01-02"), (3, "N3", None, False, "None")]


def test_completions(spark):
    def answer(prompt):
        return {"a": "fine", "b": " "}[prompt]

    got = completions.complete(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, prompt string"), answer)
    assert {r.id: (r.content, r.error) for r in got.collect()} == {1: ("fine", None), 2: (None, completions.INVALID), 3: (None, "KeyError"), 4: (None, completions.INVALID)}


def test_docx(spark, tmp_path):
    plans = spark.createDataFrame([("a", json.dumps(PLAN)), ("b", "no json"), ("c", None), ("d", '{"sections": []}')], "plan string, json string")
    got = {r.plan: r for r in D.render_plans(plans).collect()}
    assert [k for k, r in got.items() if r.error is None] == ["a"] and got["a"].docx == D.docx(PLAN)
    with zipfile.ZipFile(io.BytesIO(bytes(got["a"].docx))) as z:
        doc = xml.dom.minidom.parseString(z.read("word/document.xml"))
    rows = doc.getElementsByTagName("w:tr")
    assert len(rows) == 3 and len(doc.getElementsByTagName("w:tblHeader")) == 1
    assert [m.getAttribute("w:val") for m in doc.getElementsByTagName("w:vMerge")] == ["restart"] * 3 + ["continue"] * 3
    assert "— wipe <it>" in [t.firstChild.data for t in doc.getElementsByTagName("w:t") if t.firstChild]
    body = bytes(got["a"].multipart)
    assert body.count(b"Content-Disposition") == 3 and bytes(got["a"].docx) in body and body.endswith(b"--\r\n")
    named = D.render_plans(plans).selectExpr("concat(plan, '.docx') AS name", "docx AS content")
    assert [tuple(r) for r in D.write_files(named, f"file://{tmp_path}/out").collect()] == [("a.docx", len(got["a"].docx))]
    assert (tmp_path / "out" / "a.docx").read_bytes() == bytes(got["a"].docx)
