"""Scanners and readers on small files worked out by hand."""

import io
import zipfile

import pyarrow as pa
from __spark_entry__ import queries
from casefile.session import put, work_dir
from casefile.sources import batches, ledger, office, scan
from pyspark.sql import functions as F


def zipped(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return data.getvalue()


def test_pages_of_archives_in_archives_and_broken_files(spark):
    folder = work_dir(spark, "t")
    deep = zipped({"in.txt": "deepest"})
    for _ in range(4):
        deep = zipped({"z.zip": deep})
    files = {
        "a.txt": b"one\ftwo", "b.bin": b"\x00" * 100, "c.zip": zipped({"x/y.txt": "inner", "s.pptx": zipped({"ppt/slides/slide1.xml": "<a>slide &amp; text</a>"})}), "d.zip": b"PK\x03\x04broken", "e.zip": deep,
        "f.pdf": b"%PDF-1.4 no streams but readable words", "h.txt": "café".encode("latin-1"),
    }
    for name, data in files.items():
        put(spark, f"{folder}/{name}", data)
    got = scan.pages(scan.walk(spark, folder)).withColumn("f", F.substring_index("path", "/", -1)).collect()
    rows = {(r.f, r.member, r.page): (r.kind, r.text) for r in got if r.error is None}
    assert rows["a.txt", "", 1] == ("TEXT", "one") and rows["a.txt", "", 2] == ("TEXT", "two") and rows["h.txt", "", 1][1].startswith("caf")
    assert rows["c.zip", "x/y.txt", 1] == ("ZIP", "inner") and rows["c.zip", "s.pptx", 1] == ("ZIP_OFFICE", "slide & text") and rows["c.zip", "x/y.txt", 0] == ("ZIP_NAME", "x/y.txt")
    assert "readable words" in rows["f.pdf", "", 1][1] and not [k for k in rows if k[0] == "b.bin"]
    errors = {r.f: r.error for r in got if r.error}
    assert set(errors) == {"d.zip", "f.pdf"} and rows["e.zip", "z.zip -> z.zip -> z.zip -> z.zip -> in.txt", 1] == ("ZIP", "deepest")
    failed = scan.hits(scan.walk(spark, folder), ["zzz"]).collect()
    assert {(r.path.rsplit("/", 1)[1], r.match_type, r.keyword) for r in failed} == {("d.zip", "ERROR", None), ("f.pdf", "ERROR", None)}
    small = [r for r in scan.pages(scan.walk(spark, folder, extensions=[".txt", ".pdf", ".bin"]), most=8).collect() if r.error and "more than is allowed" in r.error]
    assert {r.path.rsplit("/", 1)[1] for r in small} == {"c.zip", "e.zip"}
    assert scan.hits(scan.walk(spark, folder, extensions=[".zip", ".pdf"]), ["TWO"]).select("match_type", "page", "snippet").collect() == [("TEXT_CONTENT", 2, "two")]


def test_sheets_with_bad_strings_and_many_parts(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {f"xl/worksheets/sheet{i}.xml": f'<worksheet {main}><sheetData><row r="1"><c r="B1" t="s"><v>{i - 9}</v></c></row></sheetData></worksheet>' for i in (10, 9)}
    parts["xl/sharedStrings.xml"] = f"<sst {main}><si><t>only</t></si></sst>"
    bad = {"xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c'}
    rows = [("g", zipped(parts)), ("b", zipped(bad)), ("n", b"")]
    got = office.explode_rows(spark.createDataFrame(rows, "path string, content binary"), "xlsx").collect()
    assert [(r.sheet, r.row, r.cells) for r in got if r.path == "g"] == [("sheet9", 1, [None, "only"]), ("sheet10", 1, [None, None])]
    assert [(r.cells, bool(r.error)) for r in got if r.path == "b"] == [(["x"], False), (None, True)] and [bool(r.error) for r in got if r.path == "n"] == [True]


def test_reports_and_masters(spark):
    path = work_dir(spark, "report")
    ledger.write_report(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "party string, amount double").coalesce(1), path, {"party": "Party Name", "amount": "Total"}, ["party"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("a", "1.0"), ("b", "2.0")]
    assert spark.read.option("header", True).csv(path).columns == ["Party Name", "Total"]
    assert ledger.master(spark, [None]).count() == 0


def test_pages_go_on_in_batches_of_bounded_size(spark, monkeypatch):
    made = []
    monkeypatch.setattr(scan, "batched", lambda rows, names, kinds: (made.append(b.num_rows) or b for b in batches.batched(rows, names, kinds, 3)))
    works = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, work, schema: works.append(work))
    scan.pages(spark.createDataFrame([("a", b"x")], "path string, content binary"))
    given = pa.RecordBatch.from_arrays([pa.array(["a", "b", "n"]), pa.array([b"1\f2\f3", b"4", None])], ["path", "content"])
    got = [r for b in works[0](iter([given])) for r in b.to_pylist()]
    assert [(r["path"], r["page"], r["text"]) for r in got] == [("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("b", 1, "4"), ("n", 1, "")] and made == [3, 2]


def test_texts_of_files_stay_off_the_driver(spark):
    assert "Broadcast" not in queries()["document_properties"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
