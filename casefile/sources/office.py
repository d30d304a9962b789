"""Office files as rows: sheets, word tables, properties. A file is one row of ``binaryFile``; helpers open its ZIP."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.sources import pdf

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, length of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content", "length")


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of all worksheets in the workbook's order; parts that no workbook names come last, by number."""
    parts = {n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)}
    found: list[tuple[str, str]] = []
    if "xl/workbook.xml" in z.namelist() and "xl/_rels/workbook.xml.rels" in z.namelist():
        target = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            part = target.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), None), "").lstrip("/")
            part = part if part.startswith("xl/") else f"xl/{part}"
            if part in parts:
                found.append((e.get("name", ""), part))
    rest = sorted(parts - {p for _, p in found}, key=lambda n: (len(n), n))
    return found + [(n.rpartition("/")[2].removesuffix(".xml"), n) for n in rest]


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
        if si.tag == f"{SHEET}si":
            out.append("".join(t.text or "" for t in si.iter(f"{SHEET}t")))
            si.clear()
    return out


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells as text) of every worksheet; a string that the file does not have is null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = shared_strings(z)

        def text_of(c: ElementTree.Element) -> str | None:
            value, kind = c.find(f"{SHEET}v"), c.get("t")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
            if value is None or value.text is None or kind != "s":
                return None if value is None else value.text
            return shared[int(value.text)] if value.text.isdigit() and int(value.text) < len(shared) else None

        for name, part in sheet_names(z):
            for _, row in ElementTree.iterparse(z.open(part)):
                if row.tag != f"{SHEET}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{SHEET}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = text_of(c)
                yield name, int(row.get("r", 0)), cells
                row.clear()


def table_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """("", row number, cells) of all tables of a word document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        n = 0
        for row in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{WORD}tr"):
            n += 1
            yield "", n, ["".join(t.text or "" for t in cell.iter(f"{WORD}t")) for cell in row.iter(f"{WORD}tc")]


#: What a broken file raises.
BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, NotImplementedError, zlib.error)


def explode_rows(files: DataFrame, kind: str) -> DataFrame:
    """path, sheet, row, cells, error of sheets (kind xlsx) or word tables (docx).

    A file that breaks off gives the rows before that and one more with ``error`` and without cells.
    """
    reader = {"xlsx": sheet_rows, "docx": table_rows}[kind]
    names = ["path", "sheet", "row", "cells", "error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []

                def flush() -> pa.RecordBatch:
                    columns = list(zip(*rows, strict=True))  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

                try:
                    for sheet, n, cells in reader(content.as_py()):
                        rows.append((path.as_py(), sheet, n, cells, None))
                        if len(rows) == 5_000:
                            yield flush()
                            rows = []
                except BROKEN as e:
                    rows.append((path.as_py(), None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield flush()

    return files.select("path", "content").mapInArrow(work, "path string, sheet string, row int, cells array<string>, error string")


def with_header(rows: DataFrame, words: tuple[tuple[str, ...], ...] = (("date",), ("amount", "debit", "credit", "withdrawal", "deposit")), search: int = 15) -> DataFrame:
    """path, sheet, row, record (header to cell): a sheet's header is the first of ``search`` rows with a cell for each group of words."""
    lowered = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    has = None
    for group in words:
        one = F.exists(lowered, _contains_any(group))
        has = one if has is None else has & one
    head = rows.filter((F.col("row") <= search) & has).groupBy("path", "sheet").agg(F.min_by(F.struct("row", "cells"), "row").alias("h"))
    body = rows.join(head, ["path", "sheet"]).filter(F.col("row") > F.col("h.row"))
    names = F.transform("h.cells", lambda c: F.coalesce(F.trim(c), F.lit("")))
    pairs = F.filter(F.arrays_zip(names.alias("k"), F.col("cells").alias("v")), lambda p: F.coalesce(p["k"], F.lit("")) != "")
    return body.select("path", "sheet", "row", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"]))).alias("record"))


def _contains_any(words: tuple[str, ...]):
    def test(cell):
        out = F.contains(cell, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(cell, F.lit(w))
        return out

    return test


# Properties by the names that files give them.
PDF_PROPERTIES = {"Producer": "software", "Creator": "software", "Author": "author", "CreationDate": "created", "ModDate": "modified"}
OFFICE_PROPERTIES = {"creator": "author", "created": "created", "modified": "modified", "Application": "software", "revision": "revision", "TotalTime": "minutes", "Company": "company", "lastModifiedBy": "editor"}
OFFICE_PARTS = ("docProps/core.xml", "docProps/app.xml")


def properties_of(data: bytes) -> dict[str, object]:
    """What a PDF or office file says of itself; other files say nothing."""
    if data[:4] == b"%PDF":
        told = pdf.properties(data)
        return {"kind": "PDF", "updates": told["updates"], "pages": told["pages"]} | {name: told[key] for key, name in PDF_PROPERTIES.items() if key in told}
    found: dict[str, object] = {}
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for part in set(OFFICE_PARTS) & set(z.namelist()):
                for _, e in ElementTree.iterparse(z.open(part)):
                    name = OFFICE_PROPERTIES.get(e.tag.rpartition("}")[2])
                    if name and e.text:
                        found[name] = e.text
        found["kind"] = "OFFICE"
    return found


def properties(files: DataFrame) -> DataFrame:
    """path, sha256, kind, author, created, modified, software, revision, minutes, company, editor, updates, pages, error of office files and PDFs.

    updates: ends of file in a PDF beyond the first, each an incremental save. A broken file gives ``error`` and nothing else.
    """
    columns = ("kind", "author", "created", "modified", "software", "revision", "minutes", "company", "editor", "error")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch.content:
                try:
                    out.append(properties_of(bytes(content or b"")))
                except BROKEN as e:
                    out.append({"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({"path": batch.path, "sha256": batch.sha256, **{c: [f.get(c) for f in out] for c in columns}, "updates": [int(f.get("updates", 0)) for f in out], "pages": [f.get("pages") for f in out]})

    schema = "path string, sha256 string, " + ", ".join(f"{c} string" for c in columns) + ", updates int, pages int"
    raw = files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(work, schema)
    return raw.withColumn("created", document_date("created")).withColumn("modified", document_date("modified")).withColumn("revision", F.col("revision").try_cast("int")).withColumn("minutes", F.col("minutes").try_cast("int"))


def document_date(c: str):
    """D:YYYYMMDDHHmmSS with an offset, or ISO time."""
    digits = F.regexp_extract(c, r"^D?:?(\d{14})", 1)
    zone = F.regexp_replace(F.regexp_extract(c, r"^D?:?\d{14}([+-]\d{2}'?\d{2})", 1), "'", "")
    pdf = F.coalesce(F.try_to_timestamp(F.concat(digits, zone), F.lit("yyyyMMddHHmmssxx")), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))
    return F.coalesce(pdf, F.try_to_timestamp(F.col(c)))
