"""PDF files and images written here byte by byte."""

import struct
import time
import zlib

import pyarrow as pa
import pytest
from casefile.plans.registry_sources import pdf_file
from casefile.sources import batches, images, pdf


def assembled(objects, trailer, head=b"%PDF-1.5\n"):
    """Objects with a cross-reference table."""
    out, places = head, {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    table = b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in places.items())
    return out + b"xref\n" + table + b"trailer\n" + trailer + b"\nstartxref\n%d\n%%%%EOF\n" % len(out)


def stream(data, extra=b"", packed=True):
    data = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\r\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if packed else b"", extra, data)


def test_pages_in_the_order_of_the_tree():
    assert pdf.page_texts(pdf_file(["one", "two \\(x\\) \\101", "three"])) == ["one", "two (x) A", "three"]


def test_strings_maps_forms_and_arrays():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <0059>] endbfrange"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 9 0 R 2 0 R]/Count 2/Resources<</Font<</F1 5 0 R>>/XObject<</X 7 0 R>>>>>>",
        3: b"<</Type/Page/Contents[4 0 R 8 0 R]>>", 4: stream(b"BT /F1 12 Tf <0001 0002> Tj [<0010> -300 <0012>] TJ 0 -14 Td <00200021> Tj ET % (no)\n /X Do"),
        5: b"<</Type/Font/Subtype/Type0/ToUnicode 6 0 R>>", 6: stream(cmap), 7: stream(b"BT (form \\\n(in) \\061) Tj ET /X Do", b"/Subtype/Form"), 8: stream(b"BI /W 1 ID \x00(x) Tj EI BT /F2 1 Tf (plain) ' ET", packed=False), 9: b"<</Type/Page/Contents 99 0 R>>",
    }
    assert pdf.page_texts(assembled(objects, b"<</Root 1 0 R>>")) == ["Afia c XY form (in) 1 plain", ""]


def test_last_revision_and_its_information():
    first = pdf_file(["old"], {"Author": "A", "Producer": "P"})
    at = len(first)
    body = b"\n3 0 obj\n<< /Author <FEFF00C9> /Creator (C) >>\nendobj\n"
    table = at + len(body)
    prev = int(first.rpartition(b"startxref\n")[2].split()[0])
    second = first + body + b"xref\n3 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Info 3 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at + 1, prev, table)
    found = pdf.properties(second)
    assert (found["Author"], found["Creator"], found["updates"], found["pages"]) == ("É", "C", 1, 1) and "Producer" not in found
    assert pdf.page_texts(second) == ["old"]


def test_object_streams_and_predictors():
    inner = b"1 0 2 40 3 90 " + b"<</Type/Catalog/Pages 2 0 R>>".ljust(40) + b"<</Type/Pages/Kids[3 0 R]/Count 1>>".ljust(50) + b"<</Type/Page/Contents 5 0 R>>"
    head = b"%PDF-1.5\n"
    parts = {4: stream(inner, b"/Type/ObjStm /N 3 /First 14"), 5: stream(b"BT (packed) Tj ET")}
    places, out = {}, head
    for number, body in parts.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, places[4], 0), (1, places[5], 0), (1, len(out), 0)]
    raw = [struct.pack(">BHB", *r) for r in rows]
    up = [bytes([2]) + bytes((a - b) & 255 for a, b in zip(row, before, strict=True)) for row, before in zip(raw, [bytes(4), *raw], strict=False)]
    table = stream(b"".join(up), b"/Type/XRef/W[1 2 1]/Size 7/Root 1 0 R/DecodeParms<</Predictor 12/Columns 4>>")
    whole = out + b"6 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (table, len(out))
    assert pdf.page_texts(whole) == ["packed"]
    assert pdf.page_texts(whole.replace(b"startxref", b"startxxxx")) == ["packed"]  # read by marks


@pytest.mark.parametrize("bad", [b"", b"%PDF-1.4", b"%PDF-1.4 words but no objects", b"%PDF-1.4\n1 0 obj <</Type/Catalog", b"%PDF 1 0 obj (", assembled({1: b"<</Type/Catalog>>"}, b"<</Root 1 0 R/Encrypt 2 0 R>>")])
def test_broken_files_say_so(bad):
    with pytest.raises(pdf.Broken):
        pdf.page_texts(bad)


@pytest.mark.parametrize("hard", [b"%PDF" + b"[" * 200_000, b"%PDF" + b"<<" * 200_000, b"%PDF" + b"1 0 obj (" * 20_000, b"%PDF" + b"(" * 200_000, b"%PDF" + b"1 0 obj\n" * 30_000, b"%PDF" + b" " * 500_000 + b"%" * 500_000])
def test_time_in_proportion(hard):
    began = time.perf_counter()
    with pytest.raises(pdf.Broken):
        pdf.page_texts(hard)
    assert time.perf_counter() - began < 10


def tiff(order, entries, extra=b""):
    """A TIFF with one directory at 8 and what its entries point to behind it."""
    out = (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "I", 8) + struct.pack(order + "H", len(entries))
    for tag, kind, n, value in entries:
        out += struct.pack(order + "HHI", tag, kind, n) + (value if isinstance(value, bytes) else struct.pack(order + "I", value)).ljust(4, b"\x00")
    return out + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_and_place(order):
    base = 8 + 2 + 4 * 12 + 4
    exif_at, gps_at = base + 20, base + 20 + 18
    taken_at, rationals = gps_at + 2 + 4 * 12 + 4, gps_at + 2 + 4 * 12 + 4 + 20
    exif = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, 20, taken_at) + struct.pack(order + "I", 0)
    gps = struct.pack(order + "H", 4) + struct.pack(order + "HHI", 1, 2, 2) + b"S\x00\x00\x00" + struct.pack(order + "HHII", 2, 5, 3, rationals) + struct.pack(order + "HHI", 3, 2, 2) + b"E\x00\x00\x00" + struct.pack(order + "HHII", 4, 5, 3, rationals) + struct.pack(order + "I", 0)
    extra = b"Adobe Photoshop\x00".ljust(20, b"\x00") + exif + gps + b"2024:01:02 03:04:05\x00" + struct.pack(order + "6I", 12, 1, 30, 1, 36, 1)
    entries = [(0x0131, 2, 16, base), (0x0112, 3, 1, struct.pack(order + "H", 6)), (0x8769, 4, 1, exif_at), (0x8825, 4, 1, gps_at)]
    data = tiff(order, entries, extra)
    found = images.inspect(data)
    assert (found["software"], found["orientation"], found["taken"], found["latitude"], found["longitude"]) == ("Adobe Photoshop", 6, "2024:01:02 03:04:05", -12.51, 12.51)
    segment = b"Exif\x00\x00" + data
    picture = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + b"\xff\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00" + b"\xff\xda\x00\x02xx"
    found = images.inspect(picture)
    assert (found["kind"], found["width"], found["height"], found["latitude"]) == ("JPEG", 32, 16, -12.51)


def test_images_as_a_table(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\x00" * 4
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 3, 2) + b"\x08\x02\x00\x00\x00") + chunk(b"tEXt", b"Software\x00GIMP 2") + chunk(b"IEND", b"")
    loop = tiff("<", [(0x8769, 4, 1, 8)])
    rows = [("p", png), ("l", loop), ("t", b"II*\x00\xff\xff\xff\x7f"), ("j", b"\xff\xd8\xff\xe1\xff\xff"), ("x", b"text"), ("n", None), ("o", tiff(">", [(0x0131, 2, 9, 5000)]))]
    got = {r["path"]: r for r in images.properties(spark.createDataFrame(rows, "path string, content binary").selectExpr("*", "1 AS kind", "2 AS error")).collect()}
    assert (got["p"].kind, got["p"].width, got["p"].height, got["p"].software, got["p"].edited, got["p"].error) == ("PNG", 3, 2, "GIMP 2", True, None)
    assert "back to itself" in got["l"].error and all(got[k].error and got[k].kind is None and not got[k].edited for k in "ltjxno")


def test_images_in_batches_of_bounded_size(spark, monkeypatch):
    made = []
    plain = pa.RecordBatch.from_arrays
    monkeypatch.setattr(images, "batched", lambda *given: (made.append(b.num_rows) or b for b in batches.batched(*given)))
    monkeypatch.setattr(spark.createDataFrame([], "a int").__class__, "mapInArrow", lambda df, work, schema: spark.createDataFrame(pa.Table.from_batches(list(work(iter([plain([pa.array(["a", "b", None]), pa.array([b"x", None, b"II*\x00"])], ["path", "content"])])))).to_pylist(), schema))
    assert [r.path for r in images.properties(spark.createDataFrame([("x", b"x")], "path string, content binary")).collect()] == ["a", "b", None] and made == [3]
    rows = [("a", 1), ("bb", 2), (None, 3), ("dddd", 4), ("e", None)]
    got = list(batches.batched(iter(rows), ["s", "n"], [pa.string(), pa.int32()], 3, 4))
    assert [b.num_rows for b in got] == [3, 1, 1] and [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
    assert list(batches.batched(iter([]), ["s"], [pa.string()])) == []
