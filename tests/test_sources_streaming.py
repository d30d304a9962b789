import datetime as dt
import io
import zipfile

import pytest
from casefile.plans import registry_sources
from casefile.sources import lines, office, tables
from casefile.streaming import flows
from pyspark.sql import functions as F


def files(spark, *bodies):
    return spark.createDataFrame([(f"f{i}", b) for i, b in enumerate(bodies)], "path string, body string")


def test_chat_export(spark):
    body = """12/01/2024, 10:05 - Messages are end-to-end encrypted.
12/01/2024, 10:06 - P One: hello
and more: of it
12/01/2024, 10:07 - P Two: <Media omitted>
12/01/2024, 10:08 - P One: This message was deleted
[13/01/24, 9:15:30 PM] P Two: bye"""
    got = lines.parse_chat(files(spark, "banner\n" + body, None), ["path"]).orderBy("seq").collect()
    assert [(r.sender, r.text, r.kind, r.media, r.deleted) for r in got] == [
        (None, "Messages are end-to-end encrypted.", "SYSTEM", None, False), ("P One", "hello\nand more: of it", "USER", None, False), ("P Two", "<Media omitted>", "USER", "IMAGE", False),
        ("P One", "This message was deleted", "USER", None, True), ("P Two", "bye", "USER", None, False),
    ]
    assert got[1].sent_at == dt.datetime(2024, 1, 12, 10, 6) and got[4].sent_at == dt.datetime(2024, 1, 13, 21, 15, 30)


def test_chat_json(spark):
    a = '{"messages": [{"sender_name": "P", "sent_at": "2024-01-02T03:04:05", "message_text": "x"}, {"from": "Q", "date": "nonsense", "text": "y"}]}'
    b = '[{"sender": "R", "timestamp": "1700000000", "message": "z"}]'
    got = lines.parse_chat_json(files(spark, a, b, "no json"), ["path"]).orderBy("path", "seq").collect()
    assert [(r.path, r.seq, r.sender, r.text) for r in got] == [("f0", 1, "P", "x"), ("f0", 2, "Q", "y"), ("f1", 1, "R", "z"), ("f2", None, None, None)]
    assert got[3].error == "Expecting value at character 0" and got[0].error is None
    odd = lines.parse_chat_json(files(spark, None, " ", '{"messages": 3}', '[{"text": ["a", {"type": "bold", "text": "b"}, {"x": 1}]}, {"text": "[x"}', '[{"text": ["a", {"type": "bold", "text": "b"}, {"x": 1}]}, {"text": "[x"}]'), ["path"]).orderBy("path", "seq").collect()
    assert [(r.path, r.seq, r.text, r.error) for r in odd] == [("f2", None, None, "no list of messages"), ("f3", None, None, "Expecting ',' delimiter at character 73"), ("f4", 1, "ab", None), ("f4", 2, "[x", None)]
    assert got[0].sent_at == dt.datetime(2024, 1, 2, 3, 4, 5) and got[1].sent_at is None and got[2].sent_at.year == 2023


def test_transcripts(spark):
    vtt = "WEBVTT\n\n00:01:10.500 --> 00:01:15.000\n<v P One>Hello there</v>\n\n00:02:00.000 --> 00:02:01.000\nno name here"
    inline = "[02:30] P Two: about the price\n[02:40] fine"
    got = lines.parse_transcript(files(spark, vtt, inline), ["path"]).orderBy("path", "seq").collect()
    assert [(r.path, r.starts, r.ends, r.speaker, r.text) for r in got] == [
        ("f0", 70.5, 75.0, "P One", "Hello there"), ("f0", 120.0, 121.0, "Speaker 2", "no name here"), ("f1", 150.0, 155.0, "P Two", "about the price"), ("f1", 160.0, 165.0, "Speaker 2", "fine")
    ]


def test_files_in_ranges_equal_whole_texts(spark, tmp_path):
    """A record, a transcript's segment and a count go on across the ends of ranges of a few bytes."""
    chat = "banner\r\n" + "".join(f"{1 + i % 28:02d}/01/2024, 10:{i % 60:02d} - P {i % 3}: said {i}\r\n" + "more é\n" * (i % 4) + "\n" * (i % 2) for i in range(150))
    vtt = "\ufeffWEBVTT\n\n" + "".join(f"00:{i // 60:02d}:{i % 60:02d}.000 --> 00:{i // 60:02d}:{i % 60:02d}.500\n\n{'<v Anna>' if i % 3 else ''}line {i}\n\n" for i in range(120)) + "[59:01] inline"
    (tmp_path / "chat.txt").write_bytes(chat.encode())
    (tmp_path / "t.vtt").write_bytes(vtt.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        assert lines.read_lines(spark, str(tmp_path / "chat.txt")).select("block").distinct().count() > 30
        got = [r[1:] for r in lines.read_chat(spark, str(tmp_path / "chat.txt")).orderBy("seq").collect()]
        cues = [r[1:] for r in lines.read_transcript(spark, str(tmp_path / "t.vtt")).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [r[1:] for r in lines.parse_chat(files(spark, chat.removesuffix("\n")), ["path"]).orderBy("seq").collect()] and len(got) == 150
    assert cues == [r[1:] for r in lines.parse_transcript(files(spark, vtt.removeprefix("\ufeff")), ["path"]).orderBy("seq").collect()] and len(cues) == 121


def test_chats_one_after_the_other_in_a_file(spark, tmp_path, monkeypatch):
    """Titles, banners and messages go on across the ends of ranges; a chat may be empty or repeated."""
    chat = lambda n: "banner\n" * (n % 3) + "".join(f"{1 + i % 28:02d}/01/2024, 10:{i % 60:02d} - P {i % 3}: said {n} {i}\n" + "more\n" * (i % 3) for i in range(5 * (n % 4)))
    (tmp_path / "a.txt").write_text("01/01/2024, 10:00 - P: of no chat\n" + "".join(f"Chat: {n}\n{chat(n)}" for n in range(12)))
    (tmp_path / "b.txt").write_text(f"Chat: -7\n{chat(3)}Chat: 5\n")
    monkeypatch.setattr(registry_sources, "work_dir", lambda *_: str(tmp_path / "made"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        got = lines.read_chat(spark, str(tmp_path / "[ab].txt"), r"^Chat: (-?[0-9]+)$").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for n in range(12):
        want = [tuple(r)[1:] for r in lines.parse_chat(files(spark, chat(n).removesuffix("\n")), ["path"]).orderBy("seq").collect()] if n % 7 == 3 else None
        found = [tuple(r)[2:] for r in sorted(got, key=lambda r: r.seq) if r.chat == str(n) and r.path.endswith("a.txt")]
        assert len(found) == 5 * (n % 4) and want in (None, found)
    assert sorted(r.seq for r in got if r.path.endswith("b.txt")) == list(range(1, 16)) and {r.chat for r in got if r.path.endswith("b.txt")} == {"-7"}
    registry_sources.chat_files(spark, "/root/testdata/sf0.01")
    assert 0 < len(list((tmp_path / "made").rglob("part-*"))) <= 4  # for 100 conversations


def test_texts_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_LINES", 3)
    body = "\n".join(f"0{1 + i % 9}/02/2024 UPI {i}\n\n some one {i}.00 98,500.00 Dr" for i in range(40))
    got = lines.parse_statement_lines(files(spark, body, None, "").withColumn("n", F.lit(1)).withColumn("c0", F.lit(2)).drop("n", "c0"), ["path"]).orderBy("row_order").collect()
    assert [(r.row_order, r.narration, float(r.debit)) for r in got] == [(i + 1, f"UPI {i} some one", float(i)) for i in range(40)]


def test_statement_text(spark):
    body = "HEADER\n01/02/2024 UPI to\n some one 1,500.00 98,500.00 Dr\n02/02/2024 SALARY 5,000.00 1,03,500.00 Cr\n03/02/2024 broken"
    got = lines.parse_statement_lines(files(spark, body), ["path"]).orderBy("row_order").collect()
    assert [(r.narration, float(r.debit), float(r.credit), float(r.balance)) for r in got] == [("UPI to some one", 1500.0, 0.0, 98500.0), ("SALARY", 0.0, 5000.0, 103500.0)]


def test_statement_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Date,Narration,Transaction ID,Debit Amount,Credit Amount,Closing Balance\n05-01-2024 10:00,UPI/x,T1,"₹1,200.50",,INR 10\n31/02/2024,bad day,T2,abc,7,\n')
    got = tables.read_statement_csv(spark, str(tmp_path / "s.csv")).orderBy("reference").collect()
    assert [(r.narration, float(r.debit), float(r.credit), float(r.balance), r.party) for r in got] == [("UPI/x", 1200.5, 0.0, 10.0, None), ("bad day", 0.0, 7.0, 0.0, None)]
    assert got[0].txn_date == dt.datetime(2024, 1, 5) and got[1].txn_date is None


def test_scan_csv_round_trip(spark, tmp_path):
    path = tmp_path / "scan.csv"
    path.write_text('Timestamp,File Path,Matched Keyword,Match Type,File Size (Bytes),Last Modified Date,Snippet\n2024-01-02 03:04:05 UTC,/a/b.zip -> c.txt,cash,zip content,1.20 MB,02/01/2024 10:00,"x, y"\n2024,/q\n')
    got = tables.read_scan_csv(spark, str(path)).collect()
    assert [(r.path, r.keyword, r.match_type, r.size, r.snippet) for r in got] == [("/a/b.zip", "cash", "ZIP_CONTENT", 1, "x, y")]
    tables.write_hits_csv(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect()[0].k == "a"


def test_keyword_file(spark, tmp_path):
    (tmp_path / "k.txt").write_text('# note\nCash\n"two words"\ncash\n\n// x\nGift\n')
    assert [r.keyword for r in tables.keyword_list(spark, str(tmp_path / "k.txt")).orderBy("pos").collect()] == ["Cash", "two words", "Gift"]


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>45000</v></c><c r="C3"><v>12.5</v></c></row>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si><si><r><t>Debit </t></r><r><t>Amount</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="d" xmlns:t="t"><dc:creator>P</dc:creator><t:created>2024-01-02T03:04:05Z</t:created></c>')
        z.writestr("docProps/app.xml", "<p><Application>Sheets</Application><TotalTime>7</TotalTime></p>")
    return data.getvalue()


def test_office(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "bad.xlsx").write_bytes(b"PK nothing")
    (tmp_path / "c.pdf").write_bytes(registry_sources.pdf_file(["x"], {"Producer": "Tool", "CreationDate": "D:20240102030405+05'30'"}) + b" x %%EOF")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:d xmlns:w="{w}"><w:tbl><w:tr><w:tc><w:t>a</w:t><w:t>b</w:t></w:tc><w:tc/></w:tr></w:tbl></w:d>')
    rows = office.explode_rows(office.read_binary(spark, str(tmp_path), "*.xlsx"), "xlsx")
    got = office.with_header(rows).collect()
    assert [(r.row, r.record) for r in got] == [(3, {"Date": "45000", "Debit Amount": "12.5"})]
    assert [r.cells for r in office.explode_rows(office.read_binary(spark, str(tmp_path), "*.docx"), "docx").collect()] == [["ab", ""]]
    found = {r.path.rsplit("/", 1)[1]: r for r in office.properties(office.read_binary(spark, str(tmp_path))).collect()}
    assert (found["a.xlsx"].kind, found["a.xlsx"].author, found["a.xlsx"].software, found["a.xlsx"].minutes) == ("OFFICE", "P", "Sheets", 7)
    assert found["c.pdf"].updates == 1 and found["c.pdf"].created.astimezone(dt.UTC) == dt.datetime(2024, 1, 1, 21, 34, 5, tzinfo=dt.UTC)
    assert found["bad.xlsx"].kind is None and len(found["bad.xlsx"].sha256) == 64 and "BadZipFile" in found["bad.xlsx"].error and found["c.pdf"].pages == 1


EVENTS = "event long, acc long, ts timestamp, amount double, leg string, module string"


def stream(spark, tmp_path, batches):
    """A file stream whose files are its micro-batches."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))


def drain(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_streamed_layering_keeps_state(spark, tmp_path):
    batches = [[(1, 7, at(0), 100.0, "IN", "m1"), (2, 7, at(1), 30.0, "OUT", "m1")], [(3, 7, at(2), 50.0, "OUT", "m2"), (4, 7, at(200), 9.0, "OUT", "m3")]]
    got = drain(spark, flows.layering(stream(spark, tmp_path, batches), "acc", "ts", "amount", "leg", "event"), tmp_path, "layers")
    assert sorted((r.in_event, r.out_event, r.dispatched) for r in got) == [(1, 2, 30.0), (1, 3, 50.0)]


def test_streamed_alert_comes_once(spark, tmp_path):
    batches = [[(1, 7, at(0), 1.0, "IN", "m1"), (2, 7, at(1), 1.0, "IN", "m2"), (2, 8, at(1), 1.0, "IN", "m2")], [(3, 7, at(2), 1.0, "IN", "m3")], [(4, 7, at(3), 1.0, "IN", "m4")]]
    got = drain(spark, flows.module_alerts(stream(spark, tmp_path, batches), "acc", "module"), tmp_path, "alerts")
    assert [(r.entity, r.modules) for r in got] == [("7", "m1,m2,m3")]


def test_windows_and_sessions(spark, tmp_path):
    batches = [[(1, 7, at(0), 100.0, "IN", ""), (2, 7, at(0.2), 30.0, "OUT", ""), (3, 7, at(5), 1.0, "OUT", "")], [(9, 9, at(90), 1.0, "IN", "")]]
    src = stream(spark, tmp_path, batches)
    got = drain(spark, flows.flow_windows(src, "acc", "ts", "amount", "leg", width="1 day", slide="1 day"), tmp_path, "windows")
    assert [(r.acc, r.inflow, r.outflow, r.n) for r in got] == [(7, 100.0, 31.0, 3)]
    got = drain(spark, flows.sessions(src, "acc", "ts"), tmp_path, "sess")
    assert sorted(r.n for r in got) == [1, 2]


def test_only_new_terms(spark):
    docs = spark.createDataFrame([(1, "Cash and cash"), (2, None)], "id int, t string")
    terms, old = (spark.createDataFrame([(x,) for x in xs], "term string") for xs in (["cash", "and", "zebra"], ["and"]))
    assert [tuple(r) for r in flows.search_new_terms(docs, old, terms, "id", "t").collect()] == [(1, "cash", 2)]
    assert flows.search_new_terms(docs, terms, terms, "id", "t").filter(F.lit(True)).count() == 0


@pytest.mark.parametrize("text", ["", None])
def test_empty_files(spark, text):
    f = files(spark, text)
    for parse in (lines.parse_chat, lines.parse_transcript, lines.parse_statement_lines, lines.parse_chat_json):
        assert parse(f, ["path"]).count() == 0


def test_ingest_in_batches_and_append(spark, tmp_path):
    """Three files in batches of one; a second run reads what is new only."""
    source, told = tmp_path / "in", []
    for i in range(3):
        spark.createDataFrame([(i, "x"), (i, "x"), (10 + i, "y")], "id int, t string").coalesce(1).write.mode("append").json(str(source))
    stream = lambda: spark.readStream.schema("id int, t string").option("maxFilesPerTrigger", 1).json(str(source))
    for _ in range(2):
        flows.ingest(stream(), str(tmp_path / "out"), str(tmp_path / "c1"), ["id"], lambda b, n: told.append((b, n))).awaitTermination(120)
    assert sorted(told) == [(0, 2), (1, 2), (2, 2)]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 10, 11, 12]
    flows.append_hits(stream(), str(tmp_path / "csv"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 9
