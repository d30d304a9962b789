"""BPE, language, extraction and WARC operators."""

import hashlib
import io
import random
import struct
import zipfile

import numpy as np
import pytest
from casefile.llm import bpe, extract, held, htmlpages, langid, warc
from casefile.llm.dom import parse
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def odd_texts():
    r = random.Random(2)
    out = ["", " ", "\n\n  x", "don't we'll", "a" * 3000, "ab" * 900, "<|endoftext|>", "é ß 漢字 🙂👩‍👩‍👧", "\x00\x1c\x85  x", "1234567 89"]
    for _ in range(300):
        pick = r.choice(["abeth in", "aab ", "".join(chr(r.randrange(32, 0x3000)) for _ in range(9)), "the and of ing"])
        out.append("".join(r.choice(pick) for _ in range(r.choice((3, 20, 90)))))
    return out


def test_bpe_equals_the_library(reference):
    codec = bpe.Codec(bpe.load_ranks(RANKS), PATTERN)
    for text in odd_texts():
        ids = codec.encode(text)
        assert list(ids) == reference.encode_ordinary(text)
        assert "".join(codec.decode(ids)) == text


def test_bpe_with_few_states_and_small_memory(reference, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_PIECES", 3)
    codec = bpe.Codec(bpe.load_ranks(RANKS), PATTERN)
    codec.transducer.max_states = 5
    for text in odd_texts():
        assert list(codec.encode(text)) == reference.encode_ordinary(text)
    assert len(codec.transducer.states) <= 5 and len(codec.new) <= 3


def test_bpe_decodes_across_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 1)
    codec = bpe.Codec(bpe.load_ranks(RANKS), PATTERN)
    ids = codec.encode("🙂 naïve 漢")
    assert "".join(codec.decode(ids)) == "🙂 naïve 漢"
    with pytest.raises(UnicodeDecodeError):
        list(codec.decode(codec.encode("🙂")[:1]))


def test_bpe_operator(spark, reference):
    rows = [(i, t, "n", "ids") for i, t in enumerate([*odd_texts()[:40], None])] + [(None, "x y", "", "")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string"), RANKS, PATTERN).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        want = reference.encode_ordinary(t or "")
        assert by[i].ids == want and by[i].n_tokens == len(want)
        assert by[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).collect() == []


def test_held_keeps_one_object():
    assert held.held("a", lambda: 1) == 1 and held.held("a", lambda: 2) == 1
    assert held.held("b", lambda: 3) == 3 and held.held("a", lambda: 4) == 4
    held.drop()
    assert held.held("a", lambda: 5) == 5
    held.drop()


# --- language ----------------------------------------------------------------------------------------------------


def phrases_by_hand(text, sample):
    """Greedy cross-parsing by substring search, lane by lane."""
    s, count = langid.symbols(text.encode()).tobytes(), 0
    for at in range(0, len(s), langid.LANE):
        lane, pos = s[at : at + langid.LANE], 0
        while pos < len(lane):
            n = 1
            while pos + n < len(lane) and lane[pos : pos + n + 1] in sample:
                n += 1
            pos += n
            count += 1
    return count


def test_parse_equals_substring_search(monkeypatch):
    monkeypatch.setattr(langid, "LANE", 50)
    monkeypatch.setattr(langid, "LANES", 3)
    r = random.Random(4)
    samples = tuple((n, langid.symbols(" ".join("".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(60)).encode()).tobytes()) for n, a in (("x", "abcd"), ("y", "cdeé")))
    texts = ["".join(r.choice("abcdeé 1Z") for _ in range(r.choice((0, 1, 7, 60, 400)))) for _ in range(60)]
    counts, sizes = langid.Parser(samples).phrases([langid.symbols(t.encode()) for t in texts])
    assert sizes.tolist() == [len(langid.symbols(t.encode())) for t in texts]
    assert counts.tolist() == [[phrases_by_hand(t, s) for _, s in samples] for t in texts]


def test_identify(spark):
    r = random.Random(1)
    words = {"aa": ["lo", "mira", "tana", "sol"], "bb": ["xik", "zork", "quev", "wub"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(60)), lang, "s") for i in range(60) for lang in words]
    rows += [(900, None, "aa", "s"), (901, "12 %%", "bb", "s"), (902, "", None, "s"), (None, "lo mira tana", None, "s"), (903, "Mira " * 50_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(x.doc_id, i): x for i, x in enumerate(langid.learn_and_identify(docs, F.col("doc_id") % 2 == 0).collect())}
    assert len(got) == len(rows)
    by = {}
    for (i, _), x in got.items():
        by.setdefault(i, []).append(x.lang_pred)
        assert 0 <= x.score <= 1
    assert by[900] == by[901] == by[902] == ["und"] and by[None] == ["aa"] and by[903] == ["aa"]
    want = {}
    for i, _, lang, _ in rows[:120]:
        want.setdefault(i, []).append(lang)
    assert all(sorted(by[i]) == sorted(want[i]) for i in want)
    assert {x.lang_pred for x in langid.learn_and_identify(docs.limit(0), F.lit(True)).collect()} == set()
    assert langid.identify(docs.limit(3), ()).select("lang_pred").distinct().collect()[0][0] == "und"


def test_a_language_with_a_short_sample():
    """A twentieth of the other's labelled text is enough: phrases are weighed by the sample's length."""
    r = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    own = {"long": syllables[:30], "short": syllables[30:]}
    made = lambda lang: "".join(r.choice(own[lang] if r.random() < 0.75 else syllables) for _ in range(3))
    say = lambda lang, n: " ".join(made(lang) for _ in range(n))
    parser = langid.Parser((("long", say("long", 6000).encode()), ("short", say("short", 300).encode())))
    texts = [(lang, say(lang, 40)) for lang in own for _ in range(60)]
    counts, _ = parser.phrases([langid.symbols(t.encode()) for _, t in texts])
    right = [np.mean([parser.languages[i] == lang for (lang, _), i in zip(texts, values.argmin(1), strict=True)]) for values in (counts * parser.weights, counts)]
    assert right[0] >= 0.95 and right[0] > right[1]


def test_very_many_languages(spark):
    """Samples are bounded in bytes, of long texts too, and all tables of a worker together."""
    rows = [(i * 100 + j, f"x{i} " + "".join(chr(97 + (i + k) % 26) for k in range(30)) * (2000 if j == 0 else 1), f"l{i}") for i in range(50) for j in range(3)]
    docs = spark.createDataFrame([*rows, (None, "abc", "l1"), (7, None, "l2"), (8, "abc", None)], "doc_id long, text string, lang string")
    samples = langid.labelled_samples(docs, F.lit(True), "doc_id", "text", "lang", 5_000, 10, 1 << 30)
    assert len(samples) == 50 and all(len(s) <= 5_000 for _, s in samples) and max(len(s) for _, s in samples) == 5_000
    small = langid.labelled_samples(docs, F.lit(True), "doc_id", "text", "lang", 5_000, 10, 1 << 20)
    width = langid.Parser(small).width
    assert len(small) == 50 and sum(len(s) for _, s in small) * 2 * 4 * width <= 1.1 * (1 << 20)


def test_held_out_accuracy(spark):
    from casefile.llm.queries import op3_language_id, read

    d = "/root/testdata/sf0.01"
    got = op3_language_id(spark, d).filter("held_out").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    assert got.filter("lang is not null").selectExpr("avg(cast(lang = lang_pred as double))").first()[0] >= 0.97


# --- extraction --------------------------------------------------------------------------------------------------


def test_extraction_of_made_up_pages():
    htmls = htmlpages.pages(150, seed=77)
    truth = [extract.join_blocks(p, extract.labels(p) > 0) for p in map(parse, htmls)]
    got = extract.extract_texts(htmls, extract.trained())
    assert np.mean([a == b for a, b in zip(truth, got, strict=True)]) >= 0.8


def test_extraction_of_a_page(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies, accept them.</div>
    <article><h1>A &amp; B</h1><p>First  line,\n with <b>bold</b> text &eacute;. It goes on, and on.</p><p>Second paragraph here, with more words in it.</p>
    <p>Third paragraph, which is as long as the others are.</p></article>
    <section id="comments"><h2>Comments</h2><p>Nice, thanks.</p></section><footer>&copy; Somebody, all rights.</footer></body></html>"""
    rows = [(1, "u", html, 0), (2, None, None, 0), (None, "u", "", 0), (3, "u", "<", 0), (4, "u", "plain text", 0)]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    want = "A & B\nFirst line, with bold text é. It goes on, and on.\nSecond paragraph here, with more words in it.\nThird paragraph, which is as long as the others are."
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[None].text == "" and got[2].n_chars == 0
    assert set(got) == {1, 2, None, 3, 4}
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_model_is_as_fitted():
    """The stored trees are those that fitting gives."""
    new, stored = extract.refitted(), extract.trained()
    assert (new.feature == stored.feature).all() and new.base == pytest.approx(stored.base)
    assert np.allclose(new.leaf, stored.leaf) and np.allclose(new.threshold, stored.threshold)


def closed_sets(parent):
    """All sets of nodes that hold the root and the parent of each of their nodes."""
    for mask in range(1 << (len(parent) - 1)):
        kept = [True, *(mask >> i & 1 > 0 for i in range(len(parent) - 1))]
        if all(kept[parent[i]] for i in range(1, len(parent)) if kept[i]):
            yield kept


def test_decoding_equals_brute_force():
    r = np.random.default_rng(5)
    for _ in range(60):
        parent = [-1, *(int(r.integers(0, i)) for i in range(1, int(r.integers(2, 11))))]
        margin = r.standard_normal(len(parent))
        page = parse("")
        page.parent = parent
        got = extract.decode(page, margin)
        best = max(closed_sets(parent), key=lambda kept: sum(m for m, k in zip(margin, kept, strict=True) if k))
        assert got.tolist() == best


@pytest.mark.parametrize(
    "html",
    ["<a " * 300_000, "<a x" * 300_000 + '">', "<a '\">" * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<textarea>" * 100_000, "<span>" * 50_000 + "<div></div>" * 50_000,
     "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<p><object>" + "<span>" * 50_000 + "<div></div>" * 50_000, "<" * 500_000, "<!--" * 200_000, "<a " + "x " * 400_000 + ">", "&" * 300_000, "<a =" + " " * 500_000],
    ids=range(13),
)
def test_reading_takes_time_in_proportion(html):
    import time

    began = time.perf_counter()
    extract.extract_texts([html], extract.trained())
    assert time.perf_counter() - began < 10


def test_tags_and_their_ends():
    text = lambda html: [t for *_, t in parse(html).pieces]
    assert text("a<b title='x>y'>c</b>d") == ["a", "c", "d"] and text('<p title="a>b>c</p>') == ["b>c"]
    assert text("1 < 2 <p>x<") == ["1 < 2 ", "x<"] and text("x<!-- <p>y</p> -->z<a href='never") == ["x", "z"]
    assert text("<a title=it's>x</a>y") == ["x", "y"]
    page = parse("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><p>one<p>two<div>three</div>")
    assert [extract.TAGS[t] for t in page.tag] == ["html", "table", "tr", "td", "td", "tr", "td", "ul", "li", "li", "p", "p", "div"]
    assert [page.parent[i] for i in range(1, 13)] == [0, 1, 2, 2, 1, 5, 0, 7, 7, 0, 0, 0]


def test_extraction_of_long_deep_and_repeated_pages(spark):
    article = "<article>" + "<p>A sentence of the article, which goes on for a while, as they do.</p>" * 20_000 + "</article>"
    deep = "<div>" * 5000 + "<p>Deep text, but text, and text it is, with marks.</p>"
    rows = [(1, "u", article), (2, "u", deep), (2, "u", deep), (3, "u", "<p>Short text of a page, with marks.</p>")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 2, 3]
    by = {r.page_id: r for r in got}
    assert by[1].text.count("\n") == 19_999 and by[1].n_chars == len(by[1].text)


def test_decoding_keeps_parents_of_kept_nodes():
    page = parse("<div><section><p>a</p></section><p>b</p></div>")
    kept = extract.decode(page, np.array([1.0, -1.0, -1.0, 3.0, -2.0]))
    assert kept.tolist() == [True, True, True, True, False]
    assert extract.decode(page, np.array([1.0, -3.0, -1.0, 3.0, -2.0])).tolist() == [True, False, False, False, False]


# --- WARC --------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\n?q=é", "same", 0), (9, None, "same", 0), (9, "x", "same", 0), (7, "u", "other", 0), (1, "u", None, 0), (2, "u", "", 0), (None, "u", "lone", 0), (None, "u", "same", 0), (8, "u", "x" * 300_000, 0)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    back = sorted(warc.pack_and_read(docs).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes, r.url or ""))
    assert sorted((r.page_id, r.url) for r in back if r.page_id and r.url) == sorted((a, b) for a, b, *_ in rows if a and b)
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in back}
    assert kinds[5, 4] == ("revisit", 9) and kinds[9, 4] == ("response", None) and kinds[None, 4] == ("revisit", 9)
    assert kinds[1, 0] == ("revisit", 2) and kinds[2, 0] == ("response", None) and kinds[8, 300_000] == ("response", None)
    for r in back:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or warc.digest(bytes(r.payload)) == r.payload_digest
    assert warc.pack_and_read(docs.limit(0)).collect() == []


def read_warc(raw):
    """An independent reader: records of a gzipped WARC file as (fields, block), checked for what the format asks."""
    import gzip

    out, f = [], io.BytesIO(gzip.decompress(raw))
    while line := f.readline():
        assert line == b"WARC/1.1\r\n"
        fields = {}
        while (line := f.readline()) != b"\r\n":
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            fields[name] = value
        block = f.read(int(fields["Content-Length"]))
        assert f.read(4) == b"\r\n\r\n"
        assert {"WARC-Type", "WARC-Date", "WARC-Record-ID", "Content-Type"} <= set(fields)
        out.append((fields, block))
    return out


def test_archives_are_valid_for_other_readers(spark):
    import base64
    import json
    import re

    rows = [(5, "http://a.b/é x", "same"), (9, "http://u:80/?q", "same"), (3, None, "x" * 3_000_000), (4, "no scheme", None), (6, "http://u/[", "")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (archive,) = warc.write(docs).collect()
    z = zipfile.ZipFile(re.sub("^file:/+", "/", archive.archive))
    raw = z.read(warc.DATA)
    info, *records = read_warc(raw)
    assert info[0]["WARC-Type"] == "warcinfo" and b"format: WARC" in info[1] and len(records) == archive.records == 5
    ids = {f["X-Page-Id"]: f["WARC-Record-ID"] for f, _ in records}
    assert len(set(ids.values())) == 5
    for fields, block in records:
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
        assert re.fullmatch(r"[!-~]+", fields["WARC-Target-URI"]) and fields["Content-Type"].startswith("application/http")
        head, _, body = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK\r\n")
        html = dict((str(i), (h or "").encode()) for i, _, h in rows)[fields["X-Page-Id"]]
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert body == (b"" if fields["WARC-Type"] == "revisit" else html)
    kinds = {f["X-Page-Id"]: (f["WARC-Type"], f.get("WARC-Refers-To")) for f, _ in records}
    assert kinds["5"] == ("revisit", ids["9"]) and kinds["4"] == ("revisit", ids["6"]) and kinds["9"] == ("response", None)
    lines = z.read(warc.INDEX).decode().splitlines()
    assert lines == sorted(lines) and len(lines) == 5
    for line in lines:
        key, stamp, about = line.split(" ", 2)
        about = json.loads(about)
        assert stamp == "20000101000000" and key == warc.surt(about["url"])
        one = read_warc(raw[int(about["offset"]) : int(about["offset"]) + int(about["length"])])
        assert len(one) == 1 and one[0][0]["WARC-Target-URI"] == about["url"]


def test_uris_and_keys():
    assert warc.target_uri("http://A.b/é x", 1) == "http://A.b/%C3%A9%20x" and warc.target_uri(None, None) == "urn:page:null" and warc.target_uri("x\ny", 2) == "urn:page:2"
    assert warc.surt("http://www.Example.com:81/A?b=C") == "com,example,www:81)/a?b=c" and warc.surt("urn:page:3") == "urn:page:3" and warc.surt("http://u/[") == "u)/["
    assert warc.surt("http://[bad/") == "http://[bad/"


def test_index_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    data = b"".join(b'k%d 2000 {"n": "%d"}\n' % (i, i) for i in range(20))
    assert [x["n"] for x in warc.index_lines(io.BytesIO(b"xx" + data), 2, len(data))] == [str(i) for i in range(20)]


def test_warc_least_size(spark):
    rows = [(1, "u", "ab", 0), (2, "u", "ab", 0), (3, "u", "abc", 0), (4, "u", "abc", 0)]
    got = warc.pack_and_read(spark.createDataFrame(rows, "page_id long, url string, html string, x int"), min_bytes=3)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_zip_directories():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"hello")
        with z.open("b.bin", "w", force_zip64=True) as f:
            f.write(b"12345678")
        z.comment = b"PK\x05\x06 in a comment"[4:]
    raw = data.getvalue()
    found = warc.members(io.BytesIO(raw), len(raw))
    assert {n: raw[a : a + s] for n, (a, s) in found.items()} == {"a.txt": b"hello", "b.bin": b"12345678"}


def test_zip64_end_record():
    """The same archive with its directory named by a ZIP64 end record only."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"hello")
    raw = data.getvalue()
    at = raw.rfind(b"PK\x05\x06")
    n, length, start = struct.unpack("<HII", raw[at + 10 : at + 20])
    entry = bytearray(raw[start:at])
    packed, full, name_len, extra_len = struct.unpack("<IIHH", entry[20:32])
    (local,) = struct.unpack("<I", entry[42:46])
    extra = struct.pack("<HHQQQ", 1, 24, full, packed, local)
    entry[20:32] = struct.pack("<IIHH", 0xFFFFFFFF, 0xFFFFFFFF, name_len, len(extra))
    entry[42:46] = b"\xff" * 4
    directory = bytes(entry) + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(directory), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(directory), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    new = raw[:start] + directory + end64 + locator + end
    (a, s) = warc.members(io.BytesIO(new), len(new))["a.txt"]
    assert new[a : a + s] == b"hello"


def test_compressed_members_and_other_files_raise():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", b"hello" * 100)
    with pytest.raises(ValueError, match="not stored"):
        warc.members(io.BytesIO(data.getvalue()), len(data.getvalue()))
    with pytest.raises(ValueError, match="no end"):
        warc.members(io.BytesIO(b"nothing"), 7)
