"""Files of any kind as pages of text, and keyword hits in their names and texts.

A file is one row of ``binaryFile`` and is opened by one task, which holds it and one of its members at a time; what it
says goes on as rows of pages, and everything after that is done on those. A file that cannot be read gives a row with ``error``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions.text import snippet
from casefile.operators.grid import excluded_path
from casefile.sources import pdf
from casefile.sources.batches import batched
from casefile.sources.office import BROKEN

#: Bytes to which the archives of one file may unpack together; beyond it there is an error row.
MOST_UNPACKED = 1 << 30
# The parts of office files that hold text, by kind.
OFFICE = {
    "DOCX": re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"),
    "XLSX": re.compile(r"xl/(sharedStrings|worksheets/[^/]+|comments\d*)\.xml"),
    "PPTX": re.compile(r"ppt/(slides|notesSlides)/[^/]+\.xml"),
}
PAGES = "path string, member string, kind string, page int, text string, error string"


def walk(spark: SparkSession, folder: str, prefixes: Sequence[str] = (), segments: Sequence[str] = (), extensions: Sequence[str] = ()) -> DataFrame:
    """path, content, length, modified of the files below a folder, without excluded folders and kinds; contents are read where they are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(~excluded_path("path", prefixes, segments, extensions)).select("path", "content", "length", F.col("modificationTime").alias("modified"))


def plain(xml: bytes) -> str:
    """Markup to blanks, white space as one."""
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", xml.decode("utf-8", "replace"))).split())


class TooMuch(ValueError):
    """An archive that unpacks to more than is allowed."""


def member_of(archive: zipfile.ZipFile, name: str, left: int) -> bytes:
    """A member's bytes, if they are no more than ``left``, whatever its header says."""
    with archive.open(name) as f:
        data = f.read(left + 1)
    if len(data) > left:
        raise TooMuch("archives unpack to more than is allowed")
    return data


def parts_of(data: bytes, most: int = MOST_UNPACKED) -> Iterator[tuple[str, str, int, str | None, str | None]]:
    """(member, kind, page, text, error) of a file; kind says how a hit in it is to be called.

    Archives within archives are opened to any depth, until they have unpacked to ``most`` bytes together.
    """
    todo = [("", "", data)]
    left = most
    while todo:
        member, kind, data = todo.pop()
        try:
            if data[:5] == b"%PDF-":
                try:
                    yield from ((member, f"{kind}PDF", i + 1, text, None) for i, text in enumerate(pdf.page_texts(data)))
                except pdf.Broken as e:  # the readable bytes of it, and that it is broken
                    yield member, f"{kind}PDF", 1, " ".join(x.decode("latin-1") for x in re.findall(rb"[\x20-\x7E]{4,}", data)), None
                    yield member, f"{kind}PDF", 0, None, f"Broken: {e}"
            elif data[:4] == b"PK\x03\x04":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    office = next((k for k, pattern in OFFICE.items() if any(pattern.fullmatch(n) for n in names)), None)
                    if office:
                        found = sorted((n for n in names if OFFICE[office].fullmatch(n)), key=lambda n: (len(n), n))
                        for i, n in enumerate(found):
                            part = member_of(z, n, left)
                            left -= len(part)
                            yield member, "ZIP_OFFICE" if kind else office, i + 1, plain(part), None
                    else:
                        inner = []
                        for n in names:
                            if n.endswith("/"):
                                continue
                            way = f"{member} -> {n}" if member else n
                            yield way, "ZIP_NAME", 0, n, None
                            try:
                                part = member_of(z, n, left)
                            except TooMuch:
                                raise
                            except (*BROKEN, RuntimeError) as e:  # this member is broken or encrypted, the others may be read
                                yield way, "ZIP", 0, None, f"{type(e).__name__}: {e}"
                                continue
                            left -= len(part)
                            inner.append((way, "ZIP_", part))
                        todo += reversed(inner)
            else:
                text = data.decode("utf-8", "replace")
                if text.count("\x00") * 10 > len(text):
                    continue  # no text
                for i, page in enumerate(text.split("\f")):
                    yield member, "ZIP" if kind else "TEXT", i + 1, page, None
        except BROKEN as e:
            yield member, "ZIP" if kind else "FILE", 0, None, f"{type(e).__name__}: {e}"


def pages(files: DataFrame, most: int = MOST_UNPACKED) -> DataFrame:
    """path, member (within archives, else empty), kind, page, text, error of every page of every file."""
    names = ["path", "member", "kind", "page", "text", "error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py()
                for row in parts_of(content.as_py() or b"", most):
                    yield name, *row

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), names, kinds)

    return files.select("path", "content").mapInArrow(work, PAGES)


def hits(files: DataFrame, keywords: Sequence[str], most: int = MOST_UNPACKED) -> DataFrame:
    """path, member, keyword, match_type, page, snippet: keywords in file names, and the first place of each in a file's or member's text.

    The text of a plain file is looked at only for files whose name holds no keyword. A file or member that could not be
    read is a row of match_type ERROR without keyword, whose snippet says why.
    """
    low = lambda c: F.lower(c)
    listed = [k.lower() for k in keywords]
    within = lambda text: F.filter(F.array(*[F.lit(k) for k in listed]), lambda k: F.contains(low(text), k))
    name = F.substring_index("path", "/", -1)
    named = files.select("path", F.explode(within(name)).alias("keyword"))
    none = F.lit(None)
    by_name = named.select("path", F.lit("").alias("member"), "keyword", F.lit("NAME").alias("match_type"), none.cast("int").alias("page"), none.cast("string").alias("snippet"))
    read = pages(files, most).withColumn("named", F.size(within(name)) > 0).filter(F.col("error").isNotNull() | ~((F.col("kind") == "TEXT") & F.col("named")))
    failed = F.col("error").isNotNull()
    # An error goes on as a hit of its own, so files are read once.
    found = F.when(failed, F.array(none.cast("string"))).otherwise(within(F.coalesce("text", F.lit(""))))
    said = read.select("path", "member", "kind", "page", "text", "error", F.explode(found).alias("keyword"))
    kind = F.when(failed, "ERROR").when(F.col("kind") == "ZIP_NAME", "ZIP_NAME").otherwise(F.concat(F.col("kind"), F.lit("_CONTENT")))
    piece = F.when(failed, F.col("error")).when(F.col("kind") != "ZIP_NAME", snippet(F.col("text"), F.col("keyword")))
    said = said.select("path", "member", "keyword", kind.alias("match_type"), "page", piece.alias("snippet"))
    first = said.groupBy("path", "member", "keyword", "match_type").agg(F.min(F.struct("page", "snippet")).alias("f"))
    return by_name.unionByName(first.select("path", "member", "keyword", "match_type", "f.page", "f.snippet"))


# Fixed value: how a nominee is named in a line.
NOMINEE = r"(?i)\bnominee\b\s*(?:is|:|-)?\s*([A-Z][A-Za-z .]{2,40})"


def document_hits(texts: DataFrame, keywords: DataFrame, text: str = "text", nominee: str = NOMINEE, risk: int = 85) -> DataFrame:
    """path, page, line, keyword, said: lines that name a nominee, else the first keyword (word, place) in them, each a hit of ``risk``."""
    lines = texts.select("path", "page", F.posexplode(F.split(text, r"\r?\n")).alias("line", "said")).withColumn("line", F.col("line") + 1)
    listed = keywords.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.lower("word").alias("w")))), lambda x: x["w"]).alias("words"))
    both = lines.crossJoin(F.broadcast(listed))  # one row: the keywords of a profile
    person = F.nullif(F.trim(F.regexp_extract("said", nominee, 1)), F.lit(""))
    word = F.try_element_at(F.filter("words", lambda w: F.contains(F.lower("said"), w)), F.lit(1))
    out = both.withColumn("keyword", F.coalesce(person, word)).filter("keyword is not null")
    return out.select("path", "page", "line", "keyword", F.trim("said").alias("said"), F.lit(risk).alias("risk"))


def header_alias(df: DataFrame, spellings: Sequence[str]) -> Column:
    """The first of the columns with these names, without regard to case, that holds a value."""
    known = {c.strip().lower(): c for c in reversed(df.columns)}
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{known[s]}`").cast("string")), F.lit("")) for s in spellings if s in known], F.lit(None).cast("string"))


# Headers of chat exports in CSV.
CHAT_HEADERS = {
    "sender": ("sender", "from", "author", "user", "name"), "sent_at": ("timestamp", "date", "time", "datetime", "sent_at"), "text": ("message", "text", "body", "content"),
    "media": ("media", "attachment", "file", "media_type"),
}


def read_chat_csv(spark: SparkSession, path: str) -> DataFrame:
    """sender (Unknown if none), sent_at (null if unreadable), text, media of a chat export in CSV; rows without text and media go."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    found = raw.select(*(header_alias(raw, names).alias(n) for n, names in CHAT_HEADERS.items())).filter("text is not null or media is not null")
    times = [F.try_to_timestamp("sent_at", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd\'T\'HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")]
    return found.select(F.coalesce("sender", F.lit("Unknown")).alias("sender"), F.coalesce(*times).alias("sent_at"), F.coalesce("text", F.lit("")).alias("text"), "media")
