"""Line-oriented evidence: chat exports, transcripts, statement text. All of it by line numbers and windows in the JVM.

Files of any size are read in byte ranges (``read_lines``): Spark's text reader cuts them, a range being a block with lines
in order. Texts that are a column already are numbered in blocks of lines (``numbered``). Windows work within a block;
what goes on across block ends, running counts and the line that follows, comes from a table with one row per block.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casefile.functions.text import money

# The shapes of exported lines and their dates.
CHAT_START = r"^[‎‏]?\[?(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?(?:\s?[APap][Mm])?)\]?\s*(?:-\s*)?(.*)$"
DATES = ("d/M/yyyy", "d/M/yy", "d-M-yyyy", "d.M.yyyy")
TIMES = ("H:mm:ss", "H:mm", "h:mm:ss a", "h:mm a")
# How notices of the chat program itself begin, what they hold, what they are, and how they end behind a subject.
NOTICE_STARTS = ("end-to-end encrypted", "messages and calls are end-to-end encrypted", "this chat is with business account", "this chat is with an official business account", "your security code with ")
NOTICE_HOLDS = ("secured with end-to-end encryption", "'s security code changed")
NOTICES = ("you're now an admin", "disappearing messages were turned on", "disappearing messages were turned off", "waiting for this message. this may take a while")
NOTICE_ENDS = (
    "is a contact", "is not in your contacts", "was added to your contacts", "left", "left the group", "added you", "added you to the group", "added you to this group", "removed you",
    "added member", "added members", "added participant", "added participants", "changed the group description", "changed the group's icon",
)
NOTICE_QUOTES = ("created group", "changed the subject to")
NOTICE_PERSON = r" (?:added|removed) ~?[\w+-]{2,25}$"
MEDIA = (("IMAGE", r"(?i)<media omitted>|image omitted|\.(jpg|jpeg|png)\b"), ("AUDIO", r"(?i)audio omitted|\.(opus|mp3|m4a)\b"), ("VIDEO", r"(?i)video omitted|\.mp4\b"), ("DOCUMENT", r"(?i)document omitted|\.(pdf|docx|xlsx)\b"))


#: Lines of a text in a column that are ordered together.
BLOCK_LINES = 1 << 14


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, n, line of text files in byte ranges of ``spark.sql.files.maxPartitionBytes``.

    block is where a range begins, n orders its lines. A line that crosses the end of a range belongs to the one that it begins in.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", "^\uFEFF|\r$", "")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), line.alias("line"))


def numbered(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, block, n, line of texts in a column."""
    lines = files.select(*keys, F.posexplode(F.split(body, r"\r?\n")).alias("n", "line"))
    return lines.select(*keys, F.floor(F.col("n") / BLOCK_LINES).cast("long").alias("block"), F.col("n").cast("long").alias("n"), "line")


def across_blocks(lines: DataFrame, keys: list[str], *counted: Column) -> DataFrame:
    """``lines`` with counts and a look ahead: c0, c1, ... (rows so far, this one included, for which each of ``counted`` holds) and next, the line that follows.

    Windows are within blocks; blocks are put together by a row each.
    """
    within = Window.partitionBy(*keys, "block").orderBy("n")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    hits = [F.coalesce(c, F.lit(False)).cast("long") for c in counted]
    names = [f"c{i}" for i in range(len(hits))]
    rows = lines.withColumns({f"_{c}": F.sum(h).over(so_far) for c, h in zip(names, hits, strict=True)} | {"_next": F.lead("line").over(within)})
    totals = lines.groupBy(*keys, "block").agg(*(F.sum(h).alias(f"_t{c}") for c, h in zip(names, hits, strict=True)), F.min_by("line", "n").alias("_first"))
    ordered = Window.partitionBy(*keys).orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    ends = totals.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("block").alias("_block"), *(F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_b{c}") for c in names), F.lead("_first").over(ordered).alias("_after")
    )
    same = F.col("block") == F.col("_block")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(ends, same)
    return rows.select(*lines.columns, *((F.col(f"_{c}") + F.col(f"_b{c}")).alias(c) for c in names), F.coalesce("_next", "_after").alias("next"))


def first_time(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def records(lines: DataFrame, keys: list[str], starts: Column, title: Column | None = None) -> DataFrame:
    """keys, rec (from 1), text: lines joined to the record that they belong to, across blocks too; those before the first go.

    A record is one row, so it has to fit one. title: of lines that begin a part; records are counted within a part then, and
    ``part`` is the line that begins it. Lines before the first record of a part go, and so do those before the first part.
    """
    if title is None:
        rows = across_blocks(lines, keys, starts).filter("c0 > 0")
        return joined_lines(rows, keys).select(*keys, F.col("c0").alias("rec"), "text")
    rows = across_blocks(lines, keys, starts & ~title, title).filter("c1 > 0")
    parts = rows.filter(title).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("c1").alias("_c1"), F.col("c0").alias("_before"), F.col("line").alias("part"))
    same = F.col("c1") == F.col("_c1")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    recs = joined_lines(rows.filter(~title), [*keys, "c1"]).join(parts, same)
    return recs.filter(F.col("c0") > F.col("_before")).select(*keys, "part", (F.col("c0") - F.col("_before")).alias("rec"), "text")


def joined_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c0, text: the lines of each record in their order."""
    joined = rows.groupBy(*keys, "c0").agg(F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("_l"))
    return joined.select(*keys, "c0", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def is_notice(text: Column) -> Column:
    """Whether a message is a notice of the chat program: of encryption, contacts, groups and members; direction marks, case and a full stop at the end do not count."""
    low = F.lower(F.trim(F.regexp_replace(text, "[\u200e\u200f]", "")))
    bare = F.regexp_replace(low, r"\.$", "")
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    # A security code notice names a person before it says that the code changed.
    starts = any_of([low.startswith(x) & ~F.substring(low, len(x) + 1, 1).rlike(r"\w") for x in NOTICE_STARTS[:-1]]) | low.rlike(f"^{NOTICE_STARTS[-1]}.+ changed")
    ends = any_of([bare.endswith(" " + x) & (F.length(bare) > len(x) + 1) for x in NOTICE_ENDS])
    quotes = any_of([low.rlike(rf'^.+ {x} ".*"$') for x in NOTICE_QUOTES])
    holds = any_of([F.contains(low, F.lit(x)) & ~low.startswith("'") for x in NOTICE_HOLDS])
    return F.coalesce(starts | holds | bare.isin(*NOTICES) | ends | quotes | bare.rlike("." + NOTICE_PERSON), F.lit(False))


def parse_chat(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``chat_messages`` of exports in a column."""
    return chat_messages(numbered(files, keys, body), keys)


def read_chat(spark: SparkSession, path: str, title: str | None = None) -> DataFrame:
    """``chat_messages`` of export files of any size, by path.

    title: a pattern of the line that begins a chat, for files that hold many chats one after the other; what it catches is ``chat``.
    A file for each chat is opened and closed for a few lines, so many small chats are read sooner from few files.
    """
    return chat_messages(read_lines(spark, path), ["path"], title)


def chat_messages(lines: DataFrame, keys: list[str], title: str | None = None) -> DataFrame:
    """Messages of a chat export: keys, chat (if there is a ``title``), seq, sent_at (null if no format fits), sender, text, kind, media, deleted.

    A line that starts with date and time begins a message; other lines go on with the one before. A chat ends at the next one's title.
    """
    recs = records(lines, keys, F.col("line").rlike(CHAT_START), F.col("line").rlike(title) if title else None)
    if title:
        recs, keys = recs.withColumn("chat", F.regexp_extract("part", title, 1)), [*keys, "chat"]
    head = r"(?s)" + CHAT_START
    rest = F.regexp_extract("text", head, 3)
    stamp = F.concat_ws(" ", F.regexp_extract("text", head, 1), F.upper(F.regexp_replace(F.regexp_extract("text", head, 2), r"\s+", " ")))
    named = rest.rlike(r"(?s)^[^:\n]{1,60}:\s") & ~is_notice(rest)
    sender = F.when(named, F.trim(F.substring_index(rest, ":", 1)))
    said = F.when(named, F.regexp_replace(rest, r"(?s)^[^:\n]{1,60}:\s", "")).otherwise(rest)
    media = F.lit(None).cast("string")
    for name, pattern in reversed(MEDIA):
        media = F.when(said.rlike(pattern), name).otherwise(media)
    return recs.select(
        *keys, F.col("rec").cast("int").alias("seq"), first_time(stamp, [f"{d} {t}" for d in DATES for t in TIMES]).alias("sent_at"),
        sender.alias("sender"), F.trim(said).alias("text"), F.when(named & ~is_notice(said), "USER").otherwise("SYSTEM").alias("kind"), media.alias("media"),
        said.rlike(r"(?i)(this message was deleted|you deleted this message)").alias("deleted"),
    )


def why_broken(body: str) -> str:
    """What is wrong with a JSON text, and where."""
    try:
        found = json.loads(body)
    except json.JSONDecodeError as e:
        return f"{e.msg} at character {e.pos}"
    except RecursionError:
        return "nested too deeply"
    return "no list of messages" if not isinstance(found, dict) or not isinstance(found.get("messages"), list) else "messages of another shape"


def parse_chat_json(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Messages of a JSON export, a list or an object with messages; several spellings of each field: keys, seq, sent_at, sender, text, error.

    A text given in parts (a list of strings and of objects with a text) is joined. A body that is no such export gives one row with
    ``error``, which says where it broke, and no seq; a null or blank body is an empty export.
    """
    names = ("sender", "sender_name", "from", "sent_at", "timestamp", "date")
    item = "array<struct<" + ", ".join(f"`{n}`: string" for n in (*names, "text", "message_text", "message")) + ">>"
    is_list = F.ltrim(body).startswith("[")
    listed = F.when(is_list, F.from_json(body, item)).otherwise(F.from_json(body, f"struct<messages: {item}>")["messages"])
    blank = F.coalesce(F.trim(body), F.lit("")) == ""
    good = F.when(~blank & F.try_parse_json(body).isNotNull(), listed)
    rows = files.select(*keys, good.alias("_m"), F.when(~blank & good.isNull(), F.col(body)).alias("_broken"))
    said = rows.select(*keys, F.posexplode("_m").alias("seq", "m"))
    pick = lambda *found: F.coalesce(*[F.nullif(F.col(f"m.`{n}`"), F.lit("")) for n in found])
    when = pick("sent_at", "timestamp", "date")
    epoch = F.when(when.rlike(r"^\d{9,11}$"), F.timestamp_seconds(when.try_cast("bigint")))
    raw = F.coalesce(pick("text", "message_text", "message"), F.lit(""))
    parts = F.transform(F.from_json(raw, "array<string>"), lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
    text = F.when(raw.startswith("["), F.coalesce(F.array_join(parts, ""), raw)).otherwise(raw)
    good_rows = said.select(*keys, (F.col("seq") + 1).alias("seq"), F.coalesce(epoch, F.try_to_timestamp(when)).alias("sent_at"), pick("sender", "sender_name", "from").alias("sender"), text.alias("text"), F.lit(None).cast("string").alias("error"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    why = F.udf(why_broken, "string")  # broken files only
    broken = rows.filter("_broken is not null").select(*keys, none("int", "seq"), none("timestamp", "sent_at"), none("string", "sender"), none("string", "text"), why("_broken").alias("error"))
    return good_rows.unionByName(broken)


def seconds_of(stamp: Column) -> Column:
    """hh:mm:ss.mmm or mm:ss as seconds."""
    parts = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    get = lambda i: F.coalesce(F.try_element_at(F.reverse(parts), F.lit(i)).try_cast("double"), F.lit(0.0))
    return get(1) + 60 * get(2) + 3600 * get(3)


def parse_transcript(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``transcript_segments`` of transcripts in a column."""
    return transcript_segments(numbered(files, keys, body), keys)


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """``transcript_segments`` of transcript files of any size, by path."""
    return transcript_segments(read_lines(spark, path), ["path"])


def transcript_segments(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of VTT, SRT or [mm:ss] text: keys, seq, starts, ends, speaker, text.

    An interval line takes the next line that is not empty as its text; an inline stamp lasts five seconds. Segments
    without a named speaker take turns between two.
    """
    lines = lines.filter(F.trim("line") != "")
    interval = r"^\s*((?:\d+:)?\d+:\d+[.,]?\d*)\s*-->\s*((?:\d+:)?\d+:\d+[.,]?\d*)"
    inline = r"^\s*[\[(]?((?:\d+:)?\d{1,2}:\d{2})[\])]?\s+(?!-->)(\S.*)$"
    is_interval, is_inline = F.col("line").rlike(interval), F.col("line").rlike(inline) & ~F.col("line").rlike(interval)
    rows = across_blocks(lines, keys, is_interval | is_inline)
    starts = F.when(is_interval, seconds_of(F.regexp_extract("line", interval, 1))).otherwise(seconds_of(F.regexp_extract("line", inline, 1)))
    ends = F.when(is_interval, seconds_of(F.regexp_extract("line", interval, 2))).otherwise(F.col("starts") + 5)
    raw = F.when(is_interval, F.coalesce("next", F.lit(""))).otherwise(F.regexp_extract("line", inline, 2))
    rows = rows.filter(is_interval | is_inline).withColumn("starts", starts).withColumn("ends", ends).withColumn("raw", raw)
    voice = r"^\s*(?:<v\s+([^>]+)>|\[([^\]]+)\]|([A-Z][A-Za-z0-9 ._]{0,30}):)\s*(.*)$"
    named = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("raw", voice, i)), F.lit("")) for i in (1, 2, 3)])
    said = F.when(F.col("raw").rlike(voice), F.regexp_extract("raw", voice, 4)).otherwise(F.col("raw"))
    rows = rows.withColumn("seq", F.col("c0").cast("int"))
    turn = F.concat(F.lit("Speaker "), ((F.col("seq") - 1) % 2 + 1).cast("string"))
    return rows.select(*keys, "seq", "starts", "ends", F.coalesce(named, turn).alias("speaker"), F.trim(F.regexp_replace(said, "</?v[^>]*>", "")).alias("text"))


def parse_statement_lines(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``statement_rows`` of statements in a column."""
    return statement_rows(numbered(files, keys, body), keys)


def statement_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Statement text: a record starts with dd/mm/yyyy and ends in amount, balance and Dr or Cr."""
    recs = records(lines, keys, F.col("line").rlike(r"^\s*\d{2}/\d{2}/\d{4}\b"))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    tail = r"^(\d{2}/\d{2}/\d{4})\s+(.*?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s*(Dr|Cr)?\.?$"
    part = lambda i: F.regexp_extract(flat, tail, i)
    amount = amount_of(part(3))
    out = recs.filter(flat.rlike(tail)).select(
        *keys, F.col("rec").alias("row_order"), F.try_to_timestamp(part(1), F.lit("dd/MM/yyyy")).alias("txn_date"), part(2).alias("narration"),
        F.when(part(5) == "Dr", amount).otherwise(F.lit(0).cast("decimal(18,2)")).alias("debit"), F.when(part(5) == "Dr", F.lit(0).cast("decimal(18,2)")).otherwise(amount).alias("credit"), amount_of(part(4)).alias("balance"),
    )
    return out


def amount_of(text: Column) -> Column:
    """An amount without currency signs and separators; what is no number is 0."""
    return money(F.coalesce(F.regexp_replace(text, r"(?i)inr|[,₹\s]", "").try_cast("decimal(38,6)"), F.lit(0)))
