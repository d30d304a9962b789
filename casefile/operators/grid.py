"""Filtered and paged grids over any evidence table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_any(columns: Sequence[str], term: str) -> Column:
    """Whether any column holds the term, without regard to case."""
    return reduce(lambda a, c: a | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False)), columns, F.lit(False))


def equals(column: str, value: str | None) -> Column:
    """Equal without regard to case; no value lets everything through."""
    return F.lit(True) if value in (None, "") else F.lower(F.trim(F.col(column))) == value.strip().lower()


def within_days(column: str, first: str | None = None, last: str | None = None) -> Column:
    """Both days included; a missing bound is none."""
    day = F.to_date(column)
    out = F.lit(True)
    if first:
        out = out & (day >= F.to_date(F.lit(first)))
    if last:
        out = out & (day <= F.to_date(F.lit(last)))
    return out


def risk_band(column: str, band: str | None, high: int = 70, medium: int = 40) -> Column:
    c = F.col(column)
    return {"high": c >= high, "medium": (c >= medium) & (c < high), "low": c < medium}.get(band or "", F.lit(True))


def transaction_type(kind: str | None, debit: str = "debit", credit: str = "credit", risk: str = "risk_score") -> Column:
    return {"credit": F.col(credit) > 0, "debit": F.col(debit) > 0, "high": F.col(risk) >= 70}.get(kind or "", F.lit(True))


def excluded_path(path: str, prefixes: Sequence[str], segments: Sequence[str], extensions: Sequence[str], explicit: Sequence[str] = ()) -> Column:
    """Paths below a prefix, with a segment or with an extension; explicit targets never are."""
    low = F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))
    below = reduce(lambda a, p: a | (low == p) | low.startswith(p.rstrip("/") + "/"), [p.lower() for p in prefixes], F.lit(False))
    inside = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(s.lower()) for s in segments])) if segments else F.lit(False)
    typed = F.regexp_extract(low, r"(\.[^./]+)$", 1).isin(*[e.lower() for e in extensions]) if extensions else F.lit(False)
    return (below | inside | typed) & ~F.col(path).isin(*explicit) if explicit else below | inside | typed


def page_of(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The page with row numbers, the total and the last page; a page beyond the last is the last.

    Rows are counted first, so only those up to the page are ordered and only the page's own are numbered.
    """
    size = min(500, max(1, size))
    total = rows.count()
    last = max(1, -(-total // size))
    page = min(max(1, number), last)
    before = (page - 1) * size
    cut = rows.orderBy(*order).offset(before).limit(size)
    row = F.row_number().over(Window.orderBy(*order)) + before  # a page of rows
    return cut.withColumns({"row": row.cast("int"), "total": F.lit(total).cast("long"), "last_page": F.lit(last), "page": F.lit(page)})


def visible_cases(cases: DataFrame, user: str, status: str = "status", creator: str = "creator") -> DataFrame:
    """Completed cases and the user's own active ones."""
    return cases.filter((F.col(status) == "COMPLETED") | ((F.col(status) == "ACTIVE") & (F.col(creator) == user)))


def in_scope(rows: DataFrame, bridge: DataFrame, key: str, names: Sequence[str], name: str = "name") -> DataFrame:
    """Rows whose key belongs to one of the named cases; no row comes twice."""
    wanted = bridge.filter(F.col(name).isin(*names)).select(F.col(key).alias("_k"))
    return rows.join(wanted, F.col(key) == F.col("_k"), "left_semi")


def mail_filter(
    rows: DataFrame, folder: str | None = None, sender: str | None = None, participant: str | None = None, keyword: str | None = None, first: str | None = None, last: str | None = None,
    attachment: bool | None = None, least_risk: int | None = None, people: Sequence[str] = ("sender", "sender_name", "recipients", "cc", "bcc"), texts: Sequence[str] = ("subject", "body"),
) -> DataFrame:
    """Mails of a grid; a condition that is not given lets everything through."""
    keep = equals("folder", folder) & within_days("sent", first, last)
    for term, columns in ((sender, ["sender"]), (participant, people), (keyword, texts)):
        if term:
            keep = keep & contains_any([c for c in columns if c in rows.columns], term)
    if attachment is not None:
        keep = keep & (F.coalesce(F.col("has_attachment"), F.lit(False)) == attachment)
    if least_risk is not None:
        keep = keep & (F.col("risk_score") >= least_risk)
    return rows.filter(keep)


#: Rules of a mail grid by the flag that they read.
CHECKPOINTS = {"currency": "is_currency", "personal": "is_personal", "external": "is_external", "bank": "is_bank", "upi": "is_upi", "keywords": "is_keyword"}


def by_checkpoint(rows: DataFrame, rule: str | None, texts: Sequence[str] = ("text",), profile_keywords: Sequence[str] = ()) -> DataFrame:
    """Rows that a rule flags, by its name, ``profile`` for the profile's keywords, or any other word as a keyword itself."""
    if not rule:
        return rows
    if rule in CHECKPOINTS:
        return rows.filter(CHECKPOINTS[rule])
    words = list(profile_keywords) if rule == "profile" else [rule]
    return rows.filter(reduce(lambda a, w: a | contains_any(texts, w), words, F.lit(False)))


def chat_filter(rows: DataFrame, flagged: bool = False, sender: str | None = None, media: bool | None = None, deleted: bool | None = None, profile_keywords: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Messages of a grid: flagged ones have a risk of 50 or more, flagged terms or a keyword of the profile."""
    keep = equals("sender", sender)
    if flagged:
        named = reduce(lambda a, w: a | contains_any([text], w), profile_keywords, F.lit(False))
        keep = keep & ((F.col("risk_score") >= 50) | (F.coalesce("flagged", F.lit("")) != "") | named)
    for wanted, column in ((media, "has_media"), (deleted, "is_deleted")):
        if wanted is not None:
            keep = keep & (F.coalesce(F.col(column), F.lit(False)) == wanted)
    return rows.filter(keep)


def verify_filter(rows: DataFrame, level: str | None = None, mime: str | None = None) -> DataFrame:
    return rows.filter(equals("level", level) & (contains_any(["mime"], mime) if mime else F.lit(True)))


def folder_of(path: str) -> Column:
    """A path up to its last slash, of either kind."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows whose key is not among those of ``gone``."""
    return rows.join(gone.select(F.col(gone_key or key).alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def chat_page(rows: DataFrame, channel: str, order: str, size: int, own: Column, newest_first: bool = True) -> DataFrame:
    """The first ``size`` messages of each channel with their row and side: right for the custodian's ``own``, else left."""
    w = Window.partitionBy(channel).orderBy(F.desc(order) if newest_first else F.asc(order))
    page = rows.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= size)
    return page.withColumn("side", F.when(own, "right").otherwise("left"))
