"""Column functions on text, numbers and dates; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefile import params


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def utr(narration: Column) -> Column:
    """Bank reference: a bank code with N or R and digits, N or R with digits, or 12 digits that stand alone."""
    return F.upper(none_if_empty(F.regexp_extract(narration, r"(?i)\b([A-Z]{4}[NR]\d{8,18}|[NR]\d{8,18})\b|(?<!\d)(\d{12})(?!\d)", 0)))


def vpa(narration: Column) -> Column:
    """Payment address name@handle in lower case; one after - or / comes first."""
    near = none_if_empty(F.regexp_extract(narration, r"[-/]([A-Za-z0-9._]+@[A-Za-z]+)", 1))
    return F.trim(F.lower(F.coalesce(near, none_if_empty(F.regexp_extract(narration, r"([A-Za-z0-9._]+@[A-Za-z]+)", 1)))))


def ifsc(narration: Column) -> Column:
    return none_if_empty(F.regexp_extract(narration, r"\b([A-Z]{4}0[A-Z0-9]{6})\b", 1))


def group_indian(amount: Column) -> Column:
    """1,50,000.00: the last three digits, then pairs."""
    return F.regexp_replace(F.format_string("%.2f", amount), r"(\d)(?=(\d{2})*\d{3}\.)", "$1,")


def half_up(numerator: Column, denominator: Column | int, digits: int) -> Column:
    """numerator / denominator, both whole and not negative, rounded half up to ``digits`` places by whole arithmetic."""
    n, d, scale = numerator.cast("long"), F.lit(denominator).cast("long"), 10**digits
    return F.call_function("div", n * (2 * scale) + d, d * 2) / scale


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def fixed(amount: Column, unit: int) -> Column:
    """amount / unit with two places, half up, as text."""
    h = F.round(half_up(cents(amount), 100 * unit, 2) * 100).cast("long")
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


def short_inr(amount: Column) -> Column:
    """Crore, lakh and thousand with two decimals and a letter; for amounts that are not negative."""
    return (
        F.when(amount >= 1e7, F.concat(fixed(amount, 10_000_000), F.lit("Cr")))
        .when(amount >= 1e5, F.concat(fixed(amount, 100_000), F.lit("L")))
        .when(amount >= 1e3, F.concat(fixed(amount, 1_000), F.lit("K")))
        .otherwise(fixed(amount, 1))
    )


# How narrations name modes and directions, and what is no name there.
MODES = ("MMT[-/ ]+IMPS", "INF[-/ ]+NEFT", "BIL[-/ ]+IN[-/ ]+UPI", "BIL[-/ ]+UPI", "UPI", "IMPS", "NEFT", "RTGS")
DIRECTIONS = ("P2A", "P2M", "DR", "CR", "IN", "OUT")
NO_PARTY = ("IN", "OUT", "DR", "CR", "P2A", "P2M", "UPI", "IMPS", "NEFT", "RTGS", "TFR", "BIL", "INF", "MMT", "TRANSFER", "PAYMENT", "PAY", "NA")
AFTER_NAME = (r"[a-zA-Z0-9.\-_]+@", "[A-Z]{4}0", r"\d{10,18}", r"[X*]{2,}\d*", "PAYMENT", "ICICI", "HDFC", "AXIS", "SBIN", "SBI", "P2A", "P2M", "UPI", "$")
MODULE_NAMES = {"core": "Profile", "profile": "Profile"}


def account_mask(narration: Column) -> Column:
    """A masked account number or a bank code in a narration, upper-case; null if there is none."""
    return F.upper(F.nullif(F.regexp_extract(narration, r"(?i)\b([X*]{2,12}\d{4,6}|[A-Z]{4}0[A-Z0-9]{6})\b", 1), F.lit("")))


def counterparty_name(narration: Column, party: Column | None = None) -> Column:
    """The name between a narration's mode and its references, without lead-in and noise; else the party column; else null."""
    mode = "|".join(MODES)
    pattern = (
        rf"(?i)(?:^|[\s/_-])(?:{mode})(?:[\s/_-]+(?:{'|'.join(DIRECTIONS)}))?(?:[\s/_-]+(?:[A-Z]{{3,4}}[NR][A-Z0-9]+|[NR]?\d{{10,18}}))?[-/]"
        rf"(?!(?:{'|'.join(NO_PARTY)})\b)([A-Za-z][A-Za-z\s.]{{1,35}}?)(?=[-/](?:{'|'.join(AFTER_NAME)})|$)"
    )
    raw = F.regexp_extract(F.trim(F.coalesce(narration, F.lit(""))), pattern, 1)
    name = F.trim(F.regexp_replace(raw, r"(?i)^(?:SENT TO M[RS]|SENT TO|PAY TO|PAYMENT TO|TRANSFER TO)\s+", ""))
    name = F.trim(F.regexp_replace(name, r"(?i)\b(?:PAYMENT|PAY|TRF|TRANSFER|NA)\b", ""))
    fits = lambda c: F.when((c != "") & ~F.upper(c).isin(*NO_PARTY), c)
    return fits(name) if party is None else F.coalesce(fits(name), fits(F.trim(party)))


def group_western(value: Column) -> Column:
    """A whole number with a comma every three digits; what is no number stays as it is."""
    number = F.trim(value).try_cast("decimal(38,0)")
    return F.when(number.isNotNull(), F.format_number(number, 0)).otherwise(value)


def initials(name: Column) -> Column:
    """First letters of the first and last word, two letters of a single one, Q for none."""
    words = F.split(F.trim(name), r"\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    none = F.coalesce(F.trim(name), F.lit("")) == ""
    return F.when(none, "Q").when(F.size(words) == 1, F.upper(F.substring(first, 1, 2))).otherwise(F.upper(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1))))


def display_name(name: Column, department: Column) -> Column:
    return F.when(F.coalesce(department, F.lit("")) != "", F.concat(name, F.lit(" ("), department, F.lit(")"))).otherwise(name)


def module_name(code: Column) -> Column:
    """The short name of a module by its code; unknown codes without their prefix and with a capital."""
    low = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    plain = F.replace(low, F.lit("q_"), F.lit(""))
    out = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1_000))
    for key, value in MODULE_NAMES.items():
        out = F.when(low == key, value).otherwise(out)
    return out


def merged_map(old: Column, new: Column) -> Column:
    """A map with the other's entries over its own."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def first_snippets(snippets: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(snippets, 1, n), " | ")


#: A mail address. It starts where a run of its signs starts, or where the last match ended, so long runs are read once.
ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def file_size(n: Column) -> Column:
    """Bytes in steps of 1024."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n >= gb, F.concat(F.format_string("%.2f", n / gb), F.lit(" GB")))
        .when(n >= mb, F.concat(F.format_string("%.2f", n / mb), F.lit(" MB")))
        .when(n >= kb, F.concat(F.format_string("%.2f", n / kb), F.lit(" KB")))
        .otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))
    )


def strip_tags(text: Column) -> Column:
    """Markup to blanks, white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]+>", " "), r"[\s]+", " "))


def snippet(text: Column, keyword: Column, around: int = 45) -> Column:
    """What stands around the first place of a keyword, white space as one blank; null if it is not there."""
    at = F.position(F.lower(keyword), F.lower(text))
    start = F.greatest(F.lit(1), at - around)
    piece = F.substring(text, start, at - start + F.length(keyword) + around)
    return F.when(at > 0, F.trim(F.regexp_replace(piece, r"[\s]+", " ")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def mail_domain(address: Column) -> Column:
    """What follows the last @, up to >, in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(address, "@", -1), "[>\\s]", ""))


def canonical_name(name: Column, suffixes: Iterable[str] = params.LEGAL_SUFFIXES) -> Column:
    """Upper-case key of a party: legal suffixes go in their order, other signs become one blank."""
    out = F.lower(F.trim(name))
    for suffix in suffixes:
        out = F.regexp_replace(out, suffix, " ")
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", " "), " +", " ")))


def token_bag(text: Column) -> Column:
    """Sorted distinct tokens between single blanks."""
    return F.array_sort(F.array_distinct(F.split(text, " ")))


def word_hit(text: Column, term: str) -> Column:
    """Whether a term stands in lower-case text between word boundaries."""
    return F.lower(text).rlike(r"\b" + "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in term) + r"\b")


def keyword_count(text: Column, keyword: str) -> Column:
    """Places of a keyword without regard to case, none overlapping."""
    low, n = F.lower(text), len(keyword)
    return ((F.length(low) - F.length(F.replace(low, F.lit(keyword.lower()), F.lit("")))) / n).cast("int")


def keywords_hit(text: Column, keywords: Iterable[str]) -> Column:
    """The keywords that a text contains, upper-case, in their order."""
    listed = F.array(*[F.lit(k.upper()) for k in keywords])
    return F.filter(listed, lambda k: F.contains(F.upper(text), k))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed time in whole days of 24 hours, rounded down."""
    return F.floor((F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))) / 86400).cast("long")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (len a + len b), by dynamic programming over arrays; 100 for two empty texts.

    Reads the columns often; use it on short names after a blocking join.
    """
    chars = F.split(b, "")
    row = F.aggregate(
        F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>")),
        F.array_repeat(F.lit(0), F.length(b) + 1),
        lambda prev, x: F.aggregate(
            F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>")),
            F.array(F.lit(0)),
            lambda cur, j: F.array_append(
                cur,
                F.when(F.element_at(chars, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, j))),
            ),
        ),
    )
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(200.0 * F.element_at(row, -1) / both)
