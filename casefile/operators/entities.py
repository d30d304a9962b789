"""Names in texts: a scanner finds candidates word by word, they are cleaned, judged and merged per text; identifiers of entities.

The scanner goes over a text's words once. A word that can begin a name, or stands before one (a title, a word of kin or
speech, a number with a full stop), is looked at together with what follows it, by small rules that read forward only and
at most to the end of the name, so time is in proportion to the text whatever it holds. Rules find what they find
from left to right without overlaps of their own. Texts run through it in Arrow batches; nothing is exchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile import params
from casefile.functions.text import canonical_name
from casefile.operators.lexicon import Lexicon, hits, small_list
from casefile.session import spread

WORD, BLANKS, LETTERS, DIGITS = re.compile(r"\w+"), re.compile(r"\s*"), re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+")
#: A run of letters and full stops; one of letters, digits and "&"; one of either letters and full stops or blanks.
DOTTED, SPOKEN_WORD, RUNS = re.compile(r"[A-Za-z.]+"), re.compile(r"[A-Za-z0-9&]+"), re.compile(r"[A-Za-z.]+|\s+")
#: Most letters behind the first of a name after a title, and of any plain word of a name; of a firm's word.
LONGEST_TITLED, LONGEST_WORD, LONGEST_FIRM_WORD = 35, 20, 25
FIRM_WORD = re.compile(f"[A-Za-z0-9&]{{1,{LONGEST_FIRM_WORD + 2}}}")  # one longer than allowed tells that it is too long
#: Names of a text up to here are looked for behind its title, kin or firm word.
KIN_NAMES, FIRM_NAMES = 4, 5
#: What is before @ in a payment address.
ADDRESS_SIGNS, LEAST_ADDRESS, MOST_ADDRESS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-_"), 3, 30


class Found(NamedTuple):
    """A candidate and what its rule says of it."""

    name: str
    category: str
    role: str
    confidence: float


def is_capital(sign: str) -> bool:
    return "A" <= sign <= "Z"


def is_blank(text: str, at: int) -> bool:
    return at < len(text) and text[at].isspace()


def after_blanks(text: str, at: int) -> int:
    """The end of the blanks at ``at``; -1 if there are none."""
    end = BLANKS.match(text, at).end()
    return end if end > at else -1


def run(kind: re.Pattern[str], text: str, at: int) -> str:
    found = kind.match(text, at) if 0 <= at < len(text) else None
    return found[0] if found else ""


def plain_word(word: str) -> bool:
    """A capital letter and 2 to ``LONGEST_WORD`` letters."""
    return 2 <= len(word) - 1 <= LONGEST_WORD and is_capital(word[0]) and word.isascii() and word.isalpha()


def word_at(text: str, at: int) -> str:
    return run(WORD, text, at)


@cache
def phrases(words: tuple[str, ...], all_letters: bool = False) -> dict[str, tuple[str, ...]]:
    """Phrases by their first word, the longest first; the first letter of each may be of either case, and both letters around a slash."""
    out: dict[str, list[str]] = {}
    for phrase in words:
        forms = {phrase, phrase[0].swapcase() + phrase[1:]}
        if len(phrase) > 2 and phrase[1] == "/":
            forms = {a + "/" + b + phrase[3:] for a in (phrase[0].lower(), phrase[0].upper()) for b in (phrase[2].lower(), phrase[2].upper())}
        for form in forms:
            out.setdefault(WORD.match(form)[0], []).append(form)
    return {k: tuple(sorted(v, key=len, reverse=True)) for k, v in out.items()}


def phrase_end(text: str, at: int, phrase: str) -> int:
    """Behind ``phrase`` at ``at``, whose blanks may be any number of blanks; -1 if something else stands there."""
    for i, part in enumerate(phrase.split(" ")):
        at = after_blanks(text, at) if i else at
        if at < 0 or not text.startswith(part, at):
            return -1
        at += len(part)
    return at


def past_title(text: str, at: int, ignore_case: bool) -> int:
    """Behind one of the short titles and its blanks, or ``at``."""
    for title in params.SHORT_TITLES:
        said = text[at : at + len(title)]
        if said == title or ignore_case and said.lower() == title.lower():
            return max(at, after_blanks(text, at + len(title)))
    return at


class Ends(NamedTuple):
    """What a name ends before, besides a comma: blanks and a word that begins so, blanks and a whole word, a bracket with such a start."""

    starts: tuple[str, ...]
    words: frozenset[str]
    brackets: tuple[str, ...]
    ignore_case: bool


AFTER_TITLED = Ends(params.PERSON_STARTS, frozenset(params.NAME_ENDS), ("(",), False)
AFTER_NUMBERED = Ends(params.PARTY_STARTS, frozenset(), tuple("(" + b for b in params.PARTY_BRACKETS), True)
#: Letters to look ahead for any of them.
AHEAD = 1 + max(len(x) for e in (AFTER_TITLED, AFTER_NUMBERED) for x in (*e.starts, *e.words, *e.brackets))


def ends_here(text: str, at: int, ends: Ends) -> bool:
    """Whether a name ends at ``at``."""
    sign = text[at : at + 1]
    if sign == ",":
        return True
    if sign != "(" and not sign.isspace():
        return False
    after = BLANKS.match(text, at).end()
    ahead = text[after : after + AHEAD]
    if ends.ignore_case:
        ahead = ahead.lower()
    if ahead.startswith("("):
        return ahead.startswith(ends.brackets)
    return after > at and (ahead.startswith(ends.starts) or bool(ends.words) and word_at(text, after) in ends.words)


def titled(text: str, start: int) -> tuple[str, int]:
    """The name after a title, with its end: letters, full stops and blanks up to where it ends, two signs at least."""
    limit, at = start + 1 + LONGEST_TITLED, start
    while (piece := RUNS.match(text, at, limit)) is not None:
        blank = piece[0].isspace()
        if at == start and piece.end() == start + 1 and is_blank(text, start + 1):
            at = start + 2  # behind a single letter one sign belongs to the name whatever it is
        else:
            line = piece[0].find("\n") if blank else -1
            at = piece.end() if line < 0 else at + line
        if at - start >= 2 and (at == len(text) or text[at] == "\n" or ends_here(text, at, AFTER_TITLED)):
            return text[start:at], at
    return "", -1


def initialled(text: str, at: int, word: str) -> tuple[str, int]:
    """A name with an initial before or behind it."""
    end = at + len(word)
    if len(word) == 1 and text.startswith(".", end):
        here = BLANKS.match(text, end + 1).end()
        name = word_at(text, here)
        if not plain_word(name):
            return "", -1
        end = here + len(name)
        here = after_blanks(text, end)
        if plain_word(more := word_at(text, here)):
            end = here + len(more)
            here = after_blanks(text, end)
        if len(last := word_at(text, here)) == 1 and is_capital(last):
            end = here + 1
        return text[at:end], end
    if plain_word(word):
        here = after_blanks(text, end)
        if len(last := word_at(text, here)) == 1 and is_capital(last):
            return text[at : here + 1], here + 1
    return "", -1


def kin(text: str, at: int) -> tuple[str, int]:
    """Up to ``KIN_NAMES`` capitalised words, with full stops, behind a word of kin and perhaps a title."""
    here = after_blanks(text, at)
    if here < 0:
        return "", -1
    for start in dict.fromkeys((past_title(text, here, False), here)):
        end, at = -1, start
        for _ in range(KIN_NAMES):
            name = run(DOTTED, text, at)
            if not name or not is_capital(name[0]):
                break
            glued = word_at(text, at + len(name)) != ""  # the last of its words is no word of letters
            if glued and "." not in name:
                break
            end = at + (name.rindex(".") + 1 if glued else len(name))
            at = -1 if glued else after_blanks(text, end)
        if end > start:
            return text[start:end], end
    return "", -1


@cache
def firm_ends() -> dict[str, tuple[str, ...]]:
    forms: dict[str, list[str]] = {}
    for firm in params.FIRM_WORDS:
        for form in {firm, firm.upper()}:
            forms.setdefault(form.split(" ")[0], []).append(form)
    return {k: tuple(sorted(v, key=len, reverse=True)) for k, v in forms.items()}


def firm(text: str, at: int) -> tuple[str, int]:
    """One to ``FIRM_NAMES`` capitalised words before a firm's word, as many as there are."""
    ends, here, best = firm_ends(), at, -1
    for _ in range(FIRM_NAMES):
        word = run(FIRM_WORD, text, here)
        if not 1 <= len(word) - 1 <= LONGEST_FIRM_WORD or not is_capital(word[0]):
            break
        here = after_blanks(text, here + len(word))
        if here < 0:
            break
        for form in ends.get(run(LETTERS, text, here), ()):
            end = phrase_end(text, here, form)
            if end > 0 and not word_at(text, end):
                best = end
                break
    return (text[at:best], best) if best > 0 else ("", -1)


def spoken(text: str, at: int) -> tuple[str, int]:
    """One name, perhaps with a second word or an initial, behind a word of speech."""
    here = after_blanks(text, at)
    for lead in params.SPEECH_LEADS:
        if text.startswith(lead, here) and after_blanks(text, here + len(lead)) > 0:
            here = after_blanks(text, here + len(lead))
            break
    name = run(SPOKEN_WORD, text, here)
    if len(name) < 2 or not is_capital(name[0]):
        return "", -1
    end = here + len(name)
    more = after_blanks(text, end)
    if more > 0 and more < len(text) and is_capital(text[more]):
        end = more + max(1, len(run(SPOKEN_WORD, text, more)))
    return text[here:end], end


def numbered(text: str, at: int) -> tuple[str, int]:
    """A party behind its number: letters, full stops and blanks up to a comma or what is said about it."""
    here = after_blanks(text, at)
    if here < 0:
        return "", -1
    for start in dict.fromkeys((past_title(text, here, True), here)):
        end = start
        while (piece := RUNS.match(text, end)) is not None:
            if end > start and piece[0].isspace() and said_share(text, piece.end()):
                return text[start:end], end
            end = piece.end()
            if ends_here(text, end, AFTER_NUMBERED):
                return text[start:end], end
        if end > start:
            break
    return "", -1


def said_share(text: str, at: int) -> bool:
    digits = run(DIGITS, text, at)
    return bool(digits) and text.startswith("%", at + len(digits))


def address(text: str, sign: int, free: int) -> tuple[str, int]:
    """The payment address around the @ at ``sign``, from ``free`` on."""
    handle = word_at(text, sign + 1)
    if handle.lower() not in params.UPI_HANDLES:
        return "", -1
    low = sign
    while low > max(free, sign - MOST_ADDRESS) and text[low - 1] in ADDRESS_SIGNS:
        low -= 1
    for start in range(low, sign - LEAST_ADDRESS + 1):
        inside, before = WORD.match(text[start]) is not None, start > 0 and WORD.match(text[start - 1]) is not None
        if inside != before:
            return text[start : sign + 1 + len(handle)], sign + 1 + len(handle)
    return "", -1


@cache
def telling() -> re.Pattern[str]:
    """Words that a rule may start at: capitalised, of speech or kin, ending in a digit, or before the @ of an address."""
    speech = "|".join({p[0].lower() + p[1:].split(" ")[0] for p in params.SPEECH_WORDS})
    kin_words = {WORD.match(p)[0] for p in params.KIN_WORDS}
    slashed = "".join(w + w.upper() for w in kin_words if len(w) == 1)
    ends = "|".join(f"(?<={w}|{w[0].upper()}{w[1:]})" for w in sorted(kin_words) if len(w) > 1)
    return re.compile(rf"(?<!\w)(?:[A-Z]\w*+|(?:{speech})(?!\w)|\w++(?:(?<=[0-9])|(?=@|[-.][^@\s]{{0,{MOST_ADDRESS}}}@)|(?<=[{slashed}])(?=/)|{ends}))")


def in_order(text: str) -> Iterator[tuple[int, Found]]:
    """(rule, candidate) as the words of a text come; a rule's own candidates do not overlap."""
    titles, kins, speech, names = phrases(params.HONORIFICS), phrases(params.KIN_WORDS), phrases(params.SPEECH_WORDS), frozenset(params.GIVEN_NAMES)
    free, kin_ends = [0] * len(params.NAME_RULES), tuple(kins)

    def say(rule: int, start: int, name: str, end: int) -> Iterator[tuple[int, Found]]:
        if end > 0 and start >= free[rule]:
            free[rule] = end
            yield rule, Found(name, *params.NAME_RULES[rule])

    for m in telling().finditer(text):
        word, at, end = m[0], m.start(), m.end()
        if is_capital(word[0]):
            for title in titles.get(word, ()):
                if title[0] == word[0] and text.startswith(title, at) and is_blank(text, at + len(title)) and at >= free[0]:
                    here = after_blanks(text, at + len(title))
                    if here < len(text) and is_capital(text[here]):
                        yield from say(0, at, *titled(text, here))
                    break
            if at >= free[1]:
                yield from say(1, at, *initialled(text, at, word))
            if at >= free[3]:
                yield from say(3, at, *firm(text, at))
            if word[1:].islower() and word.lower() in names and plain_word(word):
                yield from say(6, at, word, end)
        if word.endswith(kin_ends):  # "midwife of" counts as well
            for first in kin_ends:
                start = end - len(first)
                name, after = "", -1
                for phrase in kins[first] if word.endswith(first) and start >= free[2] else ():
                    if after < 0 and (behind := phrase_end(text, start, phrase)) > 0:
                        name, after = kin(text, behind)
                yield from say(2, start, name, after)
        for phrase in speech.get(word, ()) if at >= free[4] else ():
            if text.startswith(phrase, at):
                name, after = spoken(text, at + len(phrase))
                if after > 0:
                    yield from say(4, at, name, after)
                    break
        last = word[-1]
        if "0" <= last <= "9":
            if text.startswith(".", end) and at >= free[5] and is_blank(text, end + 1):
                yield from say(5, at, *numbered(text, end + 1))
            local = word[2:] if len(word) == 12 and word.startswith("91") and at > 1 and text[at - 1] == "+" and word_at(text, at - 2) else word
            if len(local) == 10 and local.isdigit() and local[0] in "6789":
                yield from say(8, at, local, end)
        if text.startswith("@", end) or end + 1 < len(text) and text[end] in "-." and "@" in text[end : end + MOST_ADDRESS]:
            sign = text.find("@", end, end + MOST_ADDRESS)
            if sign >= free[7]:
                name, after = address(text, sign, free[7])
                if after > 0:
                    yield from say(7, max(at, free[7]), name, after)


@cache
def by_first(starts: tuple[str, ...]) -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = {}
    for start in starts:
        parts = start.lower().split(" ")
        out.setdefault(parts[0], []).append(parts)
    return out


def without_start(words: list[str], starts: tuple[str, ...]) -> list[str]:
    """Without the first of ``starts`` (phrases, in any case) that the words begin with, if something is left."""
    for parts in by_first(starts).get(words[0].lower(), ()):
        if len(words) > len(parts) and [w.lower() for w in words[: len(parts)]] == parts:
            return words[len(parts) :]
    return words


def clean(raw: str) -> str:
    """A candidate without outer signs, titles, lead-in words and a trailing word of kin; blanks are single."""
    name = " ".join(raw.split())
    first = WORD.search(name)
    if first is None:
        return ""
    end = len(name)
    while not WORD.match(name, end - 1):
        end -= 1
    words = name[first.start() : end].split(" ")
    words = without_start(words, params.TITLES)
    words = without_start(words, params.LEAD_INS)
    if len(words) > 1 and words[-1].lower() in by_first(params.KIN_ENDS):
        words = words[:-1]
    return " ".join(without_start(words, ("s",)))


@cache
def end_words(words: tuple[str, ...]) -> tuple[frozenset[str], int]:
    return frozenset(words), max(w.count(" ") + 1 for w in words)


def stands_at_end(upper: str, listed: tuple[str, ...]) -> bool:
    """Whether one of the phrases is the name or stands at its start or end."""
    phrases, most = end_words(listed)
    words = upper.split(" ")
    return any(" ".join(words[:k]) in phrases or " ".join(words[-k:]) in phrases for k in range(1, min(most, len(words)) + 1))


def is_name(name: str) -> bool:
    """Whether a cleaned candidate may be a name: length, no file, no stop word or address word at either end, no bare number."""
    if not 3 <= len(name) <= 60:
        return False
    upper, bare, mobile = name.upper(), name.replace(" ", "").replace(".", "").replace("-", ""), name.replace(" ", "").replace("-", "")
    if bare.isnumeric() and not (len(mobile) == 10 and mobile[0] in "6789"):
        return False
    if "." in name and name.lower().rpartition(".")[2] in params.FILE_ENDS:
        return False
    if upper.startswith("UNKNOWN") or "STRIPPED" in upper or upper.endswith(("DEPT", "DEPARTMENT")):
        return False
    return not stands_at_end(upper, params.NO_NAMES) and not stands_at_end(upper, params.PLACE_WORDS)


def scan(text: str) -> list[Found]:
    """The candidates of a text, rule by rule, cleaned and judged."""
    rules: list[list[Found]] = [[] for _ in params.NAME_RULES]
    for rule, found in in_order(text):
        name = found.name
        if rule == 3:
            name = " ".join(without_start(name.split(), params.FIRM_LEADS))
        name = clean(name)
        if is_name(name):
            rules[rule].append(found._replace(name=name))
    return [x for rule in rules for x in rule]


def merged(found: Iterable[tuple[Found, int]]) -> list[tuple[str, str, str, str, float, int]]:
    """(key, name, category, role, confidence, mentions): candidates that agree but for case are one, of the most confident one's
    category; a single word goes to the first longer name that holds it as a word."""
    by: dict[str, list] = {}
    for x, n in found:
        e = by.setdefault(x.name.lower(), [x.name, x.category, x.role, x.confidence, 0])
        e[4] += n
        if x.confidence > e[3]:
            e[1:4] = x.category, x.role, x.confidence
    holder: dict[str, str] = {}
    for key in by:
        for word in key.replace(".", " ").split():
            if word != key:
                holder.setdefault(word, key)
    gone = set()
    for key in by:
        if " " not in key and key in holder:
            by[holder[key]][4] += by[key][4]
            gone.add(key)
    return [(k, *e) for k, e in by.items() if k not in gone]


def slug_of(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


class Known(NamedTuple):
    """Names of a text that are known beforehand: an array column and what its names are."""

    names: Column | None
    category: str
    role: str
    confidence: float


#: A profile whose whole name stands in the text.
AUDITEE = Known(None, "AUDITEE", "Target Auditee / Custodian", 0.98)


def risk_of(category: str) -> tuple[int, str]:
    return (85 if category in params.RAISED else 70), ("HIGH" if category in params.RAISED_HIGH else "MEDIUM")


FIELDS = (
    ("place", "int", pa.int32()), ("name", "string", pa.string()), ("slug", "string", pa.string()), ("category", "string", pa.string()), ("role", "string", pa.string()), ("confidence", "double", pa.float64()),
    ("mentions", "long", pa.int64()), ("risk_score", "int", pa.int32()), ("risk_level", "string", pa.string()),
)


def entities_of(text: str, extra: Sequence[tuple[Known, Iterable[str | None]]] = ()) -> list[tuple]:
    """The rows of one text in the order of ``FIELDS``."""
    found = scan(text)
    for known, names in extra:
        found += [Found(name, *known[1:]) for raw in names or () if is_name(name := clean(raw or ""))]
    rows = [(name, "ent_" + slug_of(key), category, role, sure, n, *risk_of(category)) for key, name, category, role, sure, n in merged((x, 1) for x in found)]
    return [(i + 1, *r) for i, r in enumerate(sorted(rows, key=lambda r: (-r[5], -r[4], r[0])))]


def names_of(
    docs: DataFrame, id_col: str, text: str, keywords: DataFrame | None = None, profiles: DataFrame | None = None, extra: Sequence[Known] = ()
) -> DataFrame:
    """The named entities of each text: id, place, name, slug, category, role, confidence, mentions, risk_score, risk_level, known.

    A row of ``docs`` is a text; place orders its entities by mentions, confidence and name. profiles: name, of
    investigations, found as whole words (0.98); keywords: name, marks ``known``; extra: names known beforehand, such as
    speakers. Null and empty texts have no names of their own. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(k.names.alias(f"k{i}") for i, k in enumerate(extra)))
    listed = list(extra)
    listed_names = None
    if profiles is not None:
        cleaned = F.udf(lambda raw: None if raw is None else clean(raw), T.StringType())
        names = profiles.select(cleaned("name").alias("name")).filter("length(name) >= 3").distinct()
        listed_names = small_list(names, "name")
        if listed_names is None:
            met = hits(rows.select("id", "text"), names).groupBy(F.col("id").alias("p_id")).agg(F.array_sort(F.collect_set("name")).alias("p_names"))
            rows = rows.join(met, F.col("id").eqNullSafe(F.col("p_id")), "left").drop("p_id")
            listed.append(AUDITEE)
    plain = [k._replace(names=None) for k in listed]  # columns stay on the driver

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(listed_names) if listed_names is not None else None
        for batch in batches:
            ids, columns = [], [[] for _ in FIELDS]
            for i in range(batch.num_rows):
                given = [(k, batch.column(2 + j)[i].as_py()) for j, k in enumerate(plain)]
                if lexicon is not None:
                    given.append((AUDITEE, sorted({name for _, name in lexicon.hits(batch.column(1)[i].as_py())})))
                for row in entities_of(batch.column(1)[i].as_py(), given):
                    ids.append(i)
                    for values, value in zip(columns, row, strict=True):
                        values.append(value)
            arrays = [pa.array(v, kind) for v, (_, _, kind) in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *arrays], ["id", *(n for n, _, _ in FIELDS)])

    schema = T.StructType([rows.schema["id"], *(T._parse_datatype_string(f"{n} {kind}")[0] for n, kind, _ in FIELDS)])
    out = spread(rows).mapInArrow(read, schema)
    known = F.lit(False)
    if keywords is not None:
        marks = keywords.select(F.lower(F.trim("name")).alias("k")).distinct().withColumn("hit", F.lit(True))
        out, known = out.join(marks, F.lower("name") == F.col("k"), "left"), F.coalesce("hit", F.lit(False))
    return out.select(F.col("id").alias(id_col), *(n for n, _, _ in FIELDS), known.alias("known"))


def citations(pages: DataFrame, doc: str, page: str, text: str, **known: DataFrame) -> DataFrame:
    """The names of documents with the pages that they stand on: doc, name, category, mentions, pages (sorted)."""
    rows = pages.select(F.struct(doc, page).alias("at"), F.col(text).alias("said"))
    found = names_of(rows, "at", "said", **known)
    return found.groupBy(F.col(f"at.{doc}").alias(doc), F.lower("name").alias("key")).agg(
        F.min("name").alias("name"), F.max_by("category", F.struct("confidence", "category")).alias("category"), F.sum("mentions").alias("mentions"), F.array_sort(F.collect_set(f"at.{page}")).alias("pages")
    )


def identifier(name: Column, kind: Column) -> Column:
    """The canonical identifier of an entity of a kind."""
    raw, up = F.trim(name), F.upper(kind)
    packed = lambda signs: F.regexp_replace(raw, signs, "")
    key = canonical_name(raw)
    return (
        F.when(up == "EMAIL_ID", F.concat(F.lit("EMAIL:"), F.lower(raw)))
        .when(up == "BANK_ACCOUNT", F.concat(F.lit("ACC:"), F.upper(packed(r"[\s\-]"))))
        .when(up == "PHONE", F.concat(F.lit("PHONE:"), packed(r"[\s\-()+]")))
        .when(up == "PO", F.concat(F.lit("PO:"), F.upper(packed(r"\s+"))))
        .when(up == "INVOICE", F.concat(F.lit("INV:"), F.upper(packed(r"\s+"))))
        .otherwise(F.concat(up, F.lit(":"), F.when(key != "", key).otherwise(F.upper(raw))))
    )
