"""Names in texts: examples worked by hand, odd texts, time in proportion to the text, rows of conversations against one text."""

import time

import pytest
from pyspark.sql import functions as F

from casefile import params
from casefile.operators import entities, lexicon, mentions

PERSON, PATRONYMIC, KIN, FIRM, SPOKEN, PARTNER, LISTED, PAID, PHONE = (r[1] for r in params.NAME_RULES)

#: Text and its candidates (name, role), cleaned, rule by rule.
EXAMPLES = [
    ("Shri Venkatesan C, aged 40", [("Venkatesan C", PERSON), ("Venkatesan C", PATRONYMIC), ("Venkatesan", LISTED)]),
    ("Mr. Abel (x", [("Abel", PERSON)]),
    ("Mr. Abel residentially", [("Abel", PERSON)]),
    ("Mr. Abel fort", [("Abel fort", PERSON)]),
    ("Mr. Abel for it", [("Abel", PERSON)]),
    ("Mr. Abel9,", []),
    ("Mr. Abel\nMr. Cain", [("Abel", PERSON), ("Cain", PERSON)]),
    ("mr. Abel, Mr Cain,", []),
    ("Dr. A,", []),
    ("Mr. " + "A" * 36 + ",", [("A" * 36, PERSON)]),
    ("Mr. " + "A" * 37 + ",", []),
    ("C. Orwin Baxley D went", [("C. Orwin Baxley D", PATRONYMIC)]),
    ("Orwin B. went", [("Orwin B", PATRONYMIC)]),
    ("aC. Orwin", []),
    ("wife of Mr. S Orwin came", [("Orwin came", PERSON), ("Orwin", KIN)]),
    ("S/O Orwin Baxley", [("Orwin Baxley", KIN)]),
    ("s/O of Orwin, D/o Mira", [("Orwin", KIN), ("Mira", KIN)]),
    ("nominee is J. Mira. Then", [("J. Mira", PATRONYMIC), ("J. Mira. Then", KIN)]),
    ("wife orwin, sonof Mira", []),
    ("The Mirra Works Engineers Private  Limited", [("Mirra Works Engineers Private Limited", FIRM)]),
    ("Also Mirra PVT LTD", [("Mirra PVT LTD", FIRM)]),
    ("mirra Ltd, Mirra Ltda", []),
    ("Call Orwin about it, paid to about Mira K.", [("Mira K", PATRONYMIC), ("Orwin", SPOKEN), ("Mira K", SPOKEN)]),
    ("told Or Bax&Co", [("Or Bax&Co", SPOKEN)]),
    ("2. Orwin Baxley (Aadhar 1", [("Orwin Baxley", PARTNER)]),
    ("2. smt Mira 30% and", [("Mira", PARTNER)]),
    ("2. Orwin Baxley went home", []),
    ("Kumar, KUMAR", [("Kumar", LISTED)]),
    ("pay a-b.c@OkSbi, ab@upi x@y@ybl", [("a-b.c@OkSbi", PAID)]),
    ("9876543210 98765432101 5876543210", [("9876543210", PHONE)]),
    ("Ask Report.pdf, ask Main Road, ask Orwin Road", []),
    ("Ask Unknown, ask Accounts Dept, ask 12", []),
    ("", []),
    ("\x00퟿ é", []),
]


@pytest.mark.parametrize(("text", "want"), EXAMPLES)
def test_candidates(text, want):
    assert [(f.name, f.role) for f in entities.scan(text)] == want


def test_cleaning_and_judging():
    for raw, want in [(" (Mr.  Orwin) ", "Orwin"), ("M/s. Mirra", "Mirra"), ("called regarding Orwin", "Orwin"), ("Orwin Wife", "Orwin"), ("s Orwin", "Orwin"), ("with", "with"), ("..", ""), ("", "")]:
        assert entities.clean(raw) == want
    for name, fits in [("Orwin", True), ("Or", False), ("A" * 61, False), ("a.docx", False), ("x Page", False), ("Main Road", False), ("123 45", False), ("98765 43210", True), ("Sales Department", False)]:
        assert entities.is_name(name) is fits


def test_one_row_per_name():
    rows = entities.entities_of("Mr. Orwin Kumar, and Kumar. call ORWIN KUMAR now")
    assert [(r[1], r[3], r[5], r[6]) for r in rows] == [("Orwin Kumar", "PERSON", 0.9, 4)]


@pytest.mark.parametrize(
    "text",
    ["1." + " " * 100_000, "a" * 100_000, "1. " * 33_000, "Mr. Ab " * 15_000, "Ab " * 33_000, "wife of" + " " * 100_000, "wife of " * 12_000, "a@" * 50_000, "A. " * 33_000, "Abc&" * 25_000, "A&" * 50_000,
     "1. ab" + " ." * 50_000, "call " * 20_000, "x." * 50_000 + "@upi", "-" * 100_000 + "@upi", "Mr. Ab" + " " * 100_000 + "x", "Mr. Ab\n" * 15_000],
)
def test_time_in_proportion(text):
    began = time.perf_counter()
    entities.entities_of(text)
    assert time.perf_counter() - began < 5


def test_lines_of_a_call_equal_one_text(spark):
    lines = [("c", i, "Agent", t) for i, t in enumerate(["Mr. Orwin Kumar, came.", "call Kumar.", "", None, "Mirra Traders; told Mirra.", "9876543210 and Orwin Kumar."])] + [("e", 0, "Speaker 2", None), ("e", 1, None, "x"), (None, 0, "Mira", "call Kumar")]
    calls = spark.createDataFrame(lines, "call string, line int, who string, said string").selectExpr("*", "1 AS id", "2 AS name", "3 AS n", "4 AS key")
    got = {(r["call"], r["name"], r["category"], r["confidence"], r["mentions"]) for r in mentions.names_in_calls(calls, "call", "who", "said", "line").collect()}
    one = entities.entities_of("\n".join(f"{w}: {t}" for c, _, w, t in lines if t and c == "c"))
    assert got == {("c", r[1], r[3], r[5], r[6]) for r in one} | {("c", "Agent", "SPEAKER", 0.95, 1), (None, "Kumar", "CONVERSATION", 0.85, 2), (None, "Mira", "SPEAKER", 0.95, 1)}
    assert mentions.names_in_calls(calls.limit(0), "call", "who", "said", "line").count() == 0


def test_profiles_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, "ask orwin baxley"), (1, "ask Mira"), (2, None), (None, "ask Mira"), (3, "")], "i int, t string").selectExpr("*", "1 AS id", "2 AS text", "3 AS place")
    got = sorted(((r["i"], r["name"], r["category"], r["known"]) for r in entities.names_of(rows, "i", "t", keywords=spark.createDataFrame([("MIRA",), (None,)], "name string"), profiles=spark.createDataFrame([("Mr. Orwin Baxley",), ("xy",), (None,)], "name string")).collect()), key=repr)
    assert ("AUDITEE" in {g[2] for g in got}) and (1, "Orwin Baxley", "AUDITEE", False) in got and (1, "Mira", "CONVERSATION", True) in got and (None, "Mira", "CONVERSATION", True) in got
    assert rows.select(mentions.file_words(F.lit("a_b-c.PDF")).alias("w")).first().w == "a b c"


def test_listed_names_either_way(spark):
    rows = spark.createDataFrame([(1, "Orwin Baxley, orwin baxley; Orwin Baxleys x.y."), (1, "Baxley"), (2, None), (None, "(MIRA) mira_ Mira"), (3, "")], "id int, text string").selectExpr("*", "1 AS name", "2 AS word")
    names = spark.createDataFrame([("Orwin Baxley",), ("Baxley",), ("Mira",), ("Mira",), (None,), ("x.y.",), ("(x",)], "name string")
    want = {(1, "Orwin Baxley", 2, 0), (1, "Baxley", 2, 6), (1, "Baxley", 1, 0), (None, "Mira", 2, 1), (1, "x.y.", 1, 42)}
    for most in (lexicon.MOST_LETTERS, 0):
        assert {tuple(r) for r in lexicon.hits(rows, names, most).collect()} == want
    assert lexicon.hits(rows, names.limit(0)).count() == 0


def test_texts_that_come_again_are_scanned_once(spark, tmp_path):
    rows = [(i % 2, i, "Kum_Traders-x.pdf" if i % 3 else None, ["ask Orwin today", "Mr. Orwin Baxley, met Baxley", ""][i % 3], ["Mr. Orwin", "Scan", None][i % 3]) for i in range(60)]
    hits = spark.createDataFrame(rows, "c long, line long, file string, snippet string, author string")
    count = spark.sparkContext.accumulator(0)

    def counted(text, plain=mentions.scan):
        count.add(1)
        return plain(text)

    mentions.scan, plain = counted, mentions.scan
    try:
        got = mentions.names_in_hits(hits, "c", "file", "snippet", "author", "line").collect()
        said = mentions.names_in_chats(hits, "c", "author", "snippet", "line").collect()
    finally:
        mentions.scan = plain
    one = {c: {} for c in (0, 1)}
    for c, line, file, snippet, author in rows:
        texts = [file and file.removesuffix(".pdf").replace("_", " ").replace("-", " "), snippet, author and entities.is_name(entities.clean(author)) and "Author: " + author]
        for i, t in enumerate(texts):
            for nth, f in enumerate(entities.scan(t or "")):
                one[c].setdefault((line * 3 + i, nth), f)
    want = {(c, name, category, role, n) for c, found in one.items() for _, name, category, role, _, n in entities.merged((found[k], 1) for k in sorted(found))}
    assert {(r.c, r.name, r.category, r.role, r.mentions) for r in got} == want and any(n > 10 for *_, n in want)
    assert {r.name for r in said} >= {"Orwin Baxley"} and 0 < count.value <= 2 * (4 + 3)
