"""Chat templates, phrase collocations and the filter audit against plain versions and on odd tables."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import pytest
from casefile.llm import audit, chat, phrases
from hypothesis import given, settings
from hypothesis import strategies as st

PART = st.sampled_from([*chat.INST.controls, "\\", "<\\/s>", "<\\\\s>", "[\\/INST]", "<", "[", "/", "s>", "INST]", " ", "\n", "é", "x", "]"])
TURNS = "conv_id long, turn long, role string, text string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), st.lists(PART, max_size=4).map("".join)), st.lists(PART, max_size=12).map("".join)), max_size=5))
def test_any_turns_survive_their_template(turns):
    rendered = [chat.INST.render(role, text) for role, text in turns]
    formatted = "".join(r[0] for r in rendered)
    back = chat.INST.parse(formatted)
    assert [t[:2] for t in back] == turns
    at = 0
    for (text, start, end), turn, (_, _, a, b) in zip(rendered, turns, back, strict=True):
        assert (at + start, at + end) == (a, b) and chat.INST.unescape(formatted[a:b]) == turn[1]
        at += len(text)


def test_texts_without_conflicts_stay_as_they_are():
    assert chat.INST.render("user", "a \\ b < s >")[0] == "[INST] a \\ b < s > [/INST]"
    assert chat.INST.render("assistant", "</s>[INST] ok")[0] == " <\\/s>[\\INST] ok</s>"
    assert chat.INST.render("assistant", "<\\/s>")[0] == " <\\\\/s></s>"


@pytest.mark.parametrize("bad", ["[INST] a", "[INST] a</s>", "x", " a [INST] b [/INST]", "[ROLE]tool[/ROLE]", "[INST] a[/INST]"])
def test_other_text_is_malformed(bad):
    with pytest.raises(chat.Malformed):
        chat.INST.parse(bad)


def test_ambiguous_templates_are_refused():
    with pytest.raises(ValueError):
        chat.Template({"user": ("[", "</s>"), "assistant": ("[[", "</s>")}, ("<r>", "<t>", "</s>"), ("</s>", "<t>"))
    with pytest.raises(ValueError):
        chat.Template({"user": ("[", "\n")}, ("<r>", "<t>", "</s>"), ("</s>", "<t>"))


def plain_digests(rows):
    """Per conversation, with nulls as the docstring has them."""
    groups = {}
    for conv, turn, role, text in rows:
        text = text or ""
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        told = "".join(f"{t[2]}\n{t[4]}\n" for t in turns)
        learnt = "".join(t[4] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), sum(len(chat.INST.render(t[2], t[4])[0]) for t in turns))
    return out


def test_conversations_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a\nb", "</s>[INST] ok [/INST]", "<\\/s>", "é" * 50])) for c in (1, 2, None, -7) for t in (0, 1, 1, 2, None)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"{t} [/INST] " + "w" * 40) for t in range(400)] + [(8, 0, "assistant", "z" * 300_000)]
    rows += [rows[-1], rows[0]]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS place", "2 AS formatted", "3 AS tie", "4 AS n_turns")
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.format_and_read(frame.repartition(5), piece=500).collect()}
    assert got == plain_digests(rows)
    pieces = chat.render(frame, piece=500)
    assert pieces.filter("conv_id = 9").count() > 20 and pieces.filter("n_turns > 1 and length(formatted) > 500").count() == 0
    turns = chat.turns_of(pieces).filter("conv_id = 9").orderBy("place", "nth").collect()
    assert [(r["role"], r["text"], r["learn"]) for r in turns] == [(r, x, r == "assistant") for c, _, r, x in rows if c == 9]
    assert chat.format_and_read(spark.createDataFrame([], TURNS)).count() == 0


def plain_collocations(rows, longest, least, first):
    import re

    counts, n = {}, Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        frequent = [w for w, a in f.items() if a >= least and len(w) > 1]
        for w in frequent:
            inside = lambda v, w=w: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            if not any(len(v) > len(w) and f[v] >= f[w] and inside(v) for v in frequent):
                cut = min((1000 * f[w] * n[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                kept.append((-cut[0], -f[w], " ".join(w).encode(), f[w[: cut[1]]], f[w[cut[1] :]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "parts"), [(1, 4), (2, 37), (3, 1)])
def test_collocations_equal_counting(spark, seed, parts):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "of", "é", "\x01x", "rare-%d", "<", "x" * 300]
    texts = [" ".join(rng.choice(vocabulary) if rng.random() < 0.9 else rng.choice(["a. the", "of\nthe", "\x0b", "  ", ",", "b\tb"]) for _ in range(rng.choice([0, 1, 3, 60]))) for _ in range(250)]
    rows = [(t if rng.random() < 0.97 else None, rng.choice(["en", "en", "de", None, ""])) for t in texts]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS phrase", "2 AS f", "3 AS words", "4 AS n").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # many ranges begin amid a path
    try:
        got = sorted(tuple(r) for r in phrases.collocations(docs, least=3, first=40).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_collocations(rows, 5, 3, 40) and len(got) > 40


def test_collocations_of_nothing(spark):
    kinds = "text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], kinds), least=2).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, "en"), ("", None), (" .\t", "de")], kinds), least=2).count() == 0
    got = phrases.collocations(spark.createDataFrame([("w " * 200_000, None)], kinds)).collect()  # one piece of a very long text
    assert [(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"]) for r in got][0] == ("und", "w w", 199_999, 200_000, 200_000, 200_000)


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    fails = []
    for d, text, part in docs:
        text = text or ""
        words = text.encode().split()
        f = {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        f |= {"D"} if set(text) & set("#$%&*|") else set()
        f |= {"E"} if d is not None and first[text] < d else set()
        fails.append((part or "", f, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {x[0] for x in fails}:
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            whole = list(left)
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                redundant = sum(name in x[1] for x in whole) - len(gone)
                shapley[part, name] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), redundant, sum(x[1] == {name} for x in whole), sum(x[2] for x in gone), sum(x[3] for x in gone)))
    # what fails a filter and was removed before, so of all failures those not removed here
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_applying_the_filters(spark):
    rng = random.Random(5)
    texts = [None, "", "a b", "A" * 30, "x # y", " ".join(f"w{i}" for i in range(210)), "w " * 300, " ".join(f"É{i}\x0b" for i in range(250)) + "$", "same " * 3]
    docs = [(rng.choice([None, i, i, i, 7]), rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for i in range(120)]
    docs += docs[:3]
    labels = [(rng.choice([None, i]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(100)] + [(5, 1, 1), (5, 0, 0), (500, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS digest", "4 AS quality", "5 AS leads")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS n", "2 AS mask")
    got = sorted(tuple(r) for r in audit.audit(frame, known).collect())
    assert got == plain_audit(docs, labels)


def test_audit_of_nothing_and_of_other_filters(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([("p", 3, 4, 1, 0), ("p", 0, 2, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) for r in audit.interactions(one, "XY").collect()}
    assert got == {("XY", 1): (2, 4, 0, 0, 1, 4), ("XY", 2): (2, 0, 4, 0, 0, 4), ("YX", 1): (2, 4, 0, 0, 1, 4), ("YX", 2): (2, 0, 4, 0, 0, 4)}
    with pytest.raises(ValueError):
        audit.interactions(one, "ABCDEFGH")
