"""Similar names against comparing all of them; resolution by steps worked by hand."""

import random

import pytest
from casefile.operators import fuzzynames as fz
from casefile.operators import linking, screening

SYLLABLES = ("KA", "RU", "MI", "TAN", "SEL", "VO", "BRI", "DEX", "LON", "PA", "TI", "GRA", "MO", "NER", "ZU", "HAL", "OP", "EN", "SH", "CO")
ENDS = ("TRADERS", "ENGINEERS", "AGENCY", "A", "B")


def made_up(rng, count):
    def one():
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
        return " ".join(words + [rng.choice(ENDS)] * rng.randint(0, 1))

    def near(name):
        signs = list(name)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(signs) + 1)
            signs[i : i + (rng.random() < 0.5)] = rng.choice(["", "X", " ", "E"])
        words = "".join(signs).split()
        if rng.random() < 0.3:
            rng.shuffle(words)
        return " ".join(words) or "X"

    base = [one() for _ in range(count // 2)]
    return base + [near(rng.choice(base)) for _ in range(count - len(base))]


@pytest.mark.parametrize("percent", [85, 75, 100])
def test_no_similar_pair_is_lost(spark, percent):
    rng = random.Random(percent)
    names = [(rng.choice("ABCDE"), n) for n in made_up(rng, 600)] + [("A", x) for x in ("A", "AB", "ABC", "ABCD", "ABD", "A B", "AB C", "BA", "", None, "X" * 90, "X" * 80 + " YZ")]
    got = [tuple(r) for r in fz.similar_names(spark.createDataFrame(names + names[:5], "cls string, key string").selectExpr("*", "1 AS w", "2 AS g", "3 AS n"), percent).collect()]
    known = sorted({n for n in names if n[1]})
    want = {(c, a, b, s) for i, (c, a) in enumerate(known) for e, b in known[i + 1 :] if e == c and (s := fz.similarity(a, b)) >= percent}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_fuzzy_search_equals_comparing_every_token(spark, monkeypatch):
    import re

    monkeypatch.setattr(screening, "KNOWN_TOKENS", 7)
    rng, keywords = random.Random(4), ["Widget", "red-ring", "bolt", "bolts", "x"]
    texts = [" ".join(rng.choice(["widgit", "Wid-get", "bold", "bolt.", "ring", "redring", "é", "widgets", "xx", "reding", "b o l t"]) for _ in range(rng.randint(0, 4))) for _ in range(200)] + [None, ""]

    def plain(said):
        tokens = re.findall("[a-z0-9]+", said.lower())
        best = (-1, None)
        for k in keywords:
            kw = re.sub("[^a-z0-9]", "", k.lower())
            ratios = [int(fz.ratio(t, kw)) for t in tokens]
            score = 100 if kw in "".join(tokens) else max([r for r in ratios if r >= 80], default=0)
            if score > best[0]:
                best = (score, k)
        return best

    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["i"]: (r["fuzzy_score"], r["fuzzy_keyword"]) for r in screening.fuzzy(spark.createDataFrame(rows, "i int, t string"), "t", keywords).collect()}
    assert got == {i: plain(t) for i, t in rows if t is not None and plain(t)[0] >= 80} and len({v for v in got.values()}) > 5


def test_likeness():
    assert fz.lcs("ABCBDAB", "BDCABA") == 4 and fz.ratio("", "") == 100 and fz.ratio("AB", "AB") == 100 and fz.ratio("AB", "CD") == 0
    assert fz.word_set_ratio("ACME", "ACME TRADERS") == 100 and fz.word_set_ratio("B A", "A B") == 100 and fz.word_set_ratio("", "A") == 0
    assert round(fz.word_set_ratio("ACME TRADERS", "ACME TRADER"), 2) == 95.65 and fz.word_set_ratio("AB", "CD") == 0
    with pytest.raises(ValueError):
        fz.similar_names(None, 60)


def test_resolution_by_steps(spark):
    rows = [
        (1, "Acme Traders Pvt Ltd", "VENDOR", "N 1"), (2, "TRADERS acme", "company", None), (3, "acme traders pvt ltd ", "EMPLOYEE", None), (4, "Zed", "VENDOR", "n1"), (5, "Ravi Kumar", "EMPLOYEE", "E1"),
        (6, "Mira Sen", "EMPLOYEE", "E1"), (7, "Ravi Kumarr", "EMPLOYEE", "E1"), (8, "RK", "VENDOR", None), (9, "???", "VENDOR", None), (10, "!!", "VENDOR", None), (11, None, None, None), (12, "Acme Traderz", "BANK", None),
        (13, "RK", "EMPLOYEE", None), (14, "Acme Tradersx Ltd", "CUSTOMER", " "),
    ]
    names = spark.createDataFrame(rows, "id long, name string, kind string, number string").selectExpr("*", "1 AS key", "2 AS cls", "3 AS said")
    aliases = spark.createDataFrame([(5, " rk "), (6, "RK"), (1, ""), (1, None)], "id long, alias string")
    got = {r["id"]: (r["entity"], r["step"]) for r in linking.resolve_entities(names, "id", "name", "kind", "number", aliases).collect()}
    assert got == {
        1: (1, None), 2: (1, "similar"), 3: (1, "name"), 4: (4, None), 5: (5, None), 6: (6, None), 7: (5, "identifier"), 8: (5, "alias"), 9: (9, None), 10: (10, None), 11: (11, None), 12: (12, None), 13: (5, "name"), 14: (1, "similar"),
    }
    assert linking.resolve_entities(names.limit(0), "id", "name", "kind", "number", aliases).count() == 0
