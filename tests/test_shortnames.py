"""Short names among many meet over deletions: nothing is lost, and few meet that are not similar."""

import random

import pytest
from casefile.operators import fuzzynames as fz
from casefile.operators import shortnames

from tests.test_fuzzynames import made_up


def codes(rng, count, signs):
    code = lambda n: "".join(rng.choice(signs) for _ in range(n))
    return [rng.choice([f"ACME {code(10)}", f"{code(5)} {code(5)}", code(10), f"X{code(4)} ACME {code(4)}", f"T {code(3)} ACME", code(2)]) for _ in range(count)]


@pytest.mark.parametrize(("percent", "few", "keys"), [(85, 64, 600), (85, 1, 200), (75, 2, 600)])
def test_no_similar_pair_of_many_is_lost(spark, monkeypatch, percent, few, keys):
    monkeypatch.setattr(fz, "MANY", 0)
    monkeypatch.setattr(shortnames, "FEW", few)
    monkeypatch.setattr(shortnames, "KEYS", keys)
    rng = random.Random(percent + few)
    texts = made_up(rng, 200) + codes(rng, 250, "0123") + ["X" * 90, "X" * 80 + " YZ", "A A B", "B A", "A B C D E F", "A B C D E G", "", None]
    names = [(rng.choice("AB"), n) for n in texts] + [(None, "A B")]
    got = [tuple(r) for r in fz.similar_names(spark.createDataFrame(names + names[:5], "cls string, key string"), percent).collect()]
    known = sorted({n for n in names if n[0] and n[1]})
    want = {(c, a, b, s) for i, (c, a) in enumerate(known) for e, b in known[i + 1 :] if e == c and (s := fz.similarity(a, b)) >= percent}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_what_meets_does_not_grow_with_the_square(spark, tmp_path):
    rng = random.Random(1)
    code = lambda k: "".join(rng.choice("0123456789ABCDEF") for _ in range(k))
    names = [("F", f"V{code(8)} Q{code(8)}") for _ in range(2000)]
    df = spark.createDataFrame(names + [("F", names[0][1][10:] + " " + names[0][1][:9])], "cls string, key string")
    met, letters = shortnames.over_deletions(df, 85)
    assert letters == shortnames.LETTERS and 1 <= met.distinct().count() <= 20
    assert fz.over_letters(df, 85).count() > 2000  # letter pairs of the same names
    assert fz.over_letters(df, 85, letters).count() == 0
