"""What still fits a gap, taken in key order: against going through the documents one by one, however they lie."""

import random
import time

import pytest
from casefile.llm import mixing

ROWS = "source string, key double, id string, size long, row long"


def by_hand(rows, gaps):
    out = set()
    for source, key, _, size, row in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] is not None, r[2] or "", r[3], r[4])):
        if size <= gaps[source]:
            gaps[source] -= size
            out.add(row)
    return out


def check(spark, rows, gaps, small):
    more, left = mixing.filled(spark.createDataFrame(rows, ROWS).repartition(4), spark.createDataFrame([(s, float(g) + 0.5) for s, g in gaps.items()], "source string, gap double"), small)
    want = by_hand(rows, gaps)
    got = [r["row"] for r in more.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["source"]: r["gap"] for r in left.collect()} == {s: g + 0.5 for s, g in gaps.items()}


@pytest.mark.parametrize("small", [0, 100, mixing.SMALL])
def test_adversarial_order_needs_few_rounds(spark, small, monkeypatch):
    """Sizes 1, g, 1, g - 1, ...: every document taken makes the next long one a word too long."""
    g, rows = 2500, []
    for i in range(g):
        rows += [("s", 2.0 * i, "a", 1, 2 * i), ("s", 2.0 * i + 1, "a", g - i, 2 * i + 1)]
    written = []
    plain = mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: (written.append(name), plain(df, name))[1])
    began = time.perf_counter()
    check(spark, rows, {"s": g}, small)
    assert time.perf_counter() - began < 60 and written.count("mix-round") <= 12  # binary digits of 2,500


def test_random_orders(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([0.5, rng.random()]), rng.choice([None, "x", "y"]), int(rng.choice([1, 2, 7, 64, 63, 65, 1000]) * rng.choice([1, 1, 3])), i) for i in range(700)]
    check(spark, rows, {"a": 700, "b": 64, "c": 1, None: 5000}, 0)
    check(spark, rows[:3], {"a": 0, "b": 0, "c": 0, None: 0}, 0)
    check(spark, [], {"a": 9}, mixing.SMALL)
