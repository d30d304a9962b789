"""All pairs of similar names, without comparing all of them.

Names are canonical keys (capital letters, digits, single blanks). Two are similar by the larger of two ratios, each 200 * LCS / lengths:
that of the keys without blanks, and that of their sets of words (common words stand first; a set within another is 100).

Nothing is lost. A ratio of p percent leaves at most d = (100 - p) percent of the lengths to insert and delete, and an
insertion or deletion spoils at most two letter pairs of one name and one of the other. So similar names share t letter
pairs, and three of the rarest few of each name's pairs, in one order for all names, are common (prefix filter); how many
may follow bounds the overlap (position filter). Pairs within words, word ends included, do not depend on the order of
words, so the same holds for sets of words. Names of which one holds most of the other's words meet over the words that the
shorter one cannot do without, the rarest first. What meets is compared exactly.

Letter pairs tell little of very many names, as the pairs that meet grow with the square of the names. So short ones among many names
meet over what is left of them when a few letters are deleted (``shortnames``), and letter pairs are for pairs with a long name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casefile.operators.shortnames import is_long, over_deletions
from casefile.session import spread

#: Names up to which all meet over letter pairs.
MANY = 20_000
#: Letters of two names together up to which they meet over three letter pairs, and over two.
TRIPLES, PAIRS = 44, 160


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        both = row & where.get(c, 0)
        row = (row + both) | (row - both)
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def word_set_ratio(a: str, b: str) -> float:
    """Ratio of two sets of words; 100 if they share words and one holds no other."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (one & two, one - two, two - one))
    if common and not (left and right):
        return 100.0
    gap = 1 if common else 0
    n, m, c = len(left), len(right), len(common)
    best = 100 * (1 - (n + m - 2 * lcs(left, right)) / (2 * c + 2 * gap + n + m))
    if common:
        best = max(best, 100 * (1 - (gap + n) / (2 * c + gap + n)), 100 * (1 - (gap + m) / (2 * c + gap + m)))
    return best


def similarity(a: str, b: str) -> float:
    return max(word_set_ratio(a, b), ratio(a.replace(" ", ""), b.replace(" ", "")))


def apart(total: int, percent: int) -> int:
    """Most insertions and deletions between similar strings of ``total`` letters together; -1 if there is no such number of that parity."""
    d = (100 - percent) * total // 100
    return d - (d - total) % 2


@cache
def shared(n: int, m: int, percent: int, ends: int) -> int:
    """Letter pairs that similar strings of n and m letters share at least; ``ends``: 1 if the pairs with the word ends count. A large number if no such strings are similar."""
    d = apart(n + m, percent)
    return 1 << 30 if d < abs(n - m) else (n + m - 2 - 3 * d + 4 * ends + 1) // 2


@cache
def levels(n: int, percent: int, ends: int, least: int = 1) -> dict[int, int]:
    """How many letter pairs a string of n letters has to meet others of ``least`` letters or more over, with the least number that they share.

    Three where similar strings of these lengths share so many; fewer for long strings, which have too many triples but rare pairs.
    """
    out: dict[int, int] = {}
    for m in range(max(1, least, n * percent // (200 - percent)), n * (200 - percent) // percent + 2):
        if (need := shared(n, m, percent, ends)) < 1 << 30:
            level = max(1, min(need, 3 if n + m <= TRIPLES else 2 if n + m <= PAIRS else 1))
            out[level] = min(out.get(level, need), need)
    return out


def grams(text: str) -> list[str]:
    """Letter pairs, those that repeat with their number."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - 1):
        pair = text[i : i + 2]
        seen[pair] = seen.get(pair, 0) + 1
        out.append(pair + str(seen[pair]))
    return out


def forms(key: str) -> Iterator[tuple[int, str]]:
    """(ends, string whose letter pairs count): without blanks, and the sorted set of words with marked ends."""
    yield 0, key.replace(" ", "")
    yield 1, " " + " ".join(sorted(set(key.split()))) + " "


def letter_pairs(names: DataFrame) -> dict[str, int]:
    """How often each letter pair stands in all names; as many as pairs of letters, digits and blank, so few."""
    both = F.concat(F.lit(" "), "key", F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), F.length(both) - 1), lambda i: both.substr(i, F.lit(2)))
    return {r["g"]: r["count"] for r in names.select(F.explode(pairs).alias("g")).groupBy("g").count().collect()}


def over_letters(names: DataFrame, percent: int, short: int = 0) -> DataFrame:
    """(cls, a, b): names that share up to three of their rarest letter pairs and may share enough; those of which one at least has more than ``short`` letters, or many words."""
    names = names.select("cls", "key", is_long(short).alias("long"))
    # Short names stand under what they may share with long ones only.
    sets = F.array_join(F.array_distinct(F.filter(F.split("key", " "), lambda w: w != "")), " ")
    shortest = names.filter("long").agg(F.min(F.length(F.replace("key", F.lit(" "), F.lit("")))), F.min(F.length(sets))).first()
    if shortest[0] is None:
        return names.select("cls", F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    common = letter_pairs(names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (key, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for ends, text in forms(key):
                    n = len(text) - 2 * ends
                    if not n:
                        continue
                    ordered = sorted(grams(text), key=lambda g: (common.get(g[:2], 0), g))
                    for k, need in levels(n, percent, ends, 1 if own else shortest[ends]).items():
                        first = ordered[: max(0, len(ordered) - max(need, k) + k)]
                        for held in combinations(range(len(first)), k):
                            at.append(i)
                            out.append((f"{ends}{k}" + "".join(first[j] for j in held), n, len(ordered) - held[-1] - 1))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True))], ["cls", "key", "long", "g", "n", "rest"])

    each = spread(names).select("cls", "key", "long").mapInArrow(read, "cls string, key string, long boolean, g string, n int, rest int")
    a, b = (each.select("cls", "g", F.col("key").alias(s), F.col("long").alias(f"long_{s}"), F.col("n").alias(f"n_{s}"), F.col("rest").alias(f"rest_{s}")) for s in "ab")
    # Spark takes what mapInArrow returns to be as small as what it read; without the hint small names' keys, hundreds of times as many, pass through the driver.
    met = a.filter("long_a").join(b.hint("merge"), ["cls", "g"]).filter("a < b OR (a <> b AND NOT long_b)")
    total = F.col("n_a") + F.col("n_b")
    most = F.floor(F.lit(100 - percent) * total / 100)
    d = most - F.pmod(most - total, F.lit(2))
    ends, k = F.substring("g", 1, 1).cast("int"), F.substring("g", 2, 1).cast("int")
    need = F.floor((total - 1 - 3 * d + 4 * ends) / 2)
    met = met.filter((d >= F.abs(F.col("n_a") - F.col("n_b"))) & (k + F.least("rest_a", "rest_b") >= need))
    return met.select("cls", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def over_words(names: DataFrame, percent: int) -> DataFrame:
    """(cls, a, b): names that hold a word which the other cannot do without.

    The words of a that b lacks, with a blank, may be (200 - 2 p) / p of the common ones at most. So of a's words, the rarest first, one
    within the first that are longer together is in b.
    """
    words = names.select("cls", "key", F.explode(F.array_distinct(F.split("key", " "))).alias("w")).filter("w <> ''")
    often = words.groupBy("cls", "w").agg(F.count(F.lit(1)).alias("often"))
    each = words.join(often.hint("merge"), ["cls", "w"])
    by_rarity = Window.partitionBy("cls", "key").orderBy("often", "w")
    before = F.coalesce(F.sum(F.length("w") + 1).over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    letters = F.sum(F.length("w") + 1).over(Window.partitionBy("cls", "key")) - 1
    # Missing letters x with blanks: p * (1 + x) <= (200 - 2 * p) * s and s + 1 + x <= letters.
    spare = F.lit(200 - 2 * percent) * letters / F.lit(200 - percent)
    needed = each.withColumn("before", before).withColumn("spare", spare).filter("before <= spare").select("cls", "w", F.col("key").alias("x"))
    met = needed.join(each.select("cls", "w", F.col("key").alias("y")).hint("merge"), ["cls", "w"]).filter("x <> y")
    return met.select("cls", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_names(names: DataFrame, percent: int = 85) -> DataFrame:
    """(cls, a, b, score), a < b: all pairs of keys of one class whose similarity is at least ``percent``; (cls, key) rows, keys canonical.

    Empty and null keys are in no pair, equal keys are one. ``percent`` is from 70 to 100, so that similar names share letter pairs.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent is from 70 to 100")
    base = names.select("cls", "key").filter("key <> ''").distinct()
    met, short = over_deletions(base, percent) if base.count() > MANY else (None, 0)
    met = reduce(DataFrame.unionByName, [x for x in (met, over_letters(base, percent, short), over_words(base, percent)) if x is not None]).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [similarity(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            keep = pa.array([s >= percent for s in score], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], ["cls", "a", "b", "score"]).filter(keep)

    return met.mapInArrow(read, "cls string, a string, b string, score double")
