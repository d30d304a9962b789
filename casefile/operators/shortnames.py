"""Short similar names among very many: they meet over what is left of them when a few letters are deleted.

Two strings that d deletions make equal have a subsequence in common that each reaches by its share of them. Where that takes few keys a
string stands under all of its subsequences of that length ("whole"), so what meets is nearly always similar however many
names there are. Where it takes fewer, the shorter string is cut in two: of d deletions at most (d - 1) / 2 rounded up lie in its first part
or at most (d - 1) / 2 rounded down in its second, and the parts stand at the ends of the longer string. Names that share words but
not their order meet over a word that few have, or over the words that many have with the same keys of the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.session import spread

#: Letters of a short name at most, its words, and the keys that one string may have.
LETTERS, WORDS, KEYS = 24, 4, 600
#: Names up to which a word is rare: those that share it are compared.
FEW = 64
#: Keys for each partition in which they meet.
SHARE_KEYS = 2_000_000
#: Strings that are opened at a time.
STRINGS = 1000

#: A key: which part of the string stands under it ("W", "L", "R"), its letters, how many are deleted, the role (0: whole, 1: the shorter string, 2: the longer) and what it may meet.
Unit = tuple[str, int, int, int, tuple]


def most_deleted(n: int, m: int, total: int, percent: int) -> int:
    """Most deletions from strings of n and m letters that are similar as part of ``total`` letters; -1: none are."""
    d = (100 - percent) * total // 100
    d -= (d - n - m) % 2
    return d if d >= abs(n - m) else -1


def halves(n: int, m: int, d: int) -> Iterator[tuple[int, Unit]]:
    """(length of the string, key) for strings of n >= m letters that are cut in two."""
    a, b, h = (d + n - m) // 2, (d - n + m) // 2, m // 2
    for side, size, most in (("L", h, d // 2), ("R", m - h, (d - 1) // 2)):
        for e in range(-most, most + 1):
            deleted = min(b, a - e, (most - e) // 2, size)
            if deleted >= max(0, -e) and 0 <= size + e <= n:
                yield m, (side, size, deleted, 1, (n, m, e))
                yield n, (side, size + e, deleted + e, 2, (n, m, e))


@cache
def keys_of(n: int, m: int, d: int) -> dict[int, tuple[Unit, ...]]:
    """The keys over which similar strings of n >= m letters meet, by length of the string; the fewer of both kinds."""
    left = max(0, n - (d + n - m) // 2)
    whole = {k: (("W", k, k - left, 0, (left,)),) for k in {n, m}}
    if d < 2:
        return whole
    cut: dict[int, tuple[Unit, ...]] = {n: (), m: ()}
    for k, unit in halves(n, m, d):
        cut[k] += (unit,)
    count = lambda kind: sum(comb(u[1], u[2]) for units in kind.values() for u in units)
    return min(whole, cut, key=count)


def plan(n: int, others: dict[int, int], percent: int) -> tuple[Unit, ...]:
    """The keys of a string of n letters towards all that are as long as ``others``; (letters of the string: letters that count besides, at most)."""
    out: set[Unit] = set()
    for m in others:
        if (d := most_deleted(n, m, n + m + others[n] + others[m], percent)) >= 0:
            out.update(keys_of(max(n, m), min(n, m), d)[n])
    return tuple(sorted(out))


def count(units: tuple[Unit, ...]) -> int:
    return sum(comb(u[1], u[2]) for u in units)


@cache
def kept(size: int, deleted: int) -> np.ndarray:
    """The places that stay, one row for each way to delete."""
    return np.array(list(combinations(range(size), size - deleted)), np.intp).reshape(comb(size, deleted), size - deleted)


@cache
def marks() -> np.ndarray:
    """A number for each place and letter, the same in all tasks."""
    return np.random.default_rng(7).integers(0, 1 << 64, (LETTERS * 2, 256), np.uint64)


@cache
def mark(unit: tuple) -> np.uint64:
    return number(repr(unit))


def number(text: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little"))


def opened(letters: np.ndarray, units: tuple[Unit, ...], of: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(keys, role) of strings of one length, given as rows of letters; ``of`` tells apart what may not meet. A number of 64 bits stands for a key, so some meet that are not similar."""
    table = marks()
    n = letters.shape[1]
    for side, size, deleted, role, may in units:
        part = letters[:, n - size :] if side == "R" else letters[:, :size]
        at = kept(size, deleted)
        total = np.zeros((len(letters), len(at)), np.uint64)
        for j in range(at.shape[1]):
            total += table[j][part[:, at[:, j]]]
        yield (total + mark((side, size - deleted, may)) + of[:, None]), role


def rows_of(todo: dict[tuple, list[tuple[str, int, np.uint64]]], units: dict[tuple, tuple[Unit, ...]]) -> Iterator[pa.RecordBatch]:
    """g, id, role for strings (string, id, what tells them apart) of one length and plan each."""
    for which, strings in todo.items():
        for start in range(0, len(strings), STRINGS):
            some = strings[start : start + STRINGS]
            letters = np.array([[ord(c) & 255 for c in s] for s, *_ in some], np.intp).reshape(len(some), -1)
            ids, of = np.array([i for _, i, _ in some], np.int64), np.array([o for *_, o in some], np.uint64)
            for keys, role in opened(letters, units[which], of):
                g = keys.reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.repeat(ids, keys.shape[1])), pa.array(np.full(len(g), role, np.int8))], ["g", "id", "role"])


SCHEMA = "g long, id long, role byte"


def over_deletions(names: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """(cls, a, b), letters: short names that meet, and up to how many letters (without blanks, in ``WORDS`` words at most) no similar pair is lost; (cls, key) rows, distinct."""
    words = F.filter(F.split("key", " "), lambda w: w != "")
    ordered = F.array_sort(F.array_distinct(words))
    packed = lambda ws: F.array_join(ws, "")
    base = names.select("cls", "key", packed(words).alias("p"), packed(ordered).alias("s"), ordered.alias("ws"), is_long(LETTERS).alias("long"))
    base = base.filter("NOT long").drop("long")
    # Lengths, of which there are few, with the most blanks of any such name.
    found = {r["n"]: r["w"] for r in base.select(F.explode(F.array("p", "s")).alias("t"), (F.size("ws") - 1).alias("w")).groupBy(F.length("t").alias("n")).agg(F.max("w").alias("w")).collect()}
    letters = LETTERS
    while letters and any(count(plan(n, {k: w for k, w in found.items() if k <= letters}, percent)) > KEYS for n in found if n <= letters):
        letters -= 1
    others = {n: w for n, w in found.items() if n <= letters}
    units = {(n,): plan(n, others, percent) for n in others}
    short = base.filter((F.length("p") <= letters) & (F.length("s") <= letters))
    forms = short.select("cls", "key", F.explode(F.array_distinct(F.array("p", "s", F.concat(F.lit("="), "key")))).alias("t")).withColumn("id", F.xxhash64("cls", "t"))
    strings = forms.filter("NOT startswith(t, '=')").select("cls", "t", "id").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo: dict[tuple, list] = {}
            for cls, t, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                todo.setdefault((len(t),), []).append((t, i, number(f"{cls}\n")))
            yield from rows_of(todo, units)

    # Names that share words: those that few have are compared, those that many have stand before the keys of what is left.
    each = short.select("cls", "key", F.explode("ws").alias("w"))
    often = each.groupBy("cls", "w").agg(F.count(F.lit(1)).alias("often"))
    rare = each.join(often.filter(F.col("often").between(2, FEW)).hint("merge"), ["cls", "w"])
    one, two = (rare.select("cls", "w", F.col("key").alias(x)) for x in "ab")
    by_word = one.join(two.hint("merge"), ["cls", "w"]).filter("a < b").select("cls", "a", "b")
    many = each.join(often.filter(F.col("often") > FEW).hint("merge"), ["cls", "w"]).groupBy("cls", "key").agg(F.array_sort(F.collect_set("w")).alias("many"))
    lengths = [r[0] for r in many.select(F.length(F.array_join(F.array_sort(F.array_distinct(F.split("key", " "))), " "))).distinct().collect()]
    many = many.withColumn("id", F.xxhash64("cls", F.concat(F.lit("="), "key")))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple, tuple[Unit, ...]] = {}
        for batch in batches:
            todo: dict[tuple, list] = {}
            for cls, key, held, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sorted({*key.split()})
                for k in range(1, min(len(held), len(own) - 1) + 1):
                    for common in combinations(held, k):
                        rest, said = " ".join(w for w in own if w not in common), " ".join(common)
                        which = (len(rest), len(said))
                        if which not in plans:
                            plans[which] = plan(which[0], {n - which[1] - 1: which[1] + 1 for n in lengths if n > which[1] + 1}, percent)
                        todo.setdefault(which, []).append((rest, i, number(f"{cls}\n{said}")))
            yield from rows_of(todo, plans)

    keys = strings.transform(spread_all).mapInArrow(read, SCHEMA).unionByName(many.transform(spread_all).select("cls", "key", "many", "id").mapInArrow(share, SCHEMA))
    total = strings.count() * max(map(count, units.values()), default=0)
    keys = keys.repartition(max(keys.sparkSession.sparkContext.defaultParallelism, -(-total // SHARE_KEYS)), "g")
    x, y = (keys.select("g", F.col("id").alias(f"id_{s}"), F.col("role").alias(f"role_{s}")) for s in "xy")
    # The shorter (role 1) meets the longer (2); whole strings (0) meet once. One term, so both sides stay one exchange.
    met = x.join(y.hint("merge"), "g").filter("role_x * 2 - role_y = 0 AND (id_x < id_y OR role_x + role_y = 3 AND id_x <> id_y)")
    met = met.select("id_x", "id_y").distinct()
    held = forms.select("id", "cls", "key")
    a, b = (held.select(F.col("id").alias(f"id_{s}"), F.col("cls").alias(c), F.col("key").alias(k)) for s, c, k in (("x", "cls", "one"), ("y", "cls_y", "two")))
    pairs = met.join(a.hint("merge"), "id_x").join(b.hint("merge"), "id_y").filter("cls = cls_y").select("cls", "one", "two")
    same = a.join(b.hint("merge"), F.col("id_x") == F.col("id_y")).filter("cls = cls_y").select("cls", "one", "two")
    pairs = pairs.unionByName(same).filter("one <> two").select("cls", F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    return pairs.unionByName(by_word), letters


def spread_all(df: DataFrame) -> DataFrame:
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)


def is_long(letters: int):
    """Names that are not short: more than so many letters in either form, or too many words."""
    words = F.filter(F.split("key", " "), lambda w: w != "")
    return (F.length(F.array_join(words, "")) > letters) | (F.size(words) > WORDS)
