"""Phrase collocations: multi-word phrases whose weakest cut is still far more frequent than chance.

Counting goes level by level. A phrase can be frequent only if both phrases of one word less within it are, so a level counts
those occurrences alone; what one batch of texts holds is counted by sorting before it is exchanged. Which shorter phrases
are frequent is known from a filter of bounded size, which lets through more where it is full, and never less.

The frequent phrases of all lengths are one count stream, kept in two orders: by their words from the first on (prefix order)
and from the last on (suffix order). In prefix order a phrase follows every phrase that it begins with, so one pass that
holds the phrases on the current path, at most one per length, is the merge of the streams of all lengths in lockstep: it gives a phrase the
counts of its first parts, and a first part the count of its largest extension to the right. Suffix order gives the last
parts and extensions to the left. The two passes are merged by phrase. Streams are sorted in ranges; where one begins
amid a path, the at most ``longest`` - 1 phrases above it are looked up afterwards. No hash table of counts is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import LOWER, PLACE, batches_of, mix, text_bytes, word_hashes
from .held import drop, tidy
from .scratch import Workspace, written
from .substrings import hits, sieve

#: Bytes of text whose phrases are counted together before they are exchanged.
TOGETHER = 1 << 22
#: Language of texts without one.
NO_LANG = "und"

BLANK, BREAK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x09, 0x20]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a text column, A-Z lower-cased, and a number per word that grows from piece to piece and row to row."""
    data, offsets = text_bytes(column)
    kind = KIND[data]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = word[rows]
    starts = np.flatnonzero(first)
    piece = np.cumsum(kind == BREAK, dtype=np.int64)[starts] + np.searchsorted(offsets, starts, side="right")
    ends = np.append(np.cumsum(word, dtype=np.int64)[starts] - 1, np.count_nonzero(word))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[data[word]]))
    return words.dictionary_encode(), piece


def lang_seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def phrase_keys(hashes: np.ndarray, n: int, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Keys of all runs of n words, from the words' hashes; of each row where ``hashes`` has rows of n."""
    if hashes.ndim == 2:
        return mix((hashes * PLACE[:n]).sum(axis=1, dtype=np.uint64) + seed)
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        total += hashes[i : i + len(total)] * PLACE[i]
    return mix(total + seed)


def count_level(texts: DataFrame, n: int, shorter: bytes | None) -> DataFrame:
    """lang, phrase, f: partial counts of the n-word phrases whose n - 1 first and last words hit the filter ``shorter``.

    For single words there is no filter, and a row without phrase gives the number of words.
    """
    filter_bits = texts.sparkSession.sparkContext.broadcast(shorter) if shorter is not None else None  # its size is bounded

    def count(column: pa.Array, lang: str) -> pa.RecordBatch:
        words, piece = words_of(column)
        codes, known = words.indices.to_numpy().astype(np.int64), words.dictionary
        if n == 1:
            phrases = pa.concat_arrays([known.cast(pa.string()), pa.nulls(1, pa.string())])
            counts = np.append(np.bincount(codes, minlength=len(known)), len(codes))
        else:
            hashes = word_hashes(*text_bytes(known))[0]
            hit = hits(filter_bits.value, phrase_keys(hashes[codes], n - 1, lang_seed(lang)).view(np.int64))
            at = np.flatnonzero((piece[: len(piece) - n + 1] == piece[n - 1 :]) & hit[:-1] & hit[1:]) if len(codes) >= n else np.zeros(0, np.int64)
            rank, counts, one = codes[at], np.ones(len(at), np.int64), np.arange(len(at))
            for i in range(1, n):  # phrases of i + 1 words are numbered in order from those of i
                _, one, rank, counts = np.unique(rank * len(known) + codes[at + i], return_index=True, return_inverse=True, return_counts=True)
            parts = [known.take(pa.array(codes[at[one] + i])).cast(pa.string()) for i in range(n)]
            phrases = pc.binary_join_element_wise(*parts, " ")
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in tidy(batches):
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.column(1).filter(pc.equal(batch.column(0), lang))
                for start, end in batches_of(own, TOGETHER):
                    yield count(own.slice(start, end - start), lang)

    return texts.mapInArrow(read, "lang string, phrase string, f long")


def keyed(frequent: DataFrame, n: int) -> DataFrame:
    """One column, key: what ``count_level`` looks up for phrases of n words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = word_hashes(*text_bytes(batch.column(1)))[0].reshape(-1, n)
            seeds = np.array([lang_seed(x) for x in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(phrase_keys(hashes, n, seeds).astype(np.int64))], ["key"])

    return frequent.select("lang", "phrase").mapInArrow(read, "key long")


def frequent_phrases(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, f: phrases of one word to ``longest`` that occur ``least`` times, and per language a row without phrase."""
    levels: list[DataFrame] = []
    shorter = None
    for n in range(1, longest + 1):
        counts = count_level(texts, n, shorter).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        level = written(counts.filter(f"f >= {least} or phrase is null"), f"phrases-{n}")
        levels.append(level)
        if n < longest:
            shorter = sieve(F.col("key"), written(keyed(level.filter("phrase is not null"), n), f"phrases-keys-{n}"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def walk(counts: DataFrame) -> DataFrame:
    """lang, words, f, parts, grown: one pass over (lang, words, f) in the order of lang and words.

    parts: the counts of the first 1, 2, ... words, null where the range of the stream began behind them. grown: the
    largest count of a phrase of one word more, 0 if there is none. A row without f is such a phrase before the range, with what the
    range has grown it to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        path: list[list] = []  # [words, f, grown] of the phrases on the path, by length
        lang, ready = None, []

        def leave(depth: int) -> None:
            while len(path) > depth:
                words, f, grown = path.pop()
                ready.append((lang, words, f, [x[1] for x in path] if f is not None else None, grown))

        def flush() -> pa.RecordBatch:
            langs, words, f, parts, grown = zip(*ready, strict=True)
            ready.clear()
            arrays = [pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(f, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(grown, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "words", "f", "parts", "grown"])

        last: tuple = ()
        for batch in tidy(batches):
            for now, words, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != lang or words < last:  # another language, or another range of the stream
                    leave(0)
                lang, last = now, words
                depth = 0
                while depth < min(len(path), len(words) - 1) and path[depth][0][-1] == words[depth]:
                    depth += 1
                leave(depth)
                for k in range(depth + 1, len(words)):
                    path.append([words[:k], None, 0])
                if path:
                    path[-1][2] = max(path[-1][2], f)
                path.append([words, f, 0])
                if len(ready) >= 4096:
                    yield flush()
        leave(0)
        if ready:
            yield flush()

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(parts, "lang", "words").sortWithinPartitions("lang", "words")
    return ordered.select("lang", "words", "f").mapInArrow(read, "lang string, words array<string>, f long, parts array<long>, grown long")


def settled(walked: DataFrame, counts: DataFrame) -> dict[tuple, tuple[int, int]]:
    """(lang, words) to f and grown for the phrases before ranges: at most ``longest`` - 1 per range, so few for the driver."""
    before = walked.filter("f is null").groupBy("lang", "words").agg(F.max("grown").alias("grown"))
    found = before.join(counts, ["lang", "words"]).select("lang", "words", "f", "grown")
    return {(r["lang"], tuple(r["words"])): (r["f"], r["grown"]) for r in found.collect()}


def in_order(counts: DataFrame, name: str, backward: bool) -> tuple[DataFrame, dict]:
    """The walk in prefix or suffix order, written, and what its ranges lack."""
    stream = counts.withColumn("words", F.reverse("words")) if backward else counts
    out = written(walk(stream), name)
    return out.filter("f is not null"), settled(out, stream)


def collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, scale: int = 1000, drop_percent: int = 100, first: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The best phrases per language: lang, rank, phrase, a, l, r, n, score.

    Pieces of a text end at ``.,;:!?`` and line ends; words are what blanks part. A phrase of 2 to ``longest`` words that occurs
    a >= ``least`` times is cut where floor(scale * a * n / (l * r)) is least (the first such cut); n is the language's number
    of words, l and r count the parts. A phrase that lies in a longer one with ``drop_percent`` of its count goes. Of the rest
    the ``first`` per language stay, by score and count from the largest, then by phrase.

    Texts without a language are ``und``, null texts empty. Without such phrases there are no rows. Arithmetic is
    exact at any size. Columns other than the two are ignored.
    """
    lang = F.coalesce(F.col(lang_col), F.lit(NO_LANG))
    texts = docs.filter(F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).alias("text"))
    with Workspace() as work:
        frequent = frequent_phrases(texts, longest, least)
        totals = work.keep(written(frequent.filter("phrase is null").select("lang", F.col("f").alias("n")), "phrases-totals"))
        counts = written(frequent.filter("phrase is not null").select("lang", F.split("phrase", " ").alias("words"), "f"), "phrases-counts")
        (left, left_lacks), (right, right_lacks) = (in_order(counts, f"phrases-{'suffix' if back else 'prefix'}", back) for back in (False, True))
        right = right.select("lang", F.reverse("words").alias("words"), F.col("parts").alias("r_parts"), F.col("grown").alias("r_grown"))
        both = left.hint("merge").join(right, ["lang", "words"])
        merged = work.keep(written(both.filter("size(words) > 1"), "phrases-merged"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in tidy(batches):
            out = []
            for lang, words, a, lefts, l_grown, rights, r_grown, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, back = tuple(words), tuple(reversed(words))
                grown = max(l_grown, r_grown, left_lacks.get((lang, words), (0, 0))[1], right_lacks.get((lang, back), (0, 0))[1])
                if 100 * grown >= drop_percent * a:
                    continue
                best = None
                for k in range(1, len(words)):
                    m = len(words) - k
                    l = lefts[k - 1] if lefts[k - 1] is not None else left_lacks[lang, words[:k]][0]  # noqa: E741
                    r = rights[m - 1] if rights[m - 1] is not None else right_lacks[lang, back[:m]][0]
                    cut = scale * a * n // (l * r)
                    if best is None or cut < best[0]:
                        best = cut, l, r
                out.append((lang, " ".join(words), a, best[1], best[2], n, best[0]))
            if out:
                types = (pa.string(), pa.string(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["lang", "phrase", "a", "l", "r", "n", "score"])

    rows = merged.join(totals, "lang").select("lang", "words", "f", "parts", "grown", "r_parts", "r_grown", "n")
    scored = rows.mapInArrow(score, "lang string, phrase string, a long, l long, r long, n long, score long")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's rows are ranked in parts first, so that no task sorts them all.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*best)
    few = scored.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
