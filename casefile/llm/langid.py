"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of labelled text. A text is parsed greedily against it: from where
the parse stands, the longest run of symbols that occurs in the labelled text is one phrase. A sample of n symbols gives
phrases of about log2(n) / entropy symbols, so phrases times log2(n) per symbol estimate the cross entropy in bits
whatever the sample's length is; the language with the fewest wins. Symbols are UTF-8 bytes with A-Z lower-cased and runs of other ASCII
characters that are no letters as one blank, so markup and digits weigh little and no text is too odd to parse.

An automaton with its restarts is one integer table, and a batch of texts steps through it in lanes of
``LANE`` bytes: a text longer than a lane goes on in further lanes, each of which starts a phrase of its own.
Only the labelled sample travels to the workers, which build the tables once per process; all tables of a worker
together take ``table_bytes`` at most, so samples are shorter where there are very many languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .held import held, tidy

#: Bytes of a lane, and lanes that step together.
LANE, LANES = 1024, 2048
#: Characters that a worker holds as symbols at a time, besides one text.
HELD = 1 << 20
BLANK = 32


def symbol_table() -> np.ndarray:
    """Byte to symbol: lower-case letters, bytes from 0x80 as they are, all else blank."""
    out = np.full(256, BLANK, np.uint8)
    for b in range(256):
        if b >= 0x80 or 97 <= b <= 122:
            out[b] = b
        elif 65 <= b <= 90:
            out[b] = b + 32
    return out


SYMBOL = symbol_table()


def symbols(data: bytes | np.ndarray) -> np.ndarray:
    """Symbols of UTF-8 bytes, runs of blanks as one."""
    s = SYMBOL[np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data]
    if not len(s):
        return s
    blank = s == BLANK
    return s[~(blank & np.concatenate([[False], blank[:-1]]))]


def suffix_automaton(seq: bytes) -> list[dict[int, int]]:
    """Transitions per state; state 0 is the start and every substring of ``seq`` is a path from it."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """The languages' automata as tables over one alphabet: entry = next state * 2 + (a phrase starts here)."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.languages = [name for name, _ in samples]
        self.weights = np.log2([max(2.0, len(s)) for _, s in samples])
        used = sorted(set(b"".join(s for _, s in samples)) | {BLANK})
        self.code = np.zeros(256, np.int32)  # 0: a symbol that no sample has
        for i, b in enumerate(used):
            self.code[b] = i + 1
        self.width = len(used) + 1
        self.tables = [self.table(suffix_automaton(s)) for _, s in samples]

    def table(self, nxt: list[dict[int, int]]) -> np.ndarray:
        # A symbol that not even the start state knows is a phrase by itself and leads back to the start.
        root = np.ones(self.width, np.int32)
        for b, to in nxt[0].items():
            root[self.code[b]] = to * 2 + 1
        out = np.tile(root, (len(nxt), 1))
        for state in range(1, len(nxt)):
            for b, to in nxt[state].items():
                out[state, self.code[b]] = to * 2
        return out.ravel()

    def phrases(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrases, and symbols of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = np.zeros((len(texts), len(self.tables)), np.int64)
        lanes = -(-sizes // LANE)
        if not lanes.sum():
            return counts, sizes
        codes = self.code[np.concatenate(texts)]
        owner = np.repeat(np.arange(len(texts)), lanes)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = (np.cumsum(sizes) - sizes)[owner] + number * LANE
        length = np.minimum(LANE, sizes[owner] - number * LANE)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            self.step(codes, owner[some], start[some], length[some], counts)
        return counts, sizes

    def step(self, codes: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, counts: np.ndarray) -> None:
        """Parse lanes, the longest first, and add their phrases to ``counts``."""
        grid = np.zeros((int(length[0]), len(owner)), np.int32)
        active = np.searchsorted(-length, -np.arange(len(grid)), side="left")  # lanes longer than i
        for i, m in enumerate(active):
            grid[i, :m] = codes[start[:m] + i]
        for j, table in enumerate(self.tables):
            state, found = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for i, m in enumerate(active):
                entry = table[state[:m] * self.width + grid[i, :m]]
                found[:m] += entry & 1
                state[:m] = entry >> 1
            counts[:, j] += np.bincount(owner, found, len(counts)).astype(np.int64)


def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    """One per worker process."""
    return held(("langid", samples), lambda: Parser(samples))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def labelled_samples(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample_bytes: int, rows: int, table_bytes: int) -> tuple[tuple[str, bytes], ...]:
    """Per language up to ``sample_bytes`` symbols from at most ``rows`` labelled rows with the least hashes.

    Texts become symbols and are cut before they travel, so the driver gets some times ``sample_bytes`` per language.
    """
    reduced = F.regexp_replace(F.col(text_col), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " ")
    labelled = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.substring(reduced, 1, sample_bytes).alias("text")
    )
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * rows) / F.col("n"))
    limits = sizes.select(F.col("lang").alias("l_lang"), F.when(share >= 0.999, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("long")).alias("limit"))
    picked = labelled.join(F.broadcast(limits), F.col("lang") == F.col("l_lang")).filter(F.col("h") <= F.col("limit"))  # one small row per language
    order = Window.partitionBy("lang").orderBy("h", F.length("text"), "text")
    picked = picked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows)
    before = F.coalesce(F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = picked.withColumn("before", before).filter(F.col("before") < sample_bytes).select("lang", "place", "text")
    texts: dict[str, bytes] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["place"])):
        texts[r["lang"]] = (texts.get(r["lang"], b"") + symbols(r["text"].encode()).tobytes() + b" ")[:sample_bytes]
    texts = {k: v for k, v in texts.items() if v.strip()}
    # An automaton has at most two states per symbol, a state an entry of four bytes per symbol of the alphabet.
    width = len(set(b"".join(texts.values()))) + 2
    most = table_bytes // (8 * width * max(1, len(texts)))
    return tuple(sorted((k, v[:most]) for k, v in texts.items() if v[:most].strip()))


def identify(
    docs: DataFrame, samples: tuple[tuple[str, bytes], ...], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``keep`` columns, lang_pred, score, bits_per_symbol for every row.

    lang_pred is ``und`` (score 0) for null texts, texts without a letter and where there are no samples; ties go to
    the language first by name. score: 1 - best / (best + second) bits, 0.5 for a tie to nearly 1; 1 with one
    language. Texts are read whole. Repeated rows give a row each, an empty table none; other columns are not read.
    """
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_symbol", T.DoubleType())])
    n_keep = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(samples) if samples else None
        for batch in tidy(batches):
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(n_keep)), 0).to_numpy(zero_copy_only=False)) // HELD
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [batch.num_rows]])
            for at, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at, end - at)
                texts = part.column(n_keep).to_pylist()
                letters = [t is not None and has_letter(t) for t in texts]
                lang, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                rows = [i for i, x in enumerate(letters) if x] if p else []
                if rows:
                    counts, symbols_of = p.phrases([symbols(texts[i].encode()) for i in rows])
                    bits = counts * p.weights
                    best = bits.argmin(1)
                    for i, c, b, size in zip(rows, bits, best, symbols_of, strict=True):
                        second = np.delete(c, b).min(initial=math.inf)
                        lang[i] = p.languages[b]
                        score[i] = 1.0 if second == math.inf else 1.0 - float(c[b] / (c[b] + second))
                        rate[i] = float(c[b] / size)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(n_keep)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], schema.names
                )

    return docs.select(*keep, text_col).mapInArrow(work, schema)


def learn_and_identify(
    docs: DataFrame,
    learn: Column,
    keep: tuple[str, ...] = ("doc_id",),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_bytes: int = 40_000,
    sample_rows: int = 400,
    table_bytes: int = 400 << 20,
) -> DataFrame:
    """``identify`` with samples from the rows where ``learn`` holds and the label is not null.

    The classifier is fitted on a bounded sample: per language at most ``sample_rows`` rows and ``sample_bytes`` symbols,
    fewer where the tables of all languages would take more than ``table_bytes``.
    """
    samples = labelled_samples(docs, learn, id_col, text_col, lang_col, sample_bytes, sample_rows, table_bytes)
    return identify(docs, samples, keep, text_col)
