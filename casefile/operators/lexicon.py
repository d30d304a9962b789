"""Listed names as whole words in texts: one pass where the list is small, over their first words where it is not."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
#: Letters of all names together up to which tasks get the list.
MOST_LETTERS = 4_000_000
#: First words up to which they are one pattern.
FEW = 32


class Lexicon:
    """Names by their first word."""

    def __init__(self, names: Iterable[str]) -> None:
        self.first: dict[str, list[tuple[str, str]]] = {}
        for name in sorted(set(names)):
            if (m := WORD.match(name)) is not None:
                self.first.setdefault(m[0].lower(), []).append((name.lower(), name))
        few = len(self.first) <= FEW  # one pattern finds the places of a few words faster than a look at every word
        self.word = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, self.first))})(?!\w)", re.IGNORECASE) if few and self.first else WORD

    def hits(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, name) for every whole-word occurrence of a name, in any case."""
        first = self.first
        for m in self.word.finditer(text):
            for low, name in first.get(m[0].lower(), ()):
                end = m.start() + len(low)
                if text[m.start() : end].lower() == low and not (WORD.match(low, len(low) - 1) and WORD.match(text, end)):
                    yield m.start(), name


def small_list(names: DataFrame, column: str, most: int = MOST_LETTERS) -> list[str] | None:
    """The distinct names, where their letters are no more than ``most``."""
    distinct = names.select(column).filter(F.length(column) > 0).distinct()
    letters = distinct.agg(F.coalesce(F.sum(F.length(column) + 8), F.lit(0))).first()[0]
    return [r[0] for r in distinct.collect()] if letters <= most else None


def hits(rows: DataFrame, names: DataFrame, most: int = MOST_LETTERS) -> DataFrame:
    """(id, name, n, first): how often and where first each name of ``names`` (name) stands in a text of ``rows`` (id, text).

    Names begin with a word character (others are not found); null names and texts give nothing. A list of up to
    ``most`` letters goes to every task; texts that hold the first word of a name of a longer list are joined with it.
    """
    listed = small_list(names, "name", most)

    def count(text: str, lexicon: Lexicon) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for at, name in lexicon.hits(text):
            found.setdefault(name, [0, at])[0] += 1
        return found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Lexicon(listed) if listed is not None else None
        for batch in batches:
            at, out = [], []
            own = batch.column(2).to_pylist() if whole is None else None
            for i, text in enumerate(batch.column(1).to_pylist()):
                for name, (n, first) in count(text, whole or Lexicon(own[i])).items():
                    at.append(i)
                    out.append((name, n, first))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["id", "name", "n", "first"])

    texts = rows.select("id", "text").filter("text is not null")
    schema = T.StructType([rows.schema["id"], T.StructField("name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first", T.LongType())])
    if listed is not None:
        return texts.mapInArrow(read, schema)
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    by_word = names.select("name").distinct().withColumn("word", F.try_element_at(words(F.col("name")), F.lit(1))).filter("word is not null")
    # Texts meet the names of their words; a text goes on with those names alone, in parts of bounded size.
    keyed = texts.select("id", "text", F.xxhash64("text").alias("h"))
    seen = keyed.select("id", "h", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    may = seen.join(by_word, "word").withColumn("part", F.pmod(F.xxhash64("name"), F.lit(64))).groupBy(F.col("id").alias("m_id"), F.col("h").alias("m_h"), "part").agg(F.collect_set("name").alias("names"))
    both = keyed.join(may, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h"))).select("id", "text", "names")
    return both.mapInArrow(read, schema)
