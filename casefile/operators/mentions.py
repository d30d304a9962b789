"""Names across many rows: calls, chats, scanned files and case documents, each with the people who are known without a text.

Every row's text is scanned by itself; what the rows of one conversation or custodian name is counted before it is
exchanged and merged by Spark, so a conversation may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile import params
from casefile.functions.text import slug
from casefile.operators.entities import clean, is_name, scan
from casefile.session import spread

FILE_END = r"(?i)\.(?:" + "|".join(params.LISTED_FILE_ENDS) + ")$"
FOUND = (("line", "long", pa.int64()), ("nth", "int", pa.int32()), ("name", "string", pa.string()), ("category", "string", pa.string()), ("role", "string", pa.string()), ("confidence", "double", pa.float64()))


def found_in(rows: DataFrame) -> DataFrame:
    """(id, line, nth, name, category, role, confidence): the candidates of (id, line, text), cleaned, in their order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], [[] for _ in FOUND]
            for i, (line, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for nth, found in enumerate(scan(text or "")):
                    at.append(i)
                    for values, value in zip(columns, (line, nth, *found), strict=True):
                        values.append(value)
            arrays = [pa.array(v, kind) for v, (_, _, kind) in zip(columns, FOUND, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], ["id", *(n for n, _, _ in FOUND)])

    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T._parse_datatype_string(kind)) for n, kind, _ in FOUND)])
    return rows.select("id", F.col("line").cast("long"), "text").mapInArrow(read, schema)


def found_once(rows: DataFrame) -> DataFrame:
    """``found_in`` with n, the number of an id's rows that say so: a text that an id repeats is scanned once, for its first line."""
    texts = rows.groupBy("id", "text").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    # The number of a text's rows travels with its id.
    found = found_in(texts.select(F.struct("id", "n").alias("id"), "line", "text"))
    return found.select("id.*", *(n for n, _, _ in FOUND))


def cleaned(raw: Column) -> Column:
    """A cleaned name, or null where it is none."""
    return F.udf(lambda x: name if x is not None and is_name(name := clean(x)) else None, T.StringType())(raw)


def file_words(name: Column) -> Column:
    """A file's name as words, without its ending."""
    return F.translate(F.regexp_replace(name, FILE_END, ""), "_-", "  ")


def one_each(found: DataFrame, by_best: bool = True) -> DataFrame:
    """(id, key, name, pos, category, role, confidence, mentions): candidates that agree but for case are one.

    The category is that of the most confident, the first of equals; without ``by_best`` that of the first.
    """
    pos = F.struct("line", "nth")
    best = F.struct((-F.col("confidence")).alias("c"), pos.alias("p")) if by_best else F.struct(F.lit(0.0).alias("c"), pos.alias("p"))
    about = F.min_by(F.struct("category", "role"), best)
    return found.groupBy("id", F.lower("name").alias("key")).agg(
        F.min_by("name", pos).alias("name"), F.min(pos).alias("pos"), about.alias("about"), F.max("confidence").alias("confidence"), F.sum("n").cast("long").alias("mentions")
    ).select("id", "key", "name", "pos", "about.*", "confidence", "mentions")


def singles_joined(one: DataFrame) -> DataFrame:
    """Single words given to the first longer name of their id that holds them as a word.

    A name goes to its own key and to each word that it holds, so names are scanned and exchanged once.
    """
    words = F.filter(F.split(F.translate("key", ".", " "), r"\s+"), lambda w: (w != "") & (w != F.col("key")))
    own = F.struct(F.col("key").alias("word"), F.struct("name", "category", "role", "confidence", "mentions").alias("e"))
    held = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.lit(None).alias("e")))
    met = one.select("id", "key", "pos", F.explode(F.concat(F.array(own), held)).alias("x")).select("id", "key", "pos", "x.*")
    found = met.groupBy("id", F.col("word").alias("key")).agg(F.max("e").alias("e"), F.min_by("key", F.when(F.col("e").isNull(), F.col("pos"))).alias("into")).filter("e is not null")
    into = F.when(~F.col("key").contains(" "), F.col("into"))
    target = F.coalesce(into, "key")
    whole = F.min_by(F.struct("e.name", "e.category", "e.role", "e.confidence"), F.when(into.isNull(), 0).otherwise(1))
    return found.groupBy("id", target.alias("key")).agg(whole.alias("e"), F.sum("e.mentions").alias("mentions")).select("id", "key", "e.*", "mentions")


def ranked(rows: DataFrame, id_col: str, keywords: DataFrame | None) -> DataFrame:
    """The columns of ``names_of``; place orders an id's names by mentions, confidence and name."""
    order = Window.partitionBy("id").orderBy(F.desc("mentions"), F.desc("confidence"), "name")
    rows, known = rows.withColumn("place", F.row_number().over(order)), F.lit(False)
    if keywords is not None:
        marks = keywords.select(F.lower(F.trim("name")).alias("k")).distinct().withColumn("hit", F.lit(True))
        rows, known = rows.join(marks, F.lower("name") == F.col("k"), "left"), F.coalesce("hit", F.lit(False))
    return rows.select(F.col("id").alias(id_col), "place", "name", "slug", "category", "role", "confidence", "mentions", "risk_score", "risk_level", known.alias("known"))


def with_risk(rows: DataFrame, raised: tuple[str, ...] = params.RAISED, high: tuple[str, ...] = params.RAISED_HIGH, prefix: str = "ent_") -> DataFrame:
    score, level = F.when(F.col("category").isin(*raised), 85).otherwise(70), F.when(F.col("category").isin(*high), "HIGH").otherwise("MEDIUM")
    return rows.withColumns({"slug": F.concat(F.lit(prefix), slug(F.col("key"))), "risk_score": score, "risk_level": level})


def talk(messages: DataFrame, id_col: str, sender: str, text: str, line: str) -> DataFrame:
    """Names that are said in the lines ``sender: text`` of each id."""
    said = F.concat(F.coalesce(F.col(sender), F.lit("")), F.lit(": "), F.col(text))
    return with_risk(singles_joined(one_each(found_once(messages.filter(F.length(text) > 0).select(F.col(id_col).alias("id"), F.col(line).alias("line"), said.alias("text"))))))


def with_people(named: DataFrame, people: DataFrame, about: tuple[str, str, int, str]) -> DataFrame:
    """``named`` and those of ``people`` (id, name, mentions) that it does not name."""
    category, role, score, prefix = about
    named = named.drop("key")
    new = people.filter("name is not null").groupBy("id", F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.sum("mentions").alias("mentions"))
    new = new.join(named.select(F.col("id").alias("n_id"), F.lower("name").alias("n_key")), F.col("id").eqNullSafe(F.col("n_id")) & (F.col("key") == F.col("n_key")), "left_anti")
    new = new.withColumns({"category": F.lit(category), "role": F.lit(role), "confidence": F.lit(params.PERSON_CONFIDENCE), "risk_score": F.lit(score), "risk_level": F.lit("HIGH"), "slug": F.concat(F.lit(prefix), slug(F.col("key")))})
    return named.unionByName(new.drop("key"))


def names_in_calls(segments: DataFrame, id_col: str, speaker: str, text: str, line: str, keywords: DataFrame | None = None) -> DataFrame:
    """Names of each recording: what its segments say, and its speakers (0.95) who have a name; the columns of ``entities.names_of``.

    A speaker's name is what stands in brackets, else the label; "Speaker 1" is none. Empty segments say nothing, but
    their speakers count. Candidates are merged in the order of ``line``.
    """
    label = F.trim(speaker)
    inner = F.when(label.rlike(params.SPEAKER_BRACKETS), F.regexp_extract(label, params.SPEAKER_BRACKETS, 1)).otherwise(label)
    people = segments.filter(F.length(label) > 0).select(F.col(id_col).alias("id"), inner.alias("label")).distinct()
    people = people.select("id", cleaned(F.col("label")).alias("name")).filter(~F.col("name").rlike(params.NO_SPEAKER))
    people = people.groupBy("id", F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("id", "name", F.lit(1).alias("mentions"))
    return ranked(with_people(talk(segments, id_col, speaker, text, line), people, params.SPEAKER), id_col, keywords)


def names_in_chats(messages: DataFrame, id_col: str, sender: str, text: str, line: str, custodian: Column | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Names of each chat: what its messages say, and its senders (0.95) with their number of messages, but for the custodian."""
    own = F.lower(F.trim(custodian)) if custodian is not None else F.lit(None).cast("string")
    people = messages.select(F.col(id_col).alias("id"), F.col(sender).alias("sender"), own.alias("own")).groupBy("id", "sender", "own").agg(F.count(F.lit(1)).alias("mentions"))
    people = people.select("id", cleaned(F.col("sender")).alias("name"), "mentions", "own").filter("own is null or lower(name) <> own")
    return ranked(with_people(talk(messages, id_col, sender, text, line), people.drop("own"), params.CHAT_PARTNER), id_col, keywords)


def names_in_hits(hits: DataFrame, id_col: str, file: str, snippet: str, author: str, line: str, keywords: DataFrame | None = None) -> DataFrame:
    """Names of each custodian's scanned files: in the words of file names, in snippets and of authors who have a name."""
    texts = F.array(file_words(F.col(file)), F.col(snippet), F.col(author))
    each = spread(hits.select(id_col, file, snippet, author, line)).select(F.col(id_col).alias("id"), F.col(line).alias("at"), F.posexplode(texts).alias("i", "text")).filter(F.length("text") > 0)
    # Files and authors come again with every hit; authors are judged once each.
    each = each.groupBy("id", "i", "text").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    of = F.when(F.col("i") < 2, F.col("text")).when(cleaned(F.when(F.col("i") == 2, F.col("text"))).isNotNull(), F.concat(F.lit("Author: "), F.col("text")))
    each = each.select(F.struct("id", "n").alias("id"), (F.col("at") * 3 + F.col("i")).alias("line"), of.alias("text")).filter("text is not null")
    found = found_in(each).select("id.*", *(n for n, _, _ in FOUND))
    return ranked(with_risk(singles_joined(one_each(found))), id_col, keywords)


def names_in_documents(documents: DataFrame, id_col: str, file: str, found: str, author: str, company: str, line: str, keywords: DataFrame | None = None) -> DataFrame:
    """Names of each case's documents: those found before (an array of name, category, role, mentions, confidence), authors, companies, and those in the words of file names.

    Names that agree but for case are one, of the first one's category and the largest confidence.
    """
    base = documents.select(F.col(id_col).alias("id"), F.col(line).alias("line"), file, found, author, company)
    before = base.select("id", "line", F.posexplode(found).alias("nth", "f")).select("id", "line", "nth", cleaned(F.col("f.name")).alias("name"), "f.category", "f.role", "f.confidence", F.col("f.mentions").alias("n"))

    def one(column: str, nth: int, about: tuple[str, str, float]) -> DataFrame:
        category, role, sure = about
        return base.select("id", "line", F.lit(nth).alias("nth"), cleaned(F.col(column)).alias("name"), F.lit(category).alias("category"), F.lit(role).alias("role"), F.lit(sure).alias("confidence"), F.lit(1).alias("n"))

    named = found_in(spread(base.select("id", "line", file_words(F.col(file)).alias("text"))))
    # Within a file's name single words join longer ones before they are counted with the rest.
    of_file = singles_joined(one_each(named.select(F.struct("id", "line").alias("id"), "line", "nth", "name", "category", "role", "confidence", F.lit(1).alias("n"))))
    of_file = of_file.select("id.*", (F.lit(1 << 24) + F.row_number().over(Window.partitionBy("id").orderBy(F.desc("mentions"), F.desc("confidence"), "name"))).alias("nth"), "name", "category", "role", "confidence", F.col("mentions").alias("n"))
    rows = before.unionByName(one(author, (1 << 24) - 1, params.AUTHOR)).unionByName(one(company, 1 << 24, params.COMPANY)).unionByName(of_file).filter("name is not null")
    return ranked(with_risk(one_each(rows, by_best=False), params.RAISED_DOCUMENT, params.RAISED_DOCUMENT, "ent_ver_"), id_col, keywords)
