"""Screening of mail, chat, transcripts and files by keywords, patterns and fuzzy rules."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile import params
from casefile.functions import text as X
from casefile.operators.fuzzynames import lcs


def count_keywords(docs: DataFrame, id_col: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """id, keyword, hits for every keyword that a text holds; one pass over the texts, no join."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), X.keyword_count(F.col(text), k).alias("hits")) for k in keywords]))
    return docs.select(id_col, each.alias("k")).select(id_col, "k.keyword", "k.hits").filter("hits > 0")


def keyword_pages(pages: DataFrame, id_col: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """keyword, pages, hits and first page over all pages."""
    return count_keywords(pages, id_col, text, keywords).groupBy("keyword").agg(F.count(F.lit(1)).alias("pages"), F.sum("hits").alias("hits"), F.min(id_col).alias("first_page"))


def listed_hits(docs: DataFrame, id_col: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """id and the keywords it holds, upper-case, in their order."""
    return docs.select(id_col, F.array_join(X.keywords_hit(F.col(text), keywords), ",").alias("hits")).filter("hits <> ''")


def chat(rows: DataFrame, text: str, watchlist: Sequence[tuple[str, int]] = params.CHAT_WATCHLIST, extra: Sequence[str] = (), extra_weight: int = 50) -> DataFrame:
    """risk_score and flagged terms: weights of all terms hit, at least 50 if any is, at most 100."""
    terms = [*watchlist, *((t.strip().lower(), extra_weight) for t in extra if t.strip())]
    hits = [(X.word_hit(F.col(text), t), t, w) for t, w in terms]
    score = reduce(lambda a, h: a + F.when(h[0], h[2]).otherwise(0), hits, F.lit(0))
    flagged = F.array_compact(F.array(*[F.when(h, F.lit(t)) for h, t, _ in hits]))
    rows = rows.withColumn("flagged", F.array_join(F.when(F.col(text).isNotNull(), flagged), ",")).withColumn("_s", F.coalesce(score, F.lit(0)))
    rows = rows.withColumn("risk_score", F.when(F.col("_s") > 0, F.least(F.lit(100), F.greatest(F.lit(50), F.col("_s")))).otherwise(0))
    return rows.drop("_s").withColumn("flagged", F.coalesce("flagged", F.lit("")))


def participants(rows: DataFrame, channel: str, sender: str, seq: str, risk: str = "risk_score") -> DataFrame:
    """Per channel and sender: messages, flagged ones, first and last place, rank by first appearance."""
    out = rows.groupBy(channel, sender).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col(risk) >= 50).alias("flagged"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq")
    )
    return out.withColumn("seen_as", F.row_number().over(Window.partitionBy(channel).orderBy("first_seq", sender)))


def channels(rows: DataFrame, channel: str, sender: str, risk: str = "risk_score") -> DataFrame:
    """Per channel: messages, senders, flagged, highest risk, kind by the number of senders."""
    out = rows.groupBy(channel).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct(sender).alias("senders"), F.count_if(F.col(risk) >= 50).alias("flagged"), F.max(risk).alias("max_risk"))
    return out.withColumn("kind", F.when(F.col("senders") <= 2, "DM").otherwise("GROUP"))


def voice_intent(rows: DataFrame, text: str, intents=params.VOICE_INTENTS) -> DataFrame:
    """intent of the heaviest keyword (the first of equals), its weight, and the number of keywords hit."""
    flat = [(i, kw, w) for i, kws in intents for kw, w in kws]
    hits = F.array_compact(
        F.array(*[F.when(X.word_hit(F.col(text), kw), F.struct(F.lit(w).alias("w"), F.lit(-n).alias("p"), F.lit(i).alias("i"))) for n, (i, kw, w) in enumerate(flat)])
    )
    rows = rows.withColumn("_h", hits)
    best = F.array_max("_h")
    return rows.withColumn("intent", F.coalesce(best["i"], F.lit("General"))).withColumn("risk", F.coalesce(best["w"], F.lit(0))).withColumn("hits", F.size("_h")).drop("_h")


def addresses(rows: DataFrame, text: str) -> Column:
    """All mail addresses of a text, lower-case."""
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(X.ADDRESS), 0), F.lower)


def mail_checkpoints(rows: DataFrame, text: str, webmail: Sequence[str] = params.WEBMAIL_DOMAINS, own: Sequence[str] = (), upi: Sequence[str] = params.UPI_DOMAINS, bank: Sequence[str] = params.BANK_KEYWORDS, keywords: Sequence[str] = ()) -> DataFrame:
    """Booleans per text: currency, personal, external, bank, upi, keyword; addresses are those in the text."""
    low = F.lower(F.col(text))
    rows = rows.withColumn("_d", F.transform(addresses(rows, text), lambda a: F.substring_index(a, "@", -1)))
    some = lambda words: reduce(lambda a, w: a | low.contains(w), words, F.lit(False))
    listed = lambda domains: F.exists("_d", lambda d: d.isin(*domains)) if domains else F.lit(False)
    flags = {
        "is_currency": F.col(text).rlike(params.money_pattern()),
        "is_personal": listed(webmail),
        "is_external": F.exists("_d", lambda d: ~d.isin(*own)) if own else F.size("_d") > 0,
        "is_bank": some(bank),
        "is_upi": listed(upi) | some(("upi",)),
        "is_keyword": some([k.lower() for k in keywords]),
    }
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("_d")


def checkpoint_summary(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows each rule flags, and how many any of them does."""
    either = reduce(lambda a, f: a | F.col(f), flags, F.lit(False))
    return rows.agg(*(F.count_if(F.col(f)).alias(f) for f in flags), F.count_if(either).alias("flagged"))


def top_addresses(rows: DataFrame, text: str, n: int = 100) -> DataFrame:
    """The n addresses that occur most, ties by address."""
    out = rows.select(F.explode(addresses(rows, text)).alias("address")).groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "address").limit(n)


def scan(rows: DataFrame, id_col: str, path: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """The first place of each keyword in a file: keyword, match_type, snippet, risk. Names count before content."""
    low_path = F.lower(F.col(path))

    def hit(k: str) -> Column:
        in_name, in_text = low_path.contains(k.lower()), F.lower(F.col(text)).contains(k.lower())
        kind = F.when(in_name, "NAME").when(in_text, "CONTENT")
        return F.struct(F.lit(k).alias("keyword"), kind.alias("match_type"), F.when(~in_name, X.snippet(F.col(text), F.lit(k))).alias("snippet"))

    found = rows.select(id_col, path, F.explode(F.array(*[hit(k) for k in keywords])).alias("h")).select(id_col, path, "h.*").filter("match_type is not null")
    return found.withColumn("risk", scan_risk(F.col("keyword"), F.col(path), F.col("match_type")))


def scan_risk(keyword: Column, path: Column, match_type: Column) -> Column:
    """85, 65 or 45 by keyword, 10 more in exposed places (98 at most), 5 more for content (99 at most)."""
    kw, where = F.lower(keyword), F.lower(path)
    some = lambda c, words: reduce(lambda a, w: a | c.contains(w), words, F.lit(False))
    base = F.when(some(kw, params.SCAN_HIGH), 85).when(some(kw, params.SCAN_MEDIUM), 65).otherwise(45)
    placed = F.when(some(where, ("appdata", "desktop", "temp", ".env")), F.least(F.lit(98), base + 10)).otherwise(base)
    return F.when(match_type.contains("CONTENT"), F.least(F.lit(99), placed + 5)).otherwise(placed)


def top_keywords(hits: DataFrame, n: int = 10) -> DataFrame:
    return hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("files"), F.max("risk").alias("max_risk")).orderBy(F.desc("files"), "keyword").limit(n)


#: Tokens whose scores a task remembers.
KNOWN_TOKENS = 1 << 20


def fuzzy(rows: DataFrame, text: str, keywords: Sequence[str], least: float = 80.0) -> DataFrame:
    """``rows`` with fuzzy_score and fuzzy_keyword, those of ``least`` and more: 100 if the squashed text holds the squashed keyword, else the best token's ratio in whole percent.

    A task meets a token with the keywords once, by rows of bits, and remembers what came of it, so the work is in proportion to distinct
    tokens. Of equal scores the first keyword counts; a null text has none.
    """
    listed = [(k, re.sub("[^a-z0-9]", "", k.lower())) for k in keywords]

    def scores(token: str) -> list[int]:
        out = []
        for _, k in listed:
            both = len(token) + len(k)
            near = both > 0 and 200 * min(len(token), len(k)) >= least * both
            out.append(200 * lcs(token, k) // both if near else 0)
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            at, score, found = [], [], []
            for i, said in enumerate(batch.column(0).to_pylist()):
                if said is None:
                    continue
                tokens = re.findall("[a-z0-9]+", said.lower())
                body, best = "".join(tokens), [0] * len(listed)
                for token in set(tokens):
                    if token not in known:
                        if len(known) >= KNOWN_TOKENS:
                            known.clear()
                        known[token] = scores(token)
                    best = [max(a, b) for a, b in zip(best, known[token], strict=True)]
                best = [100 if k in body else b for (_, k), b in zip(listed, best, strict=True)]
                top = max(best, default=-1)
                if top >= least:
                    at.append(i)
                    score.append(top)
                    found.append(listed[best.index(top)][0])
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array(score, pa.int32()), pa.array(found, pa.string())], [*batch.schema.names[1:], "fuzzy_score", "fuzzy_keyword"])

    given = rows.select(F.col(text).alias("_said"), *rows.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("fuzzy_score", T.IntegerType()), T.StructField("fuzzy_keyword", T.StringType())])
    return given.mapInArrow(read, schema)


def segments(rows: DataFrame, id_col: str, text: str, order: Sequence[str] = ()) -> DataFrame:
    """Sentences of a transcript with cumulative times: a sentence lasts max(4, 0.45 seconds a word)."""
    parts = F.split(F.trim(F.col(text)), r"(?<=[.?!])\s+")
    out = rows.select(id_col, *order, F.posexplode(parts).alias("n", "sentence")).filter(F.trim("sentence") != "")
    words = F.size(F.split(F.trim("sentence"), r"\s+"))
    out = out.withColumn("_c", F.greatest(F.lit(400), words * 45))
    w = Window.partitionBy(id_col, *order).orderBy("n")
    end = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("ends", end / 100).withColumn("starts", (end - F.col("_c")) / 100).withColumn("seconds", F.col("_c") / 100)
    return out.drop("_c")


def rollup_custodians(rows: DataFrame, custodian: str, score: str, weight: str) -> DataFrame:
    """Per custodian (blank as Unassigned): items and the mean of whole scores by whole weights, 100 without weight."""
    who = F.coalesce(F.nullif(F.trim(F.col(custodian)), F.lit("")), F.lit("Unassigned"))
    out = rows.groupBy(who.alias("custodian")).agg(F.count(F.lit(1)).alias("items"), F.sum(weight).alias("_w"), F.sum(F.col(score) * F.col(weight)).alias("_s"))
    return out.select("custodian", "items", F.when(F.col("_w") > 0, X.half_up(F.col("_s"), F.col("_w"), 1)).otherwise(100.0).alias("mean_score"))


def authenticity(rows: DataFrame, created: str, modified: str, software: str, updates: str, as_of: Column, signatures=params.SOFTWARE_PENALTIES) -> DataFrame:
    """Score and level of a document's metadata: 100 less penalties; 80 and 50 are the limits of the levels."""
    c, m = (F.unix_timestamp(F.col(x).cast("timestamp")) for x in (created, modified))
    now, day = F.unix_timestamp(as_of), 86_400
    low = F.lower(F.coalesce(F.col(software), F.lit("")))
    penalty = F.when(c - m > 60, 35).otherwise(0)
    penalty = penalty + F.when((c > now + day) | (m > now + day), 30).otherwise(0)
    penalty = penalty + F.when(m - c > 180 * day, 15).otherwise(0)
    for name, points in signatures:
        penalty = penalty + F.when(low.contains(name), points).otherwise(0)
    penalty = penalty + F.least(F.lit(30), 15 * F.coalesce(F.col(updates), F.lit(0)))
    penalty = penalty + F.when(F.col(created).isNull() & F.col(modified).isNull(), 25).otherwise(0)
    score = F.greatest(F.lit(0), 100 - F.coalesce(penalty, F.lit(0))).cast("int")
    level = F.when(F.col("score") >= 80, "AUTHENTIC").when(F.col("score") >= 50, "SUSPICIOUS").otherwise("HIGH_RISK_TAMPERED")
    return rows.withColumn("score", score).withColumn("level", level)
