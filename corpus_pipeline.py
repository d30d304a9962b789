"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1. language: texts without a language (no letters) go, every other document stays.
2. near_copies: n-gram Jaccard components (five words, similarity 0.8); the smallest doc_id of each stays.
3. passages: words that repeat an earlier passage of 20 words go; documents left without words go.
4. mixture: documents are taken to their sources' targets; one that is taken n times is there n times.
5. tokens: byte-level BPE ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casefile.llm import bpe, jaccard, langid, mixing, substrings
from casefile.llm.queries import fold_of, quality_weights, read
from casefile.llm.scratch import Workspace, delete, new_path
from casefile.llm.words import n_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language, learnt from the labelled rows outside the held-out fold."""
    known = langid.learn_and_identify(docs.select(COLUMNS), fold_of(F.col("doc_id")) != 0, keep=("doc_id", "text", "lang", "source", "n_chars"))
    return known.filter("lang_pred <> 'und'").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Texts that share an id are documents of their own; of those in one group the one with the least hash stays. Of rows
    that repeat id and text one stays, the first by language and source. Rows without a doc_id are in no group and stay.
    """
    docs = docs.select(COLUMNS)  # other columns may have any name
    rows = jaccard.join_components(docs, k=5, percent=80, detail=True).filter("doc_id is not null")
    first = rows.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    stays = first.unionByName(rows.filter("group is null").select("doc_id", "text_hash")).distinct()
    kept = docs.withColumn("text_hash", F.xxhash64("text")).join(stays, ["doc_id", "text_hash"], "left_semi")
    order = Window.partitionBy("doc_id", "text_hash").orderBy("lang", "source", "n_chars")
    kept = kept.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return kept.select(COLUMNS).unionByName(docs.filter("doc_id is null").select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat earlier ones; n_chars is of the text that stays."""
    out = substrings.remove_repeats(docs.select(COLUMNS), keep=("lang", "source"))
    return out.filter("n_words > n_removed").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows that repeat a doc_id are told apart by their text."""
    docs, text_hash = docs.select(COLUMNS), F.xxhash64("text")
    labelled = quality_weights(read(spark, sf_dir, "labels")).withColumnRenamed("doc_id", "q_id")
    slim = docs.select("doc_id", text_hash.alias("h"), "source", n_words(F.col("text")).alias("words"))
    slim = slim.withColumn("row_id", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h"))
    quality = slim.join(labelled, F.col("doc_id") == F.col("q_id")).select("row_id", "quality_weight").dropDuplicates(["row_id"])
    taken = mixing.mix(slim, F.col("words"), id_col="row_id", quality=quality).filter("repeats > 0")
    times = taken.groupBy("row_id").agg(F.max("repeats").alias("repeats"))
    rows = docs.withColumn("_row", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash))
    rows = rows.join(times, F.col("_row") == F.col("row_id"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, digests of every document."""
    import public_tokenizers

    return bpe.encode(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written to the shared folder and goes when the next is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with Workspace():  # what a stage works with goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs


#: Cross-parsing, near copies and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
