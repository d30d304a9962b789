"""Tabular evidence: columns found by their aliases, amounts and dates read leniently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casefile.sources.lines import amount_of, first_time

# Spellings of statement headers.
STATEMENT_ALIASES: Mapping[str, Sequence[str]] = {
    "txn_date": ("date", "txn date", "transaction date", "tran date", "posting date"),
    "value_date": ("value date", "value dt"),
    "narration": ("narration", "description", "particulars", "remarks", "transaction remarks", "details"),
    "reference": ("transaction id", "reference", "ref no", "chq./ref.no.", "utr"),
    "debit": ("debit amount", "debit", "withdrawal amt.", "withdrawal", "dr"),
    "credit": ("credit amount", "credit", "deposit amt.", "deposit", "cr"),
    "balance": ("closing balance", "balance", "running balance"),
    "party": ("name", "party", "party name", "counterparty"),
}
DATE_FORMATS = ["dd/MM/yyyy", "dd/MM/yy", "yyyy/MM/dd", "dd/MMM/yyyy", "d/M/yyyy"]


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], partial: bool = True) -> DataFrame:
    """One string column per canonical name: by alias, else by an alias within a header, else null."""
    headers = {c.strip().lower(): c for c in reversed(df.columns)}
    taken: set[str] = set()
    picked = {}
    for exact in (True, False) if partial else (True,):
        for name, spellings in aliases.items():
            if name in picked:
                continue
            for s in spellings:
                found = next((c for h, c in headers.items() if c not in taken and (h == s if exact else len(s) > 3 and s in h)), None)
                if found:
                    picked[name] = found
                    taken.add(found)
                    break
    return df.select(*((F.col(f"`{picked[n]}`").cast("string") if n in picked else F.lit(None).cast("string")).alias(n) for n in aliases))


def normalise_statement(df: DataFrame) -> DataFrame:
    """A bank statement in canonical columns; dates that do not parse are null, amounts that do not are 0."""
    raw = resolve_columns(df, STATEMENT_ALIASES)
    day = lambda c: first_time(F.regexp_replace(F.substring_index(F.trim(c), " ", 1), "-", "/"), DATE_FORMATS)
    return raw.select(
        day("txn_date").alias("txn_date"), day("value_date").alias("value_date"), F.coalesce(F.trim("narration"), F.lit("")).alias("narration"), F.trim("reference").alias("reference"),
        amount_of(F.col("debit")).alias("debit"), amount_of(F.col("credit")).alias("credit"), amount_of(F.col("balance")).alias("balance"), F.trim("party").alias("party"),
    )


def read_statement_csv(spark: SparkSession, path: str) -> DataFrame:
    return normalise_statement(spark.read.csv(path, header=True, inferSchema=False))


# Match types from the most to the least specific.
MATCH_TYPES = ("NAME", "PDF", "DOCX", "XLSX", "PPTX", "ZIP_OFFICE", "ZIP", "TEXT")
SCAN_COLUMNS = ("found_at", "path", "keyword", "match_type", "size", "modified", "snippet")


def read_scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan hits from a CSV of seven columns by position; rows with fewer than three fields go."""
    schema = ", ".join(f"{c} string" for c in SCAN_COLUMNS)
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True).filter("path is not null and keyword is not null")
    kind = F.lit("TEXT_CONTENT")
    for m in reversed(MATCH_TYPES):
        kind = F.when(F.upper("match_type").contains(m), f"{m}_CONTENT" if m != "NAME" else "NAME").otherwise(kind)
    stamp = lambda c: F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"\s*UTC$", "")), first_time(F.regexp_replace(c, r"\s*UTC$", ""), ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm", "yyyy-MM-dd"]))
    size = F.regexp_extract("size", r"^\s*([\d.]+)", 1).try_cast("double").cast("long")
    return rows.select(stamp("found_at").alias("found_at"), F.trim(F.substring_index("path", " -> ", 1)).alias("path"), F.trim("keyword").alias("keyword"), kind.alias("match_type"), F.coalesce(size, F.lit(0)).alias("size"), stamp("modified").alias("modified"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def keyword_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, keyword) of a keyword file: comments and repeats go, the first spelling stays."""
    raw = spark.read.text(path).select(F.trim("value").alias("k"), F.monotonically_increasing_id().alias("pos"))
    raw = raw.filter((F.col("k") != "") & ~F.col("k").rlike(r"^(#|//)")).select("pos", F.regexp_replace("k", '^"|"$', "").alias("keyword"))
    first = raw.groupBy(F.lower("keyword").alias("_k")).agg(F.min(F.struct("pos", "keyword")).alias("f"))
    return first.select(F.row_number().over(Window.orderBy("f.pos")).alias("pos"), "f.keyword")


def write_hits_csv(hits: DataFrame, path: str) -> None:
    """Hits as CSV with a header."""
    hits.write.mode("overwrite").option("header", True).csv(path)
