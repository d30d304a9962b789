"""Procurement exports: orders and receipts of several files as one table, and the masters that go with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.session import dealt, shares

# Headers as exports spell them and the columns that analyses use.
RENAMED = {"Supplier": "Vendor", "G/L Acct": "G/L acct"}
DATES, NUMBERS = ("PO Date", "Pstng Date"), ("PO Qty", "GR Qty", "Net price", "Amount LC")
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy")


def may_fit(text: Column, form: str) -> Column:
    """Whether a text has the signs of a format, and a time only if that has; a format that is tried in vain takes many times as long."""
    signs = [F.contains(text, F.lit(s)) for s in "-./:" if s in form] + ([] if ":" in form else [~F.contains(text, F.lit(":"))])
    return reduce(lambda a, b: a & b, signs)


def orders_and_receipts(frames: Sequence[DataFrame], keep: Sequence[str], gl_master: DataFrame | None = None, renamed: Mapping[str, str] = RENAMED) -> DataFrame:
    """Exports with string columns as one typed table of the columns ``keep``.

    Columns are joined by name, those that a file lacks are null; a supplier's column is the vendor's. G/L accounts that
    are missing are 0000, materials <NA>. Repeated rows count once. Dates and numbers that do not parse are null; rows without a posting date
    go. ``PO Rem`` is what of an order has not been received. gl_master: code, text; accounts it lacks are Not Applicable.
    """
    named = [df.withColumnsRenamed({a: b for a, b in renamed.items() if a in df.columns and b not in df.columns}) for df in frames]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    given = [f"`{c}`" for c in rows.columns]
    for c in (*DATES, *NUMBERS, "G/L acct", "Material"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    filled = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    rows = rows.withColumns({"G/L acct": filled("`G/L acct`", "0000"), "Material": filled("Material", "<NA>")})
    # By the columns that files have: with those that are null throughout, Spark would deal the rows once more.
    rows = dealt(rows, shares(rows), *given).dropDuplicates()
    when = lambda c: F.coalesce(*[F.when(may_fit(F.col(f"`{c}`"), f), F.try_to_timestamp(F.col(f"`{c}`"), F.lit(f))) for f in FORMATS]).cast("date")
    number = lambda c: F.regexp_replace(F.col(f"`{c}`"), "[, ]", "").try_cast("double")
    rows = rows.withColumns({**{c: when(c) for c in DATES}, **{c: number(c) for c in NUMBERS}}).filter("`Pstng Date` is not null")
    rows = rows.withColumn("G/L acct", F.coalesce(F.col("`G/L acct`").try_cast("double").cast("long"), F.lit(0).cast("long")))
    rows = rows.withColumn("PO Rem", F.coalesce(F.col("`PO Qty`"), F.lit(0.0)) - F.coalesce(F.col("`GR Qty`"), F.lit(0.0)))
    if gl_master is not None:
        names = gl_master.select(F.col("code").try_cast("long").alias("_code"), F.col("text").alias("_text")).dropDuplicates(["_code"])
        rows = rows.join(names, F.col("`G/L acct`") == F.col("_code"), "left").withColumn("G/L Text", F.coalesce("_text", F.lit("Not Applicable")))
    return rows.select(*(F.col(f"`{c}`") for c in keep))


def material_types(files: Sequence[DataFrame], header_words: Sequence[str] = ("material", "type")) -> DataFrame:
    """(material, type) of masters given as numbered rows (row, cells): the header is the fourth row if it names both columns, else the first that does."""
    parts = []
    for rows in files:
        low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
        has = reduce(lambda a, w: a & F.exists(low, lambda c: F.contains(c, F.lit(w))), header_words, F.lit(True))  # noqa: B023
        heads = rows.filter(has).select(F.when(F.col("row") == 4, 0).otherwise(F.col("row")).alias("rank"), "row", low.alias("names"))
        head = heads.groupBy().agg(F.min_by(F.struct(F.col("row").alias("at"), "names"), "rank").alias("h"))
        place = lambda word: F.array_position(F.transform("h.names", lambda c: F.contains(c, F.lit(word))), True).cast("int")
        body = rows.crossJoin(F.broadcast(head)).filter(F.col("row") > F.col("h.at"))  # one row: the header
        value = lambda word: F.nullif(F.trim(F.try_element_at("cells", place(word))), F.lit(""))
        parts.append(body.select(value(header_words[0]).alias("material"), value(header_words[1]).alias("type")).filter("material is not null"))
    return reduce(DataFrame.unionByName, parts).distinct()


def master(spark: SparkSession, sources: Sequence[DataFrame | None], schema: str = "code string, text string") -> DataFrame:
    """The first master that there is and that has rows; an empty one if there is none."""
    for df in sources:
        if df is not None and not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)


def write_report(rows: DataFrame, path: str, columns: Mapping[str, str], order: Sequence[str] = ()) -> None:
    """A report as CSV with a header: columns by their titles, in order, for the ledger and the frequent counterparties."""
    out = rows.orderBy(*order) if order else rows
    out.select(*(F.col(c).alias(title) for c, title in columns.items())).write.mode("overwrite").option("header", True).csv(path)
