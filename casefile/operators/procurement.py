"""Purchasing checkpoints over receipt rows. Columns are parameters; dates come in as arguments, never from a clock."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.functions.text import cents, half_up, money, token_bag, whole_days


def total(c: str | Column) -> Column:
    """An exact sum of amounts, as a double."""
    return F.sum(money(F.col(c) if isinstance(c, str) else c)).cast("double")


def late_receipts(rows: DataFrame, ordered: str, posted: str, keep: Sequence[str], days: int = 365) -> DataFrame:
    """Distinct rows posted more than ``days`` after their order, with the days between."""
    gap = whole_days(F.col(posted), F.col(ordered))
    return rows.select(*keep, gap.alias("days_late")).filter(F.col("days_late") > days).distinct()


def receipt_gaps(rows: DataFrame, keys: Sequence[str], posted: str, order: Sequence[str], keep: Sequence[str], days: int = 365) -> DataFrame:
    """Receipts of a key that follow the one before by more than ``days``, and those before, tagged."""
    w = Window.partitionBy(*keys).orderBy(posted, *order)
    since = whole_days(F.col(posted), F.lag(posted).over(w))
    until = whole_days(F.lead(posted).over(w), F.col(posted))
    rows = rows.select(*keep, since.alias("gap_before"), until.alias("gap_after"))
    late, early = F.coalesce(F.col("gap_before") > days, F.lit(False)), F.coalesce(F.col("gap_after") > days, F.lit(False))
    tag = F.when(late & early, "both").when(late, "after_gap").otherwise("before_gap")
    return rows.filter(late | early).select(*keep, tag.alias("tag"))


def open_orders(rows: DataFrame, keys: Sequence[str], ordered: str, ordered_qty: str, received_qty: str, as_of: Column, days: int = 750) -> DataFrame:
    """Orders still to receive something after ``days``: remaining quantity and age at ``as_of``."""
    out = rows.groupBy(*keys).agg(F.max(ordered_qty).alias("po_qty"), F.sum(received_qty).alias("gr_qty"), F.min(ordered).alias("first_order"))
    out = out.withColumn("remaining", F.col("po_qty") - F.col("gr_qty")).withColumn("age_days", whole_days(as_of, F.col("first_order")))
    return out.filter((F.col("remaining") > 0) & (F.col("age_days") > days)).drop("first_order")


def stagnant_prices(rows: DataFrame, keys: Sequence[str], ordered: str, days: int = 730, types: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Groups of vendor, material and price whose orders span more than ``days``."""
    if types:
        rows = rows.filter(F.col(types[0]).isin(*types[1]))
    out = rows.groupBy(*keys).agg(F.min(ordered).alias("lo"), F.max(ordered).alias("hi"), F.count(F.lit(1)).alias("orders"))
    return out.withColumn("span_days", whole_days(F.col("hi"), F.col("lo"))).filter(F.col("span_days") > days).drop("lo", "hi")


def same_bags(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Materials whose descriptions hold the same tokens as another's: key, bag, number of members."""
    rows = rows.select(key, F.array_join(token_bag(F.col(text)), " ").alias("bag"))
    counted = rows.groupBy("bag").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(counted, "bag").select(key, "bag", "members")


def kpis(rows: DataFrame, amount: str, distinct: dict[str, str]) -> DataFrame:
    """The total and the numbers of distinct values, nulls not counted."""
    return rows.agg(total(amount).alias("total_amount"), *(F.count_distinct(F.col(c)).alias(name) for name, c in distinct.items()))


def top_by_amount(rows: DataFrame, key: str, amount: str, n: int = 5) -> DataFrame:
    """The n keys with the largest totals, ties by key."""
    return rows.groupBy(key).agg(total(amount).alias("amount")).orderBy(F.desc("amount"), key).limit(n)


def year_pivot(rows: DataFrame, key: str, date: str, amount: str, years: Sequence[int], n: int = 10) -> DataFrame:
    """key, year, amount of the n keys with the largest totals; years without rows are 0."""
    wide = rows.groupBy(key).agg(total(amount).alias("_all"), *(total(F.when(F.year(date) == y, F.col(amount))).alias(str(y)) for y in years))
    wide = wide.orderBy(F.desc("_all"), key).limit(n).fillna(0.0)
    return wide.unpivot([key], [str(y) for y in years], "year", "amount")


def crosstab(rows: DataFrame, left: str, right: str, amount: str, values: Sequence[str], n: int = 8) -> DataFrame:
    """left, right, amount with empty cells as 0, for the first n left keys in key order."""
    wide = rows.groupBy(left).pivot(right, list(values)).agg(total(amount)).orderBy(left).limit(n).fillna(0.0)
    return wide.unpivot([left], list(values), right, "amount")


def lakh_totals(rows: DataFrame, key: str, amount: str, n: int = 12) -> DataFrame:
    """Totals in lakhs, rounded to two places, the n largest."""
    out = rows.groupBy(key).agg(total(amount).alias("_t"))
    return out.orderBy(F.desc("_t"), key).limit(n).select(key, half_up(cents(F.col("_t")), 10_000_000, 2).alias("lakhs"))


def upsert_vendors(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], flag: str) -> DataFrame:
    """New values replace old ones unless they are blank; the flag of a known vendor stays."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    picked = [F.coalesce(F.nullif(F.trim(F.col(f"n.{c}")), F.lit("")), F.col(f"o.{c}")).alias(c) for c in columns]
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *picked, F.coalesce(f"o.{flag}", F.lit(False)).alias(flag))


def typed_on_accounts(rows: DataFrame, type_col: str, types: Sequence[str], account: str, accounts: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Distinct rows of some material types that are booked on some accounts."""
    return rows.filter(F.col(type_col).isin(*types) & F.col(account).isin(*accounts)).select(*keep).distinct()


def match_three_ways(rows: DataFrame, keep: Sequence[str], ordered_qty: str, received_qty: str, price: str, invoiced: str, tolerance: float = 0.05) -> DataFrame:
    """Rows whose invoice is off the received quantity at the order's price by more than ``tolerance`` of it."""
    due = money(F.col(received_qty)) * money(F.col(price))
    off = money(F.col(invoiced)) - due
    return rows.filter(F.abs(off) > F.lit(tolerance).cast("decimal(6,4)") * due).select(*keep, due.cast("double").alias("due"), off.cast("double").alias("variance"))


def vendor_slice(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows where any of the columns named has the value given; values of None ask for nothing, none at all gives all rows."""
    asked = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.filter(reduce(lambda a, t: a | F.coalesce(t, F.lit(False)), asked, F.lit(False))) if asked else rows


def with_remainders(rows: DataFrame, ordered: str = "po_qty", received: str = "gr_qty", code: str = "vendor", name: str = "vendor_name") -> DataFrame:
    """Rows with po_rem (ordered and not received; missing amounts are 0) and vendor_label (code - name; what is missing is none, Not Applicable)."""
    zero = F.lit(0)
    label = F.concat_ws(" - ", F.coalesce(F.col(code).cast("string"), F.lit("none")), F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Not Applicable")))
    return rows.withColumns({"po_rem": F.coalesce(ordered, zero) - F.coalesce(received, zero), "vendor_label": label})


def stagnant_rows(rows: DataFrame, keys: Sequence[str], date: str, days: int = 730, **rest: object) -> DataFrame:
    """The rows of the groups that ``stagnant_prices`` finds."""
    groups = stagnant_prices(rows, keys, date, days, **rest).select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), keys[1:], F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}")))
    return rows.join(groups, same, "left_semi")
