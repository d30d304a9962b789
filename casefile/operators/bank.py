"""Bank ledgers: aggregates, risk, gaps between payments, order repair, pages of a grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile import params
from casefile.functions.text import cents, half_up, whole_days
from casefile.operators.procurement import total


def dashboard(rows: DataFrame, debit: str = "debit", credit: str = "credit") -> DataFrame:
    """Counts and sums of all rows and of large debits."""
    return rows.agg(
        F.count(F.lit(1)).alias("transactions"), total(debit).alias("total_debit"), total(credit).alias("total_credit"),
        F.count_if(F.col(debit) >= params.HIGH_DEBIT_THRESHOLD).alias("high_debits"),
        F.count_if(F.col(credit) >= params.CASH_DEPOSIT_THRESHOLD).alias("large_credits"),
    )


def frequent_parties(rows: DataFrame, party: str, least: int, debit: str = "debit", credit: str = "credit") -> DataFrame:
    """Parties with at least ``least`` transactions."""
    out = rows.groupBy(party).agg(F.count(F.lit(1)).alias("n"), total(debit).alias("debit"), total(credit).alias("credit"))
    return out.filter(F.col("n") >= least)


def by_year(rows: DataFrame, date: str, debit: str = "debit", credit: str = "credit") -> DataFrame:
    rows = rows.filter(F.col(date).isNotNull())
    return rows.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"), total(debit).alias("debit"), total(credit).alias("credit"))


def payer_metrics(rows: DataFrame, debit: str = "debit", credit: str = "credit") -> DataFrame:
    """Total debit of all rows; sum, mean and number of credits."""
    paid = F.when(F.col(credit) > 0, F.col(credit))
    out = rows.agg(total(debit).alias("total_debit"), total(paid).alias("total_credit"), F.sum(cents(paid)).alias("_c"), F.count(paid).alias("credits"))
    mean = F.when(F.col("credits") > 0, half_up(F.col("_c"), F.col("credits"), 0) / 100)
    return out.withColumn("mean_credit", mean).drop("_c")


def rollup_accounts(rows: DataFrame, keys: Sequence[str], date: str, debit: str = "debit", credit: str = "credit") -> DataFrame:
    """Totals, number and period per key."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), total(debit).alias("debit"), total(credit).alias("credit"), day(F.min(date)).alias("first_day"), day(F.max(date)).alias("last_day"))


def running_balance(rows: DataFrame, account: str, order: Sequence[str], debit: str = "debit", credit: str = "credit") -> DataFrame:
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum((F.col(credit) - F.col(debit)).cast("decimal(18,2)")).over(w).cast("double"))


def latest(rows: DataFrame, account: str, value: str, order: Sequence[str]) -> DataFrame:
    """The value of the last row of each account, by an aggregate instead of a sort."""
    return rows.groupBy(account).agg(F.max_by(value, F.struct(*order)).alias(f"latest_{value}"))


def party_gaps(rows: DataFrame, party: str, date: str, order: Sequence[str], least: int = 2) -> DataFrame:
    """Days since a party's transaction before, 0 for its first; parties with fewer than ``least`` rows are left out."""
    w = Window.partitionBy(party).orderBy(date, *order)
    gap = F.coalesce(F.greatest(whole_days(F.col(date), F.lag(date).over(w)), F.lit(0)), F.lit(0))
    rows = rows.select(party, *order, gap.alias("gap_days"), F.count(F.lit(1)).over(Window.partitionBy(party)).alias("_n"))
    return rows.filter(F.col("_n") >= least).drop("_n")


def risk(rows: DataFrame, rules: Sequence[tuple[str, int]], narration: str = "narration", party: str = "party", debit: str = "debit", credit: str = "credit", cash: Column | None = None) -> DataFrame:
    """risk_score (at most 100), risk_level and reasons: large cash deposits, large debits, watched words."""
    is_cash = cash if cash is not None else F.lower(narration).contains("cash")
    tests = [
        (is_cash & (F.col(credit) >= params.CASH_DEPOSIT_THRESHOLD), 40, "large cash deposit"),
        (F.col(debit) >= params.HIGH_DEBIT_THRESHOLD, 35, "high value debit"),
    ]
    tests += [(F.lower(narration).contains(w.lower()) | F.lower(party).contains(w.lower()), weight, f"watched: {w}") for w, weight in rules]
    score = reduce(lambda a, t: a + F.when(t[0], t[1]).otherwise(0), tests, F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, _, name in tests])), "; ")
    rows = rows.withColumn("risk_score", F.least(F.lit(100), score))
    level = F.when(F.col("risk_score") >= params.HIGH_RISK, "High").when(F.col("risk_score") >= params.MEDIUM_RISK, "Medium").otherwise("Low")
    return rows.withColumn("risk_level", level).withColumn("reasons", reasons)


def repair_order(rows: DataFrame, account: str, seq: str, date: str, balance: str, debit: str = "debit", credit: str = "credit", tolerance: float = 0.05) -> DataFrame:
    """row_order of statements that may be listed newest first.

    Neighbours in listing order vote if both balances are above zero: forward if the second balance follows from the
    first, reverse if the first follows from the second. Reverse wins by majority; a tie goes by whether the first date of the
    account is after the last. Then the rows of each day vote among themselves, where a tie keeps the account's order. Rows
    are numbered by date, those without one first, then by the order so repaired.
    """
    limit = round(tolerance * 100)
    day = F.to_date(date)
    here, net = cents(F.col(balance)), cents(F.col(credit)) - cents(F.col(debit))

    def votes(w: Window, prefix: str) -> tuple[Column, Column]:
        then, step = F.lead(here).over(w), F.lead(net).over(w)
        both = (here > 0) & (then > 0)
        count = lambda test, name: F.coalesce((both & test).cast("int"), F.lit(0)).alias(f"{prefix}{name}")
        return count(F.abs(then - (here + step)) < limit, "f"), count(F.abs(here - (then + net)) < limit, "r")

    whole, within = Window.partitionBy(account).orderBy(seq), Window.partitionBy(account, day).orderBy(seq)
    voted = rows.select("*", day.alias("_day"), *votes(whole, "_a"), *votes(within, "_d"))
    known = F.when(F.col(date).isNotNull(), F.col(seq))
    per = voted.groupBy(F.col(account).alias("_acc")).agg(F.sum("_af").alias("_f"), F.sum("_ar").alias("_r"), F.min_by(date, known).alias("_first"), F.max_by(date, known).alias("_last"))
    turned = (F.col("_r") > F.col("_f")) | ((F.col("_r") == F.col("_f")) & F.coalesce(F.col("_first") > F.col("_last"), F.lit(False)))
    days = voted.groupBy(F.col(account).alias("_dacc"), F.col("_day").alias("_dday")).agg(F.sum("_df").alias("_sf"), F.sum("_dr").alias("_sr"))
    out = voted.join(per.select("_acc", turned.alias("_flip")), F.col(account) == F.col("_acc"))
    out = out.join(days, (F.col(account) == F.col("_dacc")) & F.col("_day").eqNullSafe(F.col("_dday")))
    back = F.when(F.col("_sr") > F.col("_sf"), True).when(F.col("_sf") > F.col("_sr"), False).otherwise(F.col("_flip"))
    key = F.when(back, -F.col(seq)).otherwise(F.col(seq))
    order = F.row_number().over(Window.partitionBy(account).orderBy(F.col("_day").asc_nulls_first(), key))
    return out.select(*rows.columns, order.alias("row_order"))


def page(rows: DataFrame, sort: str, ties: Sequence[str], number: int, size: int, descending: bool = True) -> DataFrame:
    """One page of a grid; sizes are kept within 1 to 500."""
    size = min(500, max(1, size))
    order = F.desc(sort) if descending else F.asc(sort)
    return rows.orderBy(order, *ties).offset((number - 1) * size).limit(size)
