"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget: its share by weight of the whole, at most ``max_repeats`` times its own size,
the excess going to the other sources by weight (water filling, in closed form). A budget is met by complete
epochs over the source first; the rest is a weighted sample without replacement: each document draws an
exponential key -ln(u)/w with u from a hash of its id and w its quality weight, and documents are taken in key
order while their running size fits the rest. Documents that fit what is then missing go on in key order, in at most as
many rounds as the longest document's size has binary digits; one more, the best fit, closes the gap. The running sum never needs a source in one task: keys are
binned, bins are summed with partial aggregation, whole bins are taken or left, and only the one bin per
source in which the budget ends is sorted. That is done in ranges of its order, each a task, whose sums are added up
first, so a bin may hold any number of rows, of one key too. Only the table of sources, a row each, is ordered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Workspace, written

#: Bins of the key range within a source.
BINS = 4096
#: Documents, of all sources together, that are gone through one by one.
SMALL = 1 << 20


def unit(id_text: Column, seed: str) -> Column:
    """A uniform number in (0, 1) from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), id_text)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target.

    Sources take ``weights`` in turn by code point order, null last. Ties in cap per weight follow that order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    per = per.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    zero = F.lit(0.0)
    # The water level if exactly the sources before this one stop at their caps; the true level is the largest.
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), zero)
    )
    per = per.withColumn("level", level)
    per = per.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.max("level").over(all_rows)))
    return per.select("source", "source_size", "target")


def taken_in_order(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows (source, size, key, bin, id, row) with ``picked``: in key order while the running size fits the source's ``rest``.

    budgets: one row per source: source, rest.
    """
    binned = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("bin_before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    bins_of = binned.alias("b").join(budgets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("b_source"), F.col("b.bin").alias("b_bin"), "bin_before", *(F.col(f"t.{c}") for c in budgets.columns if c != "source"),
        F.when(F.col("bin_before") + F.col("bin_size") <= F.col("rest"), "all").when(F.col("bin_before") >= F.col("rest"), "none").otherwise("part").alias("fit"),
    )
    out = rows.join(bins_of, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    out = written(out.drop("b_source", "b_bin"), "mix-bins")
    order = ("key", F.col("id").asc_nulls_first(), "size", "row")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = out.filter(F.col("fit") == "part").repartitionByRange(tasks, "source", "bin", *order)
    part = written(part.withColumn("range", F.spark_partition_id()), "mix-ranges")
    sums = part.groupBy("source", "bin", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source", "bin").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("r_source"), F.col("bin").alias("r_bin"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_before"))
    part = part.join(sums, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("bin") == F.col("r_bin")) & (F.col("range") == F.col("r_range")))
    inside = Window.partitionBy("source", "bin", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("picked", F.col("bin_before") + F.col("range_before") + F.sum("size").over(inside) <= F.col("rest"))
    part = part.select(*out.columns, "picked")
    whole = out.filter(F.col("fit") != "part").withColumn("picked", F.col("fit") == "all")
    return written(whole.unionByName(part).withColumn("picked", F.col("picked") & (F.col("size") > 0)).drop("fit", "bin_before"), "mix-cut")


def greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one source that are taken, in order, while they fit the gap, with the gap that is left."""
    rows = rows.sort_values("pos")
    gap, sizes = int(rows["gap"].iloc[0]), rows["size"].to_numpy()
    least = np.minimum.accumulate(sizes[::-1])[::-1]  # of what still follows
    taken = []
    for i, size in enumerate(sizes):
        if least[i] > gap:
            break
        if size <= gap:
            taken.append(i)
            gap -= int(size)
    return rows.iloc[taken][["source", "row", "size"]]


def filled(open_rows: DataFrame, gaps: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """What goes on to be taken of ``open_rows`` (source, key, id, size, row) in key order while it fits ``gaps`` (source, gap): (source, row, size), and the gaps left.

    Documents are ordered once. A round takes a source from a gap of 2**k to 2**(k + 1) words to one below 2**k: documents of at
    most 2**k words fit until then, so their running sum tells where it ends, and of the longer ones the first that
    fits ends it at once. So there are no more rounds than the longest document's size has binary digits, however
    the documents lie. As soon as at most ``small`` of them are left in all, they are gone through one by one.
    """
    per_source = lambda state: state.select(F.col("source").alias("g_source"), *(c for c in state.columns if c != "source"))
    live = lambda rows, state: rows.join(per_source(state), F.col("source").eqNullSafe(F.col("g_source"))).filter("size <= gap and pos > after").drop("g_source")
    state = gaps.withColumn("gap", F.floor("gap").cast("long")).withColumn("after", F.lit(-1).cast("long"))
    tasks = int(open_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("source", "key", F.col("id").asc_nulls_first(), "size", "row")
    fits = open_rows.join(per_source(gaps), F.col("source").eqNullSafe(F.col("g_source"))).filter("size <= gap").select("source", "key", "id", "size", "row")
    ordered = fits.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = written(ordered.select("source", "size", "row", F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().alias("range")), "mix-order")
    picked: list[DataFrame] = []
    while (now := live(rows, state)).count() > small:
        half = F.expr("shiftleft(1L, length(bin(gap)) - 1)")  # the largest power of two up to the gap
        now = now.withColumn("half", half)
        now = now.withColumn("low", F.when(F.col("size") <= F.col("half"), F.col("size")).otherwise(0))
        sums = now.groupBy("source", "range").agg(F.sum("low").alias("range_low"))
        earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_low").over(earlier), F.lit(0)).alias("used_before"))
        now = now.join(sums, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        inside = Window.partitionBy("source", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        now = now.withColumn("used", F.col("used_before") + F.coalesce(F.sum("low").over(inside), F.lit(0)))
        ends = F.when(F.col("low") > 0, F.col("gap") - F.col("used") - F.col("size") < F.col("half")).otherwise(F.col("size") <= F.col("gap") - F.col("used"))
        now = written(now.select("source", "row", "size", "pos", "low", "gap", ends.alias("ends")), "mix-round")
        first = now.groupBy(F.col("source").alias("f_source")).agg(F.min(F.when(F.col("ends"), F.col("pos"))).alias("last"))
        taken = now.join(first, F.col("source").eqNullSafe(F.col("f_source"))).filter("pos = last or low > 0 and (last is null or pos < last)")
        taken = written(taken.select("source", "row", "size", F.coalesce("last", F.lit(2**62)).alias("last")), "mix-more")
        picked.append(taken.select("source", "row", "size"))
        used = taken.groupBy(F.col("source").alias("u_source")).agg(F.sum("size").alias("used"), F.max("last").alias("last"))
        state = state.join(used, F.col("source").eqNullSafe(F.col("u_source")), "left")
        state = written(state.select("source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"), F.coalesce("last", "after").alias("after")), "mix-state")
    few = live(rows, state).groupBy("source").applyInPandas(greedy, fits.select("source", "row", "size").schema)
    picked.append(written(few, "mix-last-rows"))
    more = picked[0]
    for other in picked[1:]:
        more = more.unionByName(other)
    used = more.groupBy(F.col("source").alias("u_source")).agg(F.sum("size").alias("used"))
    left = gaps.join(used, F.col("source").eqNullSafe(F.col("u_source")), "left")
    return more, written(left.select("source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")), "mix-gaps-left")


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    max_repeats: int = 3,
    seed: str = "mix",
    bins: int = BINS,
) -> DataFrame:
    """How often each document is taken.

    docs: any table; only ``id_col``, ``source_col`` and what ``size`` reads are used, so other columns may have any name.
    quality: optional (id_col, quality_weight) rows, one per id at most; documents without one weigh 1.
    Returns a row per input row: ``id_col``, source, size, source_size, target, epochs (complete passes over the
    source), picked (in the fractional rest), repeats = epochs + picked, taken = repeats * size.

    Null ids draw the key of an empty string, null sources are one source of their own, null texts have size 0 and
    are never picked. Repeated rows, and all null ids, draw equal keys and are taken in order of size; equal rows are
    interchangeable. Texts of any length are counted whole. Documents are taken in key order while they fit whole, then those that still fit what is missing; of those left, the one whose size comes nearest to the words still
    missing is added if it brings the source nearer to its budget. An empty table gives an empty result.
    """
    key_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), unit(key_id, seed).alias("u"))
    if quality is not None:
        q = quality.select(F.col(id_col).alias("q_id"), F.col("quality_weight"))
        slim = slim.join(q, F.col("id") == F.col("q_id"), "left").drop("q_id")
    else:
        slim = slim.withColumn("quality_weight", F.lit(1.0))
    slim = slim.withColumn("key", -F.log("u") / F.coalesce("quality_weight", F.lit(1.0)))
    slim = slim.withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(bins)).cast("int"))
    with Workspace() as w:
        slim = written(slim.select("id", "source", "size", "key", "bin", F.monotonically_increasing_id().alias("row")), "mix-keys")

        targets = source_targets(slim, weights, share, max_repeats)
        epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeats), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
        targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        cut = taken_in_order(slim, targets.select("source", "source_size", "target", "epochs", "rest"))
        gaps = cut.groupBy("source").agg((F.max("rest") - F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0))).alias("gap"))
        gaps = written(gaps, "mix-gaps")
        more, gaps = filled(cut.filter(~F.col("picked") & (F.col("size") > 0)), gaps)
        added = more.select(F.col("row").alias("added_row"))
        cut = written(cut.join(added, F.col("row") == F.col("added_row"), "left").withColumn("picked", F.col("picked") | F.col("added_row").isNotNull()).drop("added_row"), "mix-filled")
        left = cut.filter(~F.col("picked") & (F.col("size") > 0)).alias("c").join(gaps.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        off = F.abs(F.col("gap") - F.col("size"))
        last = left.filter(off < F.col("gap")).groupBy("c.source").agg(F.min(F.struct(off.alias("off"), F.col("key"), F.col("row").alias("row"))).alias("best"))
        last = last.select(F.col("best.row").alias("last_row"))
        cut, last = w.keep(cut), w.keep(written(last, "mix-last"))
        out = cut.join(last, F.col("row") == F.col("last_row"), "left").withColumn("picked", F.col("picked") | F.col("last_row").isNotNull())
        repeats = F.col("epochs") + F.col("picked").cast("int")
        return out.select(
            F.col("id").alias(id_col), "source", "size", "source_size", "target", "epochs", "picked",
            repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"),
        )
