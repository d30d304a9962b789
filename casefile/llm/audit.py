"""Audit of how quality filters interact: what each filter removes at each step of every order of the filters.

A document is its set of failed filters, a mask. Documents are counted by part and mask first, so what follows works on
at most 2 ** filters rows a part. With M[mask, filter] = 0 where the mask fails the filter and infinite elsewhere, and
P[filter, order] = the filter's place in the order (the inverse permutation), the min-plus product of M and P is the step
at which documents of a mask go (infinite: they stay). Scattering the masks' weights by that step counts what is removed
and lost; comparing it with P counts what a filter would have removed, had an earlier one not done so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import text_bytes
from .held import drop, tidy
from .scratch import Workspace, written

#: A: too few words. B: few of them distinct. C: many capitals. D: holds a sign. E: an earlier document's text again.
FILTERS = "ABCDE"
#: Orders are all permutations; beyond so many filters there are too many.
MOST_FILTERS = 7


@dataclass(frozen=True)
class Limits:
    """Thresholds of the filters on one text."""

    least_words: int = 200
    distinct_percent: int = 50
    capitals_percent: int = 2
    signs: str = "#$%&*|"


def text_mask(text: bytes, limits: Limits, sign: re.Pattern[bytes]) -> int:
    """Failed filters A to D of a UTF-8 text as bits 0 to 3."""
    words = text.split()  # at x09-x0D and x20, as bytes
    data = np.frombuffer(text, np.uint8)
    code_points = len(data) - np.count_nonzero((data & 0xC0) == 0x80)
    capitals = np.count_nonzero(data - np.uint8(65) < 26)
    fails = (len(words) < limits.least_words, 100 * len(set(words)) < limits.distinct_percent * len(words), 100 * capitals > limits.capitals_percent * code_points, sign.search(text) is not None)
    return sum(1 << i for i, x in enumerate(fails) if x)


def masks(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask of every row: one bit per filter of ``FILTERS`` that its text fails.

    A null text is empty, a null part the empty string. A text is a repetition (E) where a smaller doc_id has the same
    text anywhere in the table; a row without doc_id is never one, nor does it make another one. Rows that repeat an id
    and a text are equal, so neither is a repetition of the other. Columns other than the three are ignored.
    """
    sign = re.compile(b"[" + re.escape(limits.signs.encode()) + b"]")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in tidy(batches):
            data, offsets = text_bytes(batch.column(2))
            found, digests = [], []
            for start, end in zip(offsets[:-1], offsets[1:], strict=True):
                text = data[start:end].tobytes()
                found.append(text_mask(text, limits, sign))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = written(rows.mapInArrow(read, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    # A group of copies counts as one row per task before the exchange, and the join is by digest and id, so no group is hot.
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("leads", F.lit(True))
    repeats = F.col("doc_id").isNotNull() & F.col("leads").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(repeats, 16).otherwise(0)).alias("mask"))


def weigh(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled quality 1 or toxic 1, by any label row of their id."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")).filter("is_good = 1 or is_toxic = 1")
    rows = masked.join(known, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))


def removal_steps(fails: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The min-plus product of masks (masks x filters, 0 or infinite) and places (filters x orders)."""
    out = np.full((fails.shape[0], places.shape[1]), np.inf)
    for f in range(fails.shape[1]):
        np.minimum(out, fails[:, f, None] + places[None, f, :], out=out)
    return out


def interactions(weights: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the table of ``weigh``.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. No part, no rows.
    """
    count = len(filters)
    if not 1 <= count <= MOST_FILTERS or len(set(filters)) != count:
        raise ValueError(f"filters are 1 to {MOST_FILTERS} different letters")
    orders = np.array(list(permutations(range(count))))
    names = np.array(["".join(filters[f] for f in order) for order in orders])
    places = np.argsort(orders, axis=1).T + 1.0  # filters x orders
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def count_part(rows: pd.DataFrame) -> pd.DataFrame:
        mask, n = rows["mask"].to_numpy(), rows["n"].to_numpy()
        failed = (mask[:, None] >> np.arange(count)) & 1 == 1
        step = removal_steps(np.where(failed, 0.0, np.inf), places)  # masks x orders
        at = np.where(np.isinf(step), count, step - 1).astype(int)  # the last column is of what stays
        gone = {}
        for c in ("n", "good", "toxic"):
            table = np.zeros((len(orders), count + 1), np.int64)
            np.add.at(table, (np.arange(len(orders))[None, :], at), rows[c].to_numpy()[:, None])
            gone[c] = table[:, :count]
        late = (failed[:, :, None] & (step[:, None, :] < places[None])) * n[:, None, None]
        redundant = np.take_along_axis(late.sum(axis=0).T, orders, axis=1)  # orders x steps
        alone = np.array([n[mask == 1 << f].sum() for f in range(count)])
        shapley = np.zeros(count, np.int64)
        np.add.at(shapley, orders, gone["n"])
        tables = (n.sum() - gone["n"].cumsum(axis=1), gone["n"], redundant, alone[orders], gone["good"], gone["toxic"], shapley[orders])
        head = {"part": rows["part"].iloc[0], "filter_order": np.repeat(names, count), "step": np.tile(np.arange(1, count + 1), len(orders))}
        return pd.DataFrame(head | {c: t.ravel() for c, t in zip(columns, tables, strict=True)})

    return weights.groupBy("part").applyInPandas(count_part, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``interactions`` of the filters of ``masks`` over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic)."""
    with Workspace() as work:
        weights = work.keep(written(weigh(masks(docs, limits), labels), "audit-weights"))
    return interactions(weights)
