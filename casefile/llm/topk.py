"""Exact top-k by integer inner product, block at a time.

Vectors become integers. The table is put in an order once: rows lie by the nearest of a few centroids, near centroids
together, and are cut into document ranges: groups that are stored together, lists within them, and blocks of
``block_rows`` rows within those, each with the largest and the least value of every component. A query's bound for a
range is the sum over its components of value times the extreme that suits its sign.

Every query reads the group with its largest bound first, which gives it a k-th best score; then it goes to those groups
only whose bound reaches that score. In a group blocks are scored from the largest bound downwards, as a product with
their forward index, until a bound is below the k-th best; equal bounds are scored, as a tie may have a smaller id.
Nothing is skipped but by a bound, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, written
from .vectors import Layout, fit_centroids, in_groups, layout, list_facts, matrix, near_order, nearest_centroid, ranked, read_groups, sample_of, usable

SCHEMA = "row long, query_id long, vec_id long, score long, wide binary"
#: Queries whose bounds are worked out together.
TOGETHER = 1024


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), exact: doubles, or Python's integers where a product is beyond a double."""
    with np.errstate(over="ignore"):
        v = np.floor(scale * x)
    odd = ~np.isfinite(v)
    if odd.any():
        v = v.astype(object)
        v[odd] = [floor(Fraction(scale) * Fraction(float(a))) for a in x[odd]]
    return v


def plain_limit(dim: int) -> float:
    """Components up to this give scores below 2**62."""
    return 2.0**31 / max(1, dim) ** 0.5


def as_floats(v: np.ndarray) -> np.ndarray:
    if v.dtype != object:
        return v
    return np.array([[float(a) if abs(a) < 1 << 1000 else np.copysign(np.inf, float(np.sign(a))) for a in row] for row in v], np.float64).reshape(v.shape)


def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries x ranges) no less than any score in the range; infinite where doubles cannot tell."""
    with np.errstate(all="ignore"):
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        high, low = np.nan_to_num(high, neginf=0.0, posinf=np.inf), np.nan_to_num(low, posinf=0.0, neginf=-np.inf)
        out = up @ high.T + down @ low.T
        # Room for rounding where the numbers are too large for exact products.
        room = up @ np.abs(high).T - down @ np.abs(low).T
        out = np.where(room < 2.0**52, out, out + room * 1e-12)
    return np.where(np.isnan(out), np.inf, out)


def lowered(kth: float) -> float:
    """A double no greater than an exact score of this size."""
    return kth if abs(kth) < 2.0**52 else kth - abs(kth) * 1e-12


class Block:
    """The rows of a group in order, with their integers in the narrowest exact form."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray, lists: np.ndarray, block_rows: int):
        order = np.lexsort((rows, lists))
        self.ids, self.rows, self.values = ids[order], rows[order], values[order]
        lists = lists[order]
        new = np.concatenate([[True], lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, bool)
        place = np.arange(len(lists)) - np.maximum.accumulate(np.where(new, np.arange(len(lists)), 0))
        self.starts = np.flatnonzero(place % block_rows == 0)
        self.ends = np.append(self.starts[1:], len(lists))
        floats = as_floats(self.values)
        self.high, self.low = np.maximum.reduceat(floats, self.starts), np.minimum.reduceat(floats, self.starts)
        self.top = float(np.abs(floats).max(initial=0))
        self.forms: dict[str, np.ndarray] = {}

    def scores(self, at: np.ndarray, query: np.ndarray, top: float) -> np.ndarray:
        """Exact scores of the rows ``at``."""
        room = self.top * top * len(query)
        if self.values.dtype != object and query.dtype != object and room < 2.0**53:
            return (self.values[at] @ query).astype(np.int64)
        if self.values.dtype != object and query.dtype != object and room < 2.0**63:
            if "long" not in self.forms:
                self.forms["long"] = self.values.astype(np.int64)
            return self.forms["long"][at] @ query.astype(np.int64)
        q = [int(a) for a in query]
        return np.array([sum(int(a) * b for a, b in zip(self.values[i], q, strict=True)) for i in at] + [None], object)[:-1]


def search(block: Block, own: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: float | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows that reach ``kth``, and how many ranges were scored."""
    top = float(np.abs(as_floats(query[None])).max(initial=0))
    order = np.argsort(-bounds, kind="stable")
    kept_s, kept_v, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    at, take = 0, 2
    while at < len(order):
        now = order[at : at + take]
        if kth is not None:
            now = now[bounds[now] >= kth]
            if not len(now):
                break
        rows = np.concatenate([np.arange(block.starts[r], block.ends[r]) for r in now])
        rows = rows[block.rows[rows] != own]
        s = block.scores(rows, query, top)
        if kth is not None:
            reach = s >= kth
            rows, s = rows[reach], s[reach]
        kept_s, kept_v = np.concatenate([kept_s, s]), np.concatenate([kept_v, block.ids[rows]])
        if len(kept_s) > k:
            best = np.lexsort((kept_v, -kept_s))[:k] if kept_s.dtype != object else np.array(sorted(range(len(kept_s)), key=lambda i: (-kept_s[i], kept_v[i]))[:k])  # noqa: B023
            kept_s, kept_v = kept_s[best], kept_v[best]
        if len(kept_s) == k:
            least = min(kept_s)
            least = lowered(float(least)) if abs(least) < 1 << 1000 else -np.inf
            kth = least if kth is None else max(kth, least)
        scored += len(now)
        at += take
        take *= 2
    return kept_s, kept_v, scored


def packed(scores: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores as longs; what a long cannot hold is put at its ends, with bytes that sort as the exact scores do."""
    if scores.dtype != object:
        return scores, [None] * len(scores)
    big = [abs(int(s)) >= 1 << 63 for s in scores]
    longs = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores], np.int64)
    return longs, [(int(s) + (1 << 4160)).to_bytes(521, "big") if b else None for s, b in zip(scores, big, strict=True)]


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    query_every: int = 20,
    scale: float = 64.0,
    block_rows: int = 64,
    max_lists: int = 1_024,
    sample_rows: int = 10_000,
    group_bytes: int = 1 << 24,
    max_queries: int = 16_384,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products, ties to the smaller vec_id.

    Components x become floor(scale * x). Queries are the rows whose id is divisible by ``query_every``; candidates
    are all rows but the query's own row: of rows that share an id each is a query and a candidate of its own. Rows that
    take no part, and vectors of different lengths: see ``vectors.usable`` (zero and empty vectors take part). Fewer
    than k candidates give fewer rows, an empty table none. Sums are exact at any size; they rank as they are, and a
    score that no long can hold is given as the long nearest to it.

    Only the order of rows, and with it the work, depends on the sample and on the numbers of lists, rows and bytes.
    """
    with Workspace() as w:
        rows = usable(vectors, id_col, vec_col, allow_zero=True)
        spark = rows.sparkSession
        n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        dim = max(1, dim)
        limit = plain_limit(dim)
        with np.errstate(over="ignore"):
            sample = np.clip(np.floor(scale * sample_of(rows, n, sample_rows, dim, seed)), -limit, limit)
        centroids = fit_centroids(sample, min(max_lists, max(1, round(n**0.5))), 6, seed)
        lists = len(centroids) + 1  # the last one holds the rows whose products need more than 63 bits
        half = (centroids**2).sum(1) / 2

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = as_floats(integers(matrix(batch.column(2), dim), scale))
                with np.errstate(all="ignore"):
                    own, _ = nearest_centroid(v, centroids, half, 1.0)
                own = np.where(np.abs(v).max(1, initial=0) > limit, lists - 1, own)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["row", "vec_id", "vec", "list"])

        dealt = written(rows.mapInArrow(deal, "row long, vec_id long, vec array<double>, list int"), "topk-lists")
        sizes, low, high = list_facts(dealt, lists, dim, lambda x: as_floats(integers(x, scale)))
        most = max(256, min(group_bytes // (8 * dim), -(-n // 16)))
        plan = layout(sizes, np.append(near_order(centroids, seed), lists - 1), most)
        candidates, queries = in_groups(dealt, plan), dealt.filter(F.col("vec_id") % query_every == 0).select("row", "vec_id", "vec")
        first = written(route(queries, plan, sizes, low, high, dim, scale, best=True), "topk-first")
        work = searcher(dim, scale, k, block_rows)
        found = written(read_groups(candidates, queries, first, work, SCHEMA, max_queries), "topk-found")
        # The k-th best score of the first group, for queries that have one.
        kth = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).select(F.col("row").alias("k_row"), "kth")
        done = first.select(F.col("row").alias("f_row"), F.col("grps").alias("done"))
        held = queries.join(done, F.col("row") == F.col("f_row")).drop("f_row").join(kth, F.col("row") == F.col("k_row"), "left").drop("k_row")
        more = written(route(held, plan, sizes, low, high, dim, scale, best=False), "topk-more")
        rest = written(read_groups(candidates, queries, more, work, SCHEMA, max_queries), "topk-rest")
        # Wider scores lie beyond all longs, so at either end the bytes come first.
        return ranked(w.keep(found).unionByName(w.keep(rest)), k, F.desc_nulls_last("wide"))


def route(queries: DataFrame, plan: Layout, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, dim: int, scale: float, best: bool) -> DataFrame:
    """row, grps[, kth]: the group with the largest bound, or all others whose bound reaches the query's k-th best."""
    live, kind = np.flatnonzero(sizes), pa.list_(pa.struct([("grp", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                bounds = bounds_of(as_floats(integers(matrix(part.column(1), dim), scale)), low[live], high[live])
                if best:
                    grps = [[{"grp": int(plan.base[live[i]])}] for i in bounds.argmax(1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grps, kind)], ["row", "grps"])
                else:
                    # The least long may stand for less.
                    kth = [None if x is None or x == -(1 << 63) else lowered(float(x)) for x in part.column(3).to_pylist()]
                    grps = []
                    for b, least, seen in zip(bounds, kth, part.column(2).to_pylist(), strict=True):
                        reach = live if least is None else live[b >= least]
                        grps.append([{"grp": g} for g in np.setdiff1d(plan.groups_of(reach), [x["grp"] for x in seen]).tolist()])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grps, kind), pa.array(kth, pa.float64())], ["row", "grps", "kth"])

    if best:
        return queries.select("row", "vec").mapInArrow(work, "row long, grps array<struct<grp:int>>")
    return queries.select("row", "vec", "done", "kth").mapInArrow(work, "row long, grps array<struct<grp:int>>, kth double")


def searcher(dim: int, scale: float, k: int, block_rows: int):
    """The search of one group for ``vectors.read_groups``."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            block = Block(*(left[c].to_numpy() for c in ("vec_id", "row")), integers(matrix(left["vec"], dim), scale), left["list"].to_numpy(), block_rows)
            rows, ids = right["row"].to_numpy(), right["vec_id"].to_numpy()
            kths = right["kth"].to_pylist() if "kth" in right.column_names else [None] * len(rows)
            for at in range(0, len(rows), TOGETHER):
                queries = integers(matrix(right["vec"].slice(at, TOGETHER), dim), scale)
                bounds = bounds_of(as_floats(queries), block.low, block.high)
                for i, query in enumerate(queries):
                    s, v, _ = search(block, rows[at + i], query, bounds[i], k, kths[at + i])
                    longs, wide = packed(s)
                    for column, values in zip(out, ([rows[at + i]] * len(v), [ids[at + i]] * len(v), v, longs, wide), strict=True):
                        column.extend(values)
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["row", "query_id", "vec_id", "score", "wide"])

    return work
