"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more component, sqrt(M^2 - |x|^2) with M a bound of the norms, and queries are scaled to the norm M,
which makes the largest inner product the least distance; then both are rotated at random, so that any first d
components hold d/D of a squared distance but for chance. Vectors are dealt to inverted lists by the nearest centroid;
centroids are fitted on a bounded sample, every vector is in a list. M is twice the largest norm of that sample; the few
vectors beyond it are a list of their own, which every query reads whole. A query reads its nearest lists. In a list it
takes the first columns of all candidates, and after each block of columns drops those whose partial distance,
extrapolated and less a margin of ``epsilon`` / sqrt(d), is beyond its k-th best so far. What is left is scored exactly,
in double precision, on the original vectors.

Lists are stored in groups (see ``vectors``). A query reads the group of its nearest list first; the k-th best distance
found there goes with it to the groups of its other lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, written
from .vectors import fit_centroids, in_groups, layout, list_facts, matrix, near_order, nearest_centroid, ranked, read_groups, sample_of, usable

SCHEMA = "row long, query_id long, vec_id long, score double, limit double"


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Space:
    """The turned space of candidates and queries."""

    def __init__(self, dim: int, reach: float, seed: int):
        self.reach, self.turn = reach, rotation(dim + 1, seed)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.reach**2 - (x**2).sum(1)))]) @ self.turn

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)  # no norm overflows
        x = x * (self.reach / np.sqrt((x**2).sum(1, keepdims=True)))
        return np.column_stack([x, np.zeros(len(x))]) @ self.turn


def probes_for(sample: np.ndarray, points: np.ndarray, asked: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """The least number of nearest lists that hold ``recall`` of the true k neighbours within the sample.

    sample: original vectors; points, asked: the same rows turned as candidates and as queries. Neighbours within a
    sample are farther than those among all rows, so the number errs on the large side.
    """
    half = (centroids**2).sum(1)
    own, _ = nearest_centroid(points, centroids, half)
    who = np.arange(min(queries, len(sample)))
    order = np.argsort(half - 2 * asked[who] @ centroids.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    scores = sample[who] @ sample.T
    scores[who, who] = -np.inf
    top = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if not top.size:
        return len(centroids)
    return int(np.quantile(place[who[:, None], own[top]], recall, method="higher")) + 1


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The row numbers of several ranges, in the ranges' order."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def scan(columns: list[np.ndarray], rows: np.ndarray, rotated: np.ndarray, k: int, epsilon: float, warm: int, limit: float) -> tuple[np.ndarray, float, int]:
    """One query over ``rows``, nearest lists first: the rows left, the k-th best distance, components read.

    limit: the k-th best distance so far. Without one the first ``warm`` rows are read whole and give the first.
    """
    dim = len(rotated)
    edges = np.concatenate([[0], np.cumsum([c.shape[1] for c in columns])])
    whole = lambda some: sum(((c[some] - rotated[a:b]) ** 2).sum(1) for c, a, b in zip(columns, edges, edges[1:], strict=False))
    first, alive = (rows[:warm], rows[warm:]) if np.isinf(limit) else (rows[:0], rows)
    read = len(first) * dim
    if len(first) >= k:
        limit = np.partition(whole(first), k - 1)[k - 1]
    partial = np.zeros(len(alive))
    for c, a, b in zip(columns, edges, edges[1:], strict=False):
        if not len(alive):
            break
        partial = partial + ((c[alive] - rotated[a:b]) ** 2).sum(1)
        read += len(alive) * (b - a)
        if b < dim:
            keep = partial * (dim / b) <= limit * (1 + epsilon / np.sqrt(b)) ** 2
            alive, partial = alive[keep], partial[keep]
    kept = np.concatenate([first, alive[partial <= limit * (1 + 1e-9)]])
    if len(kept) >= k:
        limit = min(limit, np.partition(whole(kept), k - 1)[k - 1])
    return kept, float(limit), read


def best_of(originals: np.ndarray, ids: np.ndarray, kept: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores and ids of the k best of ``kept``."""
    with np.errstate(all="ignore"):
        scores = (originals[kept] * query).sum(1)
    best = np.lexsort((ids[kept], -scores))[:k]
    return scores[best], ids[kept][best]


def neighbours(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    query_every: int = 20,
    recall: float = 0.97,
    max_lists: int = 4_096,
    sample_rows: int = 20_000,
    block_columns: int = 8,
    epsilon: float = 1.5,
    warm: int = 200,
    group_bytes: int = 1 << 24,
    max_queries: int = 16_384,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows but the query's own row: of
    rows that share an id each is a query and a candidate of its own. Rows that take no part, and vectors of different
    lengths: see ``vectors.usable``; zero and empty vectors take no part either. Centroids (about the square root of the
    rows, at most ``max_lists``) are fitted on at most ``sample_rows`` rows with the least hashes; a query reads as many
    of the nearest lists as hold ``recall`` of the true neighbours within that sample, and more, if those hold fewer than
    2k rows. Fewer than k candidates give all of them, an empty table none. Products beyond the range of a double are
    infinite and rank as such.
    """
    with Workspace() as w:
        rows = usable(vectors, id_col, vec_col, allow_zero=False)
        spark = rows.sparkSession
        n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        sample = sample_of(rows, n, sample_rows, dim, seed)
        norms = np.sqrt(np.minimum((np.clip(sample, -1e150, 1e150) ** 2).sum(1), 1e300))
        # Few rows lie beyond twice the sample's bulk; an odd sample row must not squeeze all others together.
        reach = 2.0 * float(min(norms.max(), 4 * np.quantile(norms, 0.99)))
        sample = sample[norms <= reach]
        space = Space(dim, reach, seed)
        points, asked = space.candidates(sample), space.queries(sample)
        centroids = fit_centroids(points, min(max_lists, max(1, round(n**0.5))), 8, seed)
        probes = probes_for(sample, points, asked, centroids, k, recall)
        half, far = (centroids**2).sum(1), len(centroids)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(2), dim)
                with np.errstate(over="ignore"):
                    beyond = (x**2).sum(1) > reach**2
                x = np.where(beyond[:, None], 0, x)
                own, _ = nearest_centroid(space.candidates(x), centroids, half)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(beyond, far, own), pa.int32())], ["row", "vec_id", "vec", "list"])

        dealt = written(rows.mapInArrow(deal, "row long, vec_id long, vec array<double>, list int"), "ann-lists")
        sizes = np.zeros(far + 1, np.int64)
        for r in dealt.groupBy("list").count().collect():  # one row per list
            sizes[r[0]] = r[1]
        most = max(256, min(group_bytes // (8 * dim), -(-n // 16)))
        plan = layout(sizes, np.append(near_order(centroids, seed), far), most)
        candidates, queries = in_groups(dealt, plan), dealt.filter(F.col("vec_id") % query_every == 0).select("row", "vec_id", "vec")

        def lists_of(rotated: np.ndarray) -> np.ndarray:
            """The lists that a query reads, the nearest first; the far one last."""
            near = np.argsort(half - 2 * centroids @ rotated, kind="stable")
            held = sizes[near]
            near = near[((np.arange(len(near)) < probes) | (np.cumsum(held) - held < 2 * k)) & (held > 0)]
            return np.append(near, far) if sizes[far] else near

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("grp", pa.int32()), ("lists", pa.list_(pa.int32()))]))
            for batch in batches:
                first, rest = [], []
                for rotated in space.queries(matrix(batch.column(1), dim)):
                    reads: dict[int, list[int]] = {}
                    for at in lists_of(rotated).tolist():
                        for g in range(plan.base[at], plan.base[at] + plan.cuts[at]):
                            reads.setdefault(g, []).append(at)
                    parts = [{"grp": g, "lists": lists} for g, lists in reads.items()]
                    first.append(parts[:1])
                    rest.append(parts[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, kind), pa.array(rest, kind)], ["row", "first", "rest"])

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], [], []]
            if left.num_rows and right.num_rows:
                lists = left["list"].to_numpy()
                order = np.argsort(lists, kind="stable")
                lists, ids, row_of = lists[order], left["vec_id"].to_numpy()[order], left["row"].to_numpy()[order]
                originals = matrix(left["vec"], dim)[order]
                first = np.searchsorted(lists, np.arange(far + 2))
                x = space.candidates(np.where((lists == far)[:, None], 0, originals))
                columns = [np.ascontiguousarray(x[:, a : a + block_columns]) for a in range(0, x.shape[1], block_columns)]
                limits = right["limit"].to_pylist() if "limit" in right.column_names else [None] * right.num_rows
                queries = matrix(right["vec"], dim)
                facts = (right["row"].to_numpy(), right["vec_id"].to_numpy(), right["lists"].to_pylist(), limits)
                for query, rotated, own, name, reads, limit in zip(queries, space.queries(queries), *facts, strict=True):
                    near = np.array([at for at in reads if at != far], np.int64)
                    some = ranges(first[near], first[near + 1] - first[near])
                    some = some[row_of[some] != own]
                    kept, limit, _ = scan(columns, some, rotated, k, epsilon, warm, np.inf if limit is None else limit)
                    beyond = np.arange(first[far], first[far + 1]) if far in reads else np.zeros(0, np.int64)
                    s, v = best_of(originals, ids, np.concatenate([kept, beyond[row_of[beyond] != own]]), query, k)
                    for column, values in zip(out, ([own] * len(v), [name] * len(v), v, s, [limit] * len(v)), strict=True):
                        column.extend(values)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["row", "query_id", "vec_id", "score", "limit"])

        routes = written(queries.select("row", "vec").mapInArrow(route, "row long, first array<struct<grp:int,lists:array<int>>>, rest array<struct<grp:int,lists:array<int>>>"), "ann-routes")
        found = written(read_groups(candidates, queries, routes.select("row", F.col("first").alias("grps")), work, SCHEMA, max_queries), "ann-first")
        limits = found.groupBy("row").agg(F.min("limit").alias("limit")).select(F.col("row").alias("l_row"), "limit")
        more = routes.select("row", F.col("rest").alias("grps")).join(limits, F.col("row") == F.col("l_row"), "left").drop("l_row")
        rest = written(read_groups(candidates, queries, more, work, SCHEMA, max_queries), "ann-rest")
        return ranked(w.keep(found).unionByName(w.keep(rest)).select("row", "query_id", "vec_id", "score"), k)
