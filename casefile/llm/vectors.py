"""What the two vector searches share: which rows take part, lists and their groups, routing of queries, the final ranking.

Every row is dealt to the list of its nearest centroid; centroids are fitted on a bounded sample. Lists that lie near each
other are put together to groups of bounded size, and a list beyond that size is cut into several. Candidates are
exchanged once, to their groups; a query goes to the groups that it has to read, once to each. A group that many queries
read is split among them: it is sent once for every ``max_queries`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Partial sums of tasks meet in this many parts before they meet in one.
FANS = 64

#: Points that are compared with all centroids at a time.
SLICE = 1024


def usable(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """(row, vec_id long, vec array<double>) of the rows that take part; ``row`` tells rows that share an id apart.

    Out go null ids and vectors that are null, hold null or non-finite components or, unless ``allow_zero``, have no
    component other than zero. Vectors of any length take part: a shorter one is as if it ended in zeros.
    """
    inf = F.lit(float("inf"))
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    if not allow_zero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec"), "vectors-rows")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows as a matrix of ``dim`` columns, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def sample_of(rows: DataFrame, n: int, size: int, dim: int, seed: int) -> np.ndarray:
    """The vectors of at most ``size`` rows, those with the least hashes."""
    share = min(1.0, 2.0 * size / max(1, n))
    mark = F.xxhash64("vec_id", "vec", F.lit(seed))
    picked = rows.filter(F.pmod(mark, F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    picked = picked.orderBy(mark, "vec_id", "row").limit(size)
    return matrix(pa.array([r[0] for r in picked.select("vec").collect()], pa.list_(pa.float64())), dim)


def nearest_centroid(points: np.ndarray, centroids: np.ndarray, norms: np.ndarray, times: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """For each point the centroid with the least ``norms`` - ``times`` * inner product, and that value; ``SLICE`` points at a time, so that memory does not grow with both."""
    own, cost = np.zeros(len(points), np.int64), np.zeros(len(points))
    for at in range(0, len(points), SLICE):
        far = norms - times * (points[at : at + SLICE] @ centroids.T)
        own[at : at + SLICE] = far.argmin(1)
        cost[at : at + SLICE] = far.min(1)
    return own, cost


def fit_centroids(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """k-means on the sample; a centroid that loses all points moves to the point worst served."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own, cost = nearest_centroid(sample, centroids, (centroids**2).sum(1))
        cost += (sample**2).sum(1)
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, sample)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        worst = iter(np.argsort(-cost))
        for c in np.flatnonzero(~full):
            centroids[c] = sample[next(worst)]
    return centroids


def near_order(centroids: np.ndarray, seed: int) -> np.ndarray:
    """The centroids in an order that keeps near ones together: by clusters of them, and within those by distance."""
    if len(centroids) < 3:
        return np.arange(len(centroids))
    upper = fit_centroids(centroids, max(1, round(len(centroids) ** 0.5)), 4, seed)
    chain, left = [0], set(range(1, len(upper)))
    while left:
        rest = np.array(sorted(left))
        chain.append(int(rest[((upper[rest] - upper[chain[-1]]) ** 2).sum(1).argmin()]))
        left.discard(chain[-1])
    place = np.empty(len(upper), np.int64)
    place[chain] = np.arange(len(upper))
    apart = ((centroids[:, None, :] - upper[None]) ** 2).sum(2) if len(centroids) * len(upper) * centroids.shape[1] < 1 << 24 else np.array([((upper - c) ** 2).sum(1) for c in centroids])
    own = apart.argmin(1)
    return np.lexsort((apart[np.arange(len(own)), own], place[own]))


@dataclass(frozen=True)
class Layout:
    """Per list its first group and the number of groups that it is cut into; more than one only for a list of its own."""

    base: np.ndarray
    cuts: np.ndarray

    @property
    def groups(self) -> int:
        return int((self.base + self.cuts).max(initial=0))

    def groups_of(self, lists: np.ndarray) -> np.ndarray:
        """The groups that hold rows of ``lists``, each once."""
        cut = lists[self.cuts[lists] > 1]
        more = [np.arange(self.base[at], self.base[at] + self.cuts[at]) for at in cut]
        return np.unique(np.concatenate([self.base[lists], *more])).astype(np.int32)


def layout(sizes: np.ndarray, order: np.ndarray, most: int) -> Layout:
    """Groups of at most about ``most`` rows: neighbours in ``order`` together, larger lists cut."""
    base, cuts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    now, held = 0, 0
    for at in order:
        size = int(sizes[at])
        if held and held + size > most:
            now, held = now + 1, 0
        base[at] = now
        if size > most:
            cuts[at] = -(-size // most)
            now, held = now + int(cuts[at]), 0
        else:
            held += size
    return Layout(base, cuts)


def list_facts(dealt: DataFrame, lists: int, dim: int, values: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per list the number of its rows, and the least and the greatest of each component of ``values(vectors)``.

    A task gives one row per list that it meets; those meet in parts first, so no task gets a row of every other one.
    """
    schema = "list int, fan int, n long, low binary, high binary"
    names = ["list", "fan", "n", "low", "high"]

    def rows_of(fan: int, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
        met = np.flatnonzero(n)
        return [pa.array(met, pa.int32()), pa.array([fan] * len(met), pa.int32()), pa.array(n[met], pa.int64()), *(pa.array([x[i].tobytes() for i in met], pa.binary()) for x in (low, high))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(lists, np.int64), np.full((lists, dim), np.inf), np.full((lists, dim), -np.inf)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), values(matrix(batch.column(1), dim))
            order = np.argsort(own, kind="stable")
            met, first = np.unique(own[order], return_index=True)
            if len(met):
                n += np.bincount(own, minlength=lists)
                low[met] = np.minimum(low[met], np.minimum.reduceat(x[order], first))
                high[met] = np.maximum(high[met], np.maximum.reduceat(x[order], first))
        yield pa.RecordBatch.from_arrays(rows_of(TaskContext.get().partitionId() % FANS, n, low, high), names)

    def merge(table: pa.Table) -> pa.Table:
        low, high = (np.frombuffer(b"".join(table[c].to_pylist()), np.float64).reshape(-1, dim) for c in ("low", "high"))
        total = pa.array([sum(table["n"].to_pylist())], pa.int64())
        return pa.table([table["list"][:1], table["fan"][:1], total, pa.array([low.min(0).tobytes()], pa.binary()), pa.array([high.max(0).tobytes()], pa.binary())], names)

    parts = dealt.select("list", "vec").mapInArrow(look, schema)
    parts = parts.groupBy("list", "fan").applyInArrow(merge, schema).groupBy("list").applyInArrow(merge, schema)
    n, low, high = np.zeros(lists, np.int64), np.full((lists, dim), np.inf), np.full((lists, dim), -np.inf)
    for r in parts.select("list", "n", "low", "high").collect():  # one row per list
        n[r[0]], low[r[0]], high[r[0]] = r[1], np.frombuffer(r[2]), np.frombuffer(r[3])
    return n, low, high


def in_groups(dealt: DataFrame, found: Layout) -> DataFrame:
    """``dealt`` with the column ``grp``: the group of each row."""
    spark = dealt.sparkSession
    where = spark.createDataFrame(list(zip(range(len(found.base)), found.base.tolist(), found.cuts.tolist(), strict=True)), "w_list int, base int, cuts int")
    own = F.col("base") + F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int")
    # One small row per list is broadcast.
    return dealt.join(F.broadcast(where), F.col("list") == F.col("w_list")).withColumn("grp", own).drop("w_list", "base", "cuts")


def read_groups(
    candidates: DataFrame, queries: DataFrame, routes: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, max_queries: int
) -> DataFrame:
    """``work(candidates of a group, queries that read it)`` for every group that a query reads.

    candidates: any columns and grp; queries: row and any columns; routes: row, grps (the groups that a query reads, as
    an array of structs of grp and whatever goes with the query to that group) and any columns that go with the query.
    """
    spark = candidates.sparkSession
    wanted = routes.select(F.explode("grps.grp").alias("w_grp")).groupBy("w_grp").agg(F.ceil(F.count(F.lit(1)) / max_queries).cast("int").alias("splits"))
    wanted = [(r[0], r[1]) for r in wanted.collect()]  # one small row per group
    wanted = spark.createDataFrame(wanted, "w_grp int, splits int")
    docs = candidates.join(F.broadcast(wanted), F.col("grp") == F.col("w_grp")).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    asked = queries.join(routes.withColumnRenamed("row", "q_row"), F.col("row") == F.col("q_row")).select("*", F.inline("grps")).drop("q_row", "grps")
    asked = asked.join(F.broadcast(wanted), F.col("grp") == F.col("w_grp")).withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int"))
    docs, asked = docs.drop("w_grp", "splits"), asked.drop("w_grp", "splits")
    names = asked.columns
    # Both sides come from one table, so one of them gets new names for the exchange.
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in names))

    def on_group(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right.rename_columns([c.removeprefix("q_") for c in right.column_names]))

    return docs.groupBy("grp", "split").cogroup(asked.groupBy("q_grp", "q_split")).applyInArrow(on_group, schema)


def ranked(found: DataFrame, k: int, *order: object) -> DataFrame:
    """The best k of (row, query_id, vec_id, score) per query row: query_id, rank, vec_id, score; ties to the smaller vec_id."""
    by = Window.partitionBy("row").orderBy(F.desc("score"), *order, "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
