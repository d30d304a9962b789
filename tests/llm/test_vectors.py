import math
import random

import numpy as np
import pytest
from casefile.llm import nearest, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, score double, chunk string"
WIDE = SCHEMA.replace("float", "double")


def rows(n=400, dim=12, seed=3):
    """Vectors with copies, rows that take no part, shorter ones, an empty one, and a row that is there twice."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[50:90] = x[50]  # one vector many times
    out = [(i, [float(v) for v in x[i]], 0.0, "c") for i in range(n)]
    nan, inf = float("nan"), float("inf")
    out += [(400, None, 0.0, ""), (420, [nan] * dim, 0.0, ""), (440, [inf] + [1.0] * (dim - 1), 0.0, ""), (None, [1.0] * dim, 0.0, ""), (460, [0.0] * dim, 0.0, ""), (461, [1.0, 2.0], 0.0, ""), (462, [], 0.0, "")]
    out += [(463, [None] + [1.0] * (dim - 1), 0.0, ""), out[20], (40, [0.5] * 5, 0.0, "")]
    return out


def usable(data, zero, dim=12):
    """(id, padded vector) of the rows that take part."""
    found = []
    for i, v, *_ in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            found.append((i, np.array([*v, *[0.0] * (dim - len(v))])))
    return found


def brute(data, k, zero, score, dim=12):
    """Per query id the (score, id) lists of its rows."""
    v, out = usable(data, zero, dim), {}
    for a, (q, x) in enumerate(v):
        if q % 20 == 0:
            out.setdefault(q, []).append(sorted(((-score(x, y), c) for b, (c, y) in enumerate(v) if b != a))[:k])
    return out


def by_rank(df):
    """Per query id and rank what was found, in order."""
    out = {}
    for r in df.collect():
        out.setdefault((r.query_id, r.rank), []).append((r.vec_id, r.score))
    return {key: sorted(v) for key, v in out.items()}


def as_ranks(want):
    return {(q, i + 1): sorted((row[i][1], -row[i][0]) for row in lists if i < len(row)) for q, lists in want.items() for i in range(max(map(len, lists)))}


def whole(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_top_k_equals_brute_force(spark):
    data = rows()
    got = topk.top_k(spark.createDataFrame(data, SCHEMA), group_bytes=1 << 12)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert by_rank(got) == as_ranks(brute(data, 20, True, whole))


def test_top_k_of_components_beyond_longs(spark):
    """Products are exact at any size; what no long holds is put at its ends."""
    r = np.random.default_rng(2)
    data = [(i, [float(x) for x in r.standard_normal(4)], 0.0, "") for i in range(60)]
    data += [(60, [1e19, 1.0, 0.0, 0.0], 0.0, ""), (61, [-1e19, 1.0, 0.0, 0.0], 0.0, ""), (62, [1e308, -1e308, 1e308, 5.0], 0.0, ""), (80, [1e308, 1e308, -1e308, 5.0], 0.0, ""), (63, [4e6] * 4, 0.0, ""), (64, [3e17, 0.0, 0.0, 1.0], 0.0, "")]
    exact = lambda a, b: sum(math.floor(int(x) * 64 if abs(x) > 1e15 else 64 * x) * math.floor(int(y) * 64 if abs(y) > 1e15 else 64 * y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    want = as_ranks(brute(data, 66, True, exact, 4))
    got = by_rank(topk.top_k(spark.createDataFrame(data, WIDE), k=66))
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert got == {key: [(v, held(s)) for v, s in found] for key, found in want.items()}
    assert by_rank(topk.top_k(spark.createDataFrame(data, WIDE), k=3)) == {k: v for k, v in got.items() if k[1] <= 3}


def clustered(n, dim=16, seed=4):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((40, dim)) * 4
    x = centre[r.integers(0, 40, n)] + r.standard_normal((n, dim)) * 0.05
    return [(i, [float(v) for v in x[i]], 0.0, "") for i in range(n)]


def test_queries_go_to_few_groups(spark, monkeypatch):
    """Rows that are exchanged grow about as the table does: candidates once a round, a query to the groups it needs."""
    seen = []
    real = vectors.read_groups

    def counting(candidates, queries, routes, *rest):
        sent = routes.selectExpr("sum(size(grps)) as n").first().n or 0
        seen.append(sent)
        return real(candidates, queries, routes, *rest)

    for module, run in ((topk, topk.top_k), (nearest, nearest.neighbours)):
        monkeypatch.setattr(module, "read_groups", counting)
        totals = []
        for n in (1500, 6000):
            seen.clear()
            out = run(spark.createDataFrame(clustered(n), SCHEMA), k=5, group_bytes=16 * 8 * 256).groupBy("query_id").count().collect()
            assert len(out) == n // 20 and {r["count"] for r in out} == {5}
            totals.append(sum(seen))
        assert totals[1] <= 6 * totals[0] and totals[1] <= 6000  # of 300 queries and at least 24 groups


def test_a_group_that_all_read_is_split(spark):
    data = rows()
    want = as_ranks(brute(data, 20, True, whole))
    assert by_rank(topk.top_k(spark.createDataFrame(data, SCHEMA), max_queries=3)) == want


def test_groups_of_lists():
    plan = vectors.layout(np.array([5, 0, 30, 4, 4, 9]), np.array([3, 0, 1, 2, 4, 5]), 10)
    assert plan.base.tolist() == [0, 0, 1, 0, 4, 5] and plan.cuts.tolist() == [1, 1, 3, 1, 1, 1] and plan.groups == 6
    assert plan.groups_of(np.array([0, 3, 2])).tolist() == [0, 1, 2, 3]


def test_top_k_few_and_none(spark):
    few = [(0, [1.0, -1.0], 0.0, ""), (1, [1.0, 1.0], 0.0, ""), (2, [-1.0, 1.0], 0.0, "")]
    assert grouped(topk.top_k(spark.createDataFrame(few, SCHEMA))) == {0: [(1, 0), (2, -8192)]}
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nearest.neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {q: [c for c, _ in v] for q, v in grouped(nearest.neighbours(spark.createDataFrame(few, SCHEMA))).items()} == {0: [1, 2]}


def test_pruning_scores_fewer_ranges():
    r = np.random.default_rng(0)
    centre = r.standard_normal((8, 16)) * 4
    own = r.integers(0, 8, 4000)
    docs = np.floor(64 * (centre[own] + r.standard_normal((4000, 16)) * 0.3))
    block = topk.Block(np.arange(4000), np.arange(4000), docs, own, 64)
    scored = 0
    for i in range(20):
        s, v, n = topk.search(block, i, docs[i], topk.bounds_of(docs[i : i + 1], block.low, block.high)[0], 20, None)
        want = sorted((-int(docs[j] @ docs[i]), j) for j in range(4000) if j != i)[:20]
        assert [(-a, b) for a, b in zip(s.tolist(), v.tolist(), strict=True)] == want
        scored += n
    assert scored < 0.5 * 20 * len(block.starts)


def recall_of(got, want):
    return np.mean([len(set(got.get(key, [])) & set(found)) / len(found) for key, found in want.items()])


def test_neighbours_recall_and_scores(spark):
    data = rows()
    want, got = brute(data, 20, False, lambda a, b: float(a @ b)), {}
    out = nearest.neighbours(spark.createDataFrame(data, SCHEMA), group_bytes=1 << 12).collect()
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vector = {}
    for i, v in usable(data, False):
        vector.setdefault(i, []).append(v)
    assert set(got) == set(want) and 40 in got and all(len(got[q]) == 20 * len(want[q]) for q in want)
    assert recall_of({q: [c for _, c, _ in v] for q, v in got.items()}, {q: [c for found in lists for _, c in found] for q, lists in want.items()}) >= 0.9
    for q, found in got.items():
        for _, c, s in found:
            assert any(s == pytest.approx(float(a @ b), rel=1e-12, abs=1e-12) for a in vector[q] for b in vector[c])
        if len(want[q]) == 1:
            found = sorted(found)
            assert [x[1:] for x in found] == sorted((x[1:] for x in found), key=lambda x: (-x[1], x[0]))


def test_neighbours_with_far_rows(spark):
    """A few vectors of enormous norms neither break nor hide the others."""
    data = [x for x in rows() if x[0] not in (461, 462)] + [(900, [1e200] * 12, 0.0, ""), (901, [-1e30, *[0.0] * 11], 0.0, ""), (920, [50.0] * 12, 0.0, "")]
    want = {q: v for q, v in brute(data, 20, False, lambda a, b: float(a @ b)).items()}
    got = {}
    for r in nearest.neighbours(spark.createDataFrame(data, WIDE)).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert recall_of(got, {q: [c for found in lists for _, c in found] for q, lists in want.items()}) >= 0.9


def test_recall_on_the_given_vectors(spark):
    d = "/root/testdata/sf0.1/embeddings.parquet"
    table = spark.read.parquet(d)
    found = nearest.neighbours(table).select("query_id", "vec_id").collect()
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    got = {}
    for q, c in found:
        got.setdefault(q, set()).add(c)
    shares = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        shares.append(len(got[ids[at]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(shares) >= 0.9


def test_early_abandoning_reads_less():
    r = np.random.default_rng(1)
    centres = r.standard_normal((10, 64))
    x = centres[r.integers(0, 10, 3000)] + 0.2 * r.standard_normal((3000, 64))
    columns = [np.ascontiguousarray(x[:, a : a + 8]) for a in range(0, 64, 8)]
    order = np.argsort(((x - x[0]) ** 2).sum(1))
    some = order[np.argsort(order % 7, kind="stable")]
    kept, limit, read = nearest.scan(columns, some[some != 0], x[0], 10, 1.5, 200, np.inf)
    near = set(order[1:11].tolist())
    assert len(near & set(kept.tolist())) == 10 and read < 0.6 * 3000 * 64
    again, same, less = nearest.scan(columns, some[some != 0], x[0], 10, 1.5, 200, limit)
    assert same == limit and less < read and len(near & set(again.tolist())) == 10


def test_ranges():
    assert nearest.ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    random.seed(1)


def test_memory_of_comparing_with_many_centroids():
    """10,000 points and 4,096 centroids in slices: the whole table of distances would take 330 MB."""
    import tracemalloc

    import numpy as np
    from casefile.llm import vectors

    rng = np.random.default_rng(1)
    points, centroids = rng.normal(size=(10_000, 16)), rng.normal(size=(4096, 16))
    norms = (centroids**2).sum(1)
    tracemalloc.start()
    own, cost = vectors.nearest_centroid(points, centroids, norms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    plain = norms - 2 * points[:500] @ centroids.T
    assert (own[:500] == plain.argmin(1)).all() and np.allclose(cost[:500], plain.min(1))
    assert vectors.nearest_centroid(points[:0], centroids, norms)[0].shape == (0,)
