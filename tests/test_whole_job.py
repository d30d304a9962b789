"""Queries take all rows of their tables: expected values come from the tables themselves."""

from collections import Counter
from itertools import permutations

from casefile.operators import graph
from casefile.plans import registry, registry_cases, registry_names, views  # noqa: F401  (register their queries)
from casefile.session import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_every_line_is_scored(spark):
    lines = table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber")
    scored = registry.QUERIES["authenticity"](spark, SF)
    assert scored.count() == lines.count()
    assert lines.join(scored, ["l_orderkey", "l_linenumber"], "left_anti").count() == 0
    by_level = {r.level: r["count"] for r in scored.groupBy("level").count().collect()}
    assert {r.level: r.n for r in registry.QUERIES["risk_distribution"](spark, SF).collect()} == by_level
    low = {r.level: (r.low, r.worst) for r in scored.groupBy("level").agg(F.count_if(F.col("score") < 50).alias("low"), F.min("score").alias("worst")).collect()}
    assert {r.level: (r.low, r.worst) for r in registry.QUERIES["level_summary"](spark, SF).collect()} == low


def nation_flows(spark):
    """(src, dst): lines, straight from the tables."""
    of = {r.n_nationkey: r.n_name for r in table(spark, SF, "nation").collect()}
    lines = table(spark, SF, "lineitem").join(table(spark, SF, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, SF, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, SF, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return {(of[r.s_nationkey], of[r.c_nationkey]): r["count"] for r in lines.groupBy("s_nationkey", "c_nationkey").count().collect()}


def test_edges_cross_regions_and_join_a_nation_to_itself(spark):
    want = nation_flows(spark)
    matrix = {(r.sender, r.recipient): r.transfers for r in registry.QUERIES["pair_matrix"](spark, SF).collect()}
    assert len(matrix) == 625 and {k: n for k, n in matrix.items() if n} == want
    assert any(a == b for a, b in want)
    pairs = {tuple(sorted(k)) for k in want}
    assert tuple(registry.QUERIES["unordered_pairs"](spark, SF).first()) == (len(pairs), len(want))
    merged = {(r.a, r.b): r.evidence for r in registry.QUERIES["merged_edges"](spark, SF).collect()}
    assert merged == {(a, b): want.get((a, b), 0) + (want.get((b, a), 0) if a != b else 0) for a, b in pairs}
    trips = {(r.a, r.b) for r in registry.QUERIES["round_trips"](spark, SF).collect()}
    assert trips == {(a, b) for a, b in want if a != b and (b, a) in want}
    assert registry.QUERIES["sankey"](spark, SF).count() == len(want)


def test_case_graph_walks_all_edges(spark):
    near = {}
    for a, b in nation_flows(spark):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ring = {"NATION_1": 0, "NATION_8": 0}
    for h in (1, 2):
        for node in {b for a in list(ring) for b in near.get(a, ())}:
            ring.setdefault(node, h)
    assert {r.node: r.ring for r in registry.QUERIES["case_graph"](spark, SF).collect()} == ring


def test_all_vendors_names_and_amounts_count(spark):
    hundred = SF.replace("0.001", "0.01")
    sums = {r.cost_ctr: float(r.s) for r in views.prpo(spark, hundred).groupBy("cost_ctr").agg(F.sum(F.col("amount_lc").cast("decimal(18,2)")).alias("s")).collect()}
    assert {r.cost_ctr: r.amount for r in registry.QUERIES["top_sloc"](spark, hundred).collect()} == sums
    txns = {r.txn_id: (r.party, max(r.debit, r.credit), r.narration) for r in views.txn(spark, SF).collect()}
    got = {r.txn_id: r.person for r in registry.QUERIES["one_sided_match"](spark, SF).collect()}
    assert got == {k: party for k, (party, amount, _) in txns.items() if amount >= 1000}
    linked = {r.txn_id for r in registry.QUERIES["worth_linking"](spark, SF).collect()}
    assert linked == {k for k, (party, amount, text) in txns.items() if amount >= 50_000 or "NATION_2" in party or "@okbank/1-" in text}


def test_cycles_paths_and_neighbours_on_all_region_edges(spark):
    hundred = SF.replace("0.001", "0.01")
    e = {(r.src, r.dst) for r in views.region_edge(spark, hundred).select("src", "dst").collect()}
    nodes = sorted({a for a, _ in e})
    groups = [[b for b in nodes if b == a or (a, b) in e or (b, a) in e] for a in nodes]
    rings = {p for g in groups for n in range(2, 6) for p in permutations(g, n) if p[0] == min(p) and all(x in e for x in zip(p, p[1:] + p[:1], strict=True))}
    got = {(r.members, r.nodes) for r in registry.QUERIES["cycles"](spark, hundred).collect()}
    assert got == {(",".join(sorted(p)), len(p)) for p in rings} and max(n for _, n in got) == 5
    first = {b for a, b in e | {(b, a) for a, b in e} if a == "NATION_0"}
    second = {b for a, b in e | {(b, a) for a, b in e} if a in first} - first - {"NATION_0"}
    want = {("NATION_0", 0)} | {(b, 1) for b in first} | {(b, 2) for b in second}
    assert {tuple(r) for r in registry.QUERIES["bfs"](spark, hundred).collect()} == want
    ways = Counter(a for x in e for a in (x, x[::-1]))
    walks = Counter()
    for n in range(4):
        for mid in permutations([x for x in nodes if x not in ("NATION_0", "NATION_10")], n) if n < 3 else ():
            p = ("NATION_0", *mid, "NATION_10")
            count = 1
            for x in zip(p, p[1:], strict=False):
                count *= ways[x]
            if count:
                walks[">".join(p)] += count
    assert Counter(r.path for r in registry.QUERIES["paths"](spark, hundred).collect()) == walks and walks


def test_paths_use_edges_both_ways_and_parallel_ones(spark):
    rows = [(1, "A", "B", 0.9), (2, "B", "A", 0.4), (3, "C", "B", 0.5), (4, "B", "C", 0.1), (5, "D", "A", 0.2)]
    e = spark.createDataFrame(rows, "id int, s string, d string, c double")
    got = [(r.path, r.length, tuple(r.edges)) for r in graph.paths(e, "s", "d", "A", "C", 3, F.col("id")).collect()]
    assert sorted(got) == [("A>B>C", 2, (x, y)) for x in "12" for y in "34"]
    assert {tuple(r) for r in graph.neighbourhood(e, "s", "d", "A", 2, "c").collect()} == {("A", 0), ("B", 1), ("C", 2)}
