"""Queries of the evidence ledger and of the evidence behind links."""

from __future__ import annotations

from pyspark.sql import functions as F

from casefile.operators import evidence
from casefile.plans.registry import dec_sum, query
from casefile.session import table, work_dir

MODULES = ("q_bank", "q_trail", "q_scan", "q_chat", "q_voice")
RELATIONS = ("TRANSFERRED_FUNDS", "CONDUIT_TO", "PARTNER", "EMAILED", "MENTIONED_IN")
SQL_MODULE = "[" + ", ".join(f"'{m}'" for m in MODULES) + "]"
SQL_RELATION = "[" + ", ".join(f"'{m}'" for m in RELATIONS) + "]"
EDGES = f"""e AS (SELECT c_custkey AS edge_id, c_custkey % 50 AS src, c_nationkey AS dst, {SQL_RELATION}[1 + c_custkey % 5] AS relation, {SQL_MODULE}[1 + c_custkey // 5 % 5] AS module, round(c_acctbal) AS weight FROM customer)"""


def pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def edges(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("edge_id"), (k % 50).alias("src"), F.col("c_nationkey").cast("long").alias("dst"), pick(RELATIONS, k % 5).alias("relation"), pick(MODULES, F.floor(k / 5) % 5).alias("module"), F.round("c_acctbal").alias("weight"))


@query(
    f"""WITH f AS (SELECT o_custkey % 97 AS src, o_custkey % 31 AS dst, {SQL_RELATION}[1 + o_orderkey % 5] AS relation, {SQL_MODULE}[1 + o_custkey % 5] AS module, o_orderkey // 3 AS ev, round(o_totalprice) AS w, (o_orderkey % 9) / 10.0 AS conf FROM orders),
    g AS (SELECT src, dst, relation, module, ev, CASE WHEN count(*) FILTER (o = 0) > 0 THEN max(w) FILTER (o = 0) ELSE max(w) END AS w, CASE WHEN count(*) FILTER (o = 0) > 0 THEN max(conf) FILTER (o = 0) ELSE max(conf) END AS conf
    FROM (SELECT *, CASE WHEN ev % 2 = 0 THEN 0 ELSE 1 END AS o FROM f) GROUP BY ALL)
    SELECT src, dst, relation, module, {dec_sum('w')} AS weight, CAST(max(conf) AS DOUBLE) AS confidence, count(*) AS evidence, 0 AS repeated FROM g GROUP BY 1, 2, 3, 4"""
)
def ledger_sync(spark, d):
    """Half of the findings, all of them, and all once more: the last batch finds nothing new."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    found = table(spark, d, "orders").select(
        (c % 97).alias("src"), (c % 31).alias("dst"), pick(RELATIONS, k % 5).alias("relation"), pick(MODULES, c % 5).alias("module"), F.floor(k / 3).cast("string").alias("evidence_id"), F.round("o_totalprice").alias("weight"), ((k % 9) / 10.0).alias("confidence")
    )
    folder = work_dir(spark, "ledger")
    evidence.synchronise(spark, folder, found.filter("cast(evidence_id as long) % 2 = 0"), "one", 8)
    evidence.synchronise(spark, folder, found, "two", 8)
    again = evidence.synchronise(spark, folder, found, "three", 8)
    return evidence.edges_of(spark, folder).drop("bucket").withColumn("repeated", F.lit(again["records"] + again["buckets"]))


LINKS = """w AS (SELECT DISTINCT 'kw__' || (c_custkey % 60) || '__' || c_nationkey || '__x' AS link FROM customer UNION ALL SELECT c_custkey || ', ' || (c_custkey + 50) || ',none' FROM customer WHERE c_custkey % 4 = 0),
    m AS (SELECT DISTINCT link, edge_id FROM (SELECT link, unnest(string_split(link, ',')) AS p FROM w WHERE NOT contains(link, '__')) JOIN e ON e.edge_id = TRY_CAST(trim(p) AS BIGINT)
    UNION SELECT link, edge_id FROM (SELECT link, CAST(split_part(link, '__', 2) AS BIGINT) AS x, CAST(split_part(link, '__', 3) AS BIGINT) AS y FROM w WHERE contains(link, '__')) JOIN e ON (src = x AND dst = y) OR (src = y AND dst = x))"""


def wanted(spark, d):
    k = F.col("c_custkey")
    customers = table(spark, d, "customer")
    made = customers.select(F.concat(F.lit("kw__"), (k % 60).cast("string"), F.lit("__"), F.col("c_nationkey").cast("string"), F.lit("__x")).alias("link")).distinct()
    return made.unionByName(customers.filter("c_custkey % 4 = 0").select(F.concat(k.cast("string"), F.lit(", "), (k + 50).cast("string"), F.lit(",none")).alias("link")))


@query(
    f"""WITH {EDGES}, {LINKS}, r AS (SELECT o_orderkey // 2 AS evidence_id, o_custkey AS edge_id, {SQL_MODULE}[1 + o_orderkey % 5] AS module, min('order ' || (o_orderkey // 2)) AS summary, max(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey * 2.0 END) AS amount FROM orders GROUP BY 1, 2, 3),
    c AS (SELECT link, CASE WHEN module IN ('q_verify', 'q_scan') OR relation IN ('PARTNER', 'MENTIONED_IN') THEN 'DOCUMENT' WHEN module = 'q_voice' OR contains(relation, 'VOICE') THEN 'VOICE' WHEN module = 'q_chat' THEN 'CHAT' ELSE 'FINANCIAL' END AS category
    FROM m JOIN e USING (edge_id) QUALIFY row_number() OVER (PARTITION BY link ORDER BY edge_id) = 1)
    SELECT DISTINCT link, CAST(evidence_id AS BIGINT) AS evidence_id, first_edge AS edge_id, category, summary, CAST(coalesce(amount, weight) AS DOUBLE) AS amount
    FROM (SELECT *, min(edge_id) OVER (PARTITION BY link, evidence_id) AS first_edge FROM m JOIN r USING (edge_id)) x JOIN e USING (edge_id) JOIN c USING (link) WHERE edge_id = first_edge"""
)
def link_evidence(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    records = table(spark, d, "orders").select(F.floor(k / 2).cast("long").alias("evidence_id"), c.alias("edge_id"), pick(MODULES, k % 5).alias("module"), F.concat(F.lit("order "), F.floor(k / 2).cast("string")).alias("summary"), F.when(c % 3 != 0, c * 2.0).alias("amount"))
    return evidence.evidence_of(wanted(spark, d), edges(spark, d), records).drop("module")


@query(
    f"""WITH {EDGES}, {LINKS}, s AS (SELECT link, count(*) AS links, coalesce(sum(weight) FILTER (module = 'q_bank'), 0) AS b, coalesce(sum(weight) FILTER (module = 'q_trail'), 0) AS t, coalesce(sum(weight) FILTER (module NOT IN ('q_bank', 'q_trail')), 0) AS o FROM m JOIN e USING (edge_id) GROUP BY link)
    SELECT link, links, CAST(CASE WHEN b > 0 AND t > 0 THEN greatest(b, t) WHEN b > 0 OR t > 0 THEN b + t ELSE b + t + o END AS DOUBLE) AS weight FROM s"""
)
def link_weights(spark, d):
    return evidence.link_totals(wanted(spark, d), edges(spark, d))
