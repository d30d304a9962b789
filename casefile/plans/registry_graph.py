"""Registered queries on the relationship graph and on names in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from casefile.operators import entities, graph
from casefile.plans import views
from casefile.plans.registry import dec_sum, query
from casefile.session import table

# Orders as edges from customer nations to their neighbours by number, with relations, modules and weights of every kind.
LINKS = """links AS (SELECT o_orderkey AS edge_id, c_nationkey AS src, (c_nationkey + o_orderkey % 7) % 25 AS dst,
    CASE o_orderkey % 9 WHEN 0 THEN 'VENDOR_PAYOUT_DETECTED' WHEN 1 THEN 'SPOUSE' WHEN 2 THEN 'ROLE_IN' WHEN 3 THEN 'EMAILED' WHEN 4 THEN 'RAPID_LAYERING' WHEN 5 THEN 'CONDUIT_TO' ELSE 'TRANSFERRED_FUNDS' END AS relation,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'L' || o_orderkey % 4 END AS label, CASE o_orderkey % 4 WHEN 0 THEN 'q_bank' WHEN 1 THEN 'q_trail' WHEN 2 THEN 'q_mail' ELSE 'Q_LEDGER' END AS module,
    round(o_totalprice) AS weight, (o_orderkey % 10) / 10.0 AS confidence, CAST(o_orderkey % 3 AS INTEGER) AS evidence, o_orderkey % 9 = 4 AS layering FROM orders JOIN customer ON o_custkey = c_custkey)"""


def links(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    nine, four = k % 9, k % 4
    relation = F.when(nine == 0, "VENDOR_PAYOUT_DETECTED").when(nine == 1, "SPOUSE").when(nine == 2, "ROLE_IN").when(nine == 3, "EMAILED").when(nine == 4, "RAPID_LAYERING").when(nine == 5, "CONDUIT_TO").otherwise("TRANSFERRED_FUNDS")
    return rows.select(
        k.alias("edge_id"), F.col("c_nationkey").alias("src"), ((F.col("c_nationkey") + k % 7) % 25).alias("dst"), relation.alias("relation"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("L"), four.cast("string"))).alias("label"),
        F.when(four == 0, "q_bank").when(four == 1, "q_trail").when(four == 2, "q_mail").otherwise("Q_LEDGER").alias("module"),
        F.round("o_totalprice").alias("weight"), (k % 10 / 10).alias("confidence"), (k % 3).cast("int").alias("evidence"), (nine == 4).alias("layering"),
    )


def in_list(c: str, names: tuple[str, ...]) -> str:
    return f"{c} IN ({', '.join(repr(n) for n in names)})"


MERGED = f""", r AS (SELECT *, CAST({in_list('relation', graph.VENDOR_FLOWS)} AS INTEGER) AS v, CAST({in_list('relation', graph.KINSHIP)} AS INTEGER) AS k, CAST({in_list('relation', graph.ROLES)} AS INTEGER) AS o, CAST(layering AS INTEGER) AS l FROM links),
    t AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(edge_id, (v, k, o, l, weight, confidence, evidence, -edge_id)) AS first, {dec_sum(f"CASE WHEN {in_list('lower(module)', graph.BANK_MODULES)} THEN weight END")} AS wb,
    {dec_sum(f"CASE WHEN {in_list('lower(module)', graph.TRAIL_MODULES)} THEN weight END")} AS wt, {dec_sum(f"CASE WHEN NOT {in_list('lower(module)', graph.BANK_MODULES + graph.TRAIL_MODULES)} THEN weight END")} AS wo, max(weight) AS most, max(confidence) AS confidence,
    CAST(sum(evidence) AS BIGINT) AS evidence, bool_or(layering) AS layering, count(DISTINCT src) > 1 AS both_ways, count(*) AS links, array_to_string(list_sort(list_distinct(list(module))), ',') AS modules FROM r GROUP BY 1, 2),
    n AS (SELECT t.*, e.src, e.dst, e.relation, coalesce(nullif(e.label, ''), e.relation, 'Connected') AS name FROM t JOIN links e ON e.edge_id = t.first)"""


@query(
    MERGED
    + f""" SELECT a, b, src, dst, relation, CASE WHEN links = 1 OR {in_list('relation', graph.VENDOR_FLOWS)} THEN name WHEN both_ways THEN name || ' ⇄ (' || links || ' Links)' ELSE name || ' + ' || (links - 1) || ' Links' END AS label,
    CASE WHEN links = 1 THEN most WHEN coalesce(wb, 0) > 0 AND coalesce(wt, 0) > 0 THEN greatest(wb, wt) WHEN coalesce(wb, 0) > 0 OR coalesce(wt, 0) > 0 THEN coalesce(wb, 0) + coalesce(wt, 0) WHEN coalesce(wo, 0) <> 0 THEN wo ELSE most END AS weight,
    confidence, evidence, layering, both_ways, links, modules FROM n""",
    (LINKS,),
)
def merged_links(spark, d):
    return graph.merge_edges(links(spark, d))


KIND = "CASE n_nationkey % 3 WHEN 0 THEN 'EMPLOYEE' WHEN 1 THEN 'VENDOR' ELSE 'COMPANY' END"
ALERTS = f""", x AS (SELECT n_nationkey AS id, n_name AS name, {KIND} AS type FROM nation), u AS (SELECT src AS entity, dst AS other, module FROM links UNION ALL SELECT dst, src, module FROM links),
    alert AS (SELECT entity, 'Multi-Tool Cross Correlation: ' || name AS title, 'HIGH' AS level, 85 AS risk, NULL AS related FROM u JOIN x ON id = entity GROUP BY entity, name HAVING count(DISTINCT module) >= 3
    UNION ALL SELECT DISTINCT src, 'Employee-Vendor Nexus: ' || a.name || ' <-> ' || b.name, 'CRITICAL', 95, CAST(b.id AS VARCHAR) FROM links JOIN x a ON a.id = src JOIN x b ON b.id = dst WHERE a.type = 'EMPLOYEE' AND b.type = 'VENDOR' AND {in_list('relation', graph.FUNDS_OR_MAIL)}
    UNION ALL SELECT DISTINCT entity, 'Nexus with Substantiated Target: ' || a.name || ' <-> ' || lower(b.name), 'CRITICAL', 95, CAST(b.id AS VARCHAR) FROM u JOIN x a ON a.id = entity JOIN x b ON b.id = other JOIN region ON 'NATION_' || r_regionkey = b.name)"""


def relation_entities(spark, d):
    k = F.col("n_nationkey")
    kind = F.when(k % 3 == 0, "EMPLOYEE").when(k % 3 == 1, "VENDOR").otherwise("COMPANY")
    return table(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("name"), kind.alias("type"), (k % 2 == 0).alias("target"), (k % 8 * 10).cast("int").alias("risk"))


def found_alerts(spark, d):
    known = table(spark, d, "region").select(F.concat(F.lit("nation_"), F.col("r_regionkey").cast("string")).alias("name"))
    return graph.alerts(relation_entities(spark, d), links(spark, d), known)


@query(ALERTS + " SELECT * FROM alert", (LINKS,))
def relation_alerts(spark, d):
    return found_alerts(spark, d)


@query(
    ALERTS
    + f""", k AS (SELECT entity, max(kind) AS kind FROM (SELECT unnest([src, dst]) AS entity, CASE WHEN relation = 'RAPID_LAYERING' OR layering THEN 3 WHEN {in_list('relation', graph.NEAR_RELATIONS)} THEN 2 WHEN relation = 'TRANSFERRED_FUNDS' AND weight >= 500000 THEN 1 ELSE 0 END AS kind FROM links) GROUP BY entity)
    SELECT n_nationkey AS id, CAST(greatest(n_nationkey % 8 * 10, coalesce((SELECT max(risk) FROM alert WHERE alert.entity = n_nationkey), 0),
    CASE k.kind WHEN 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 80 ELSE 72 END WHEN 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 75 ELSE 65 END WHEN 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 70 ELSE 60 END ELSE 0 END) AS INTEGER) AS risk FROM nation LEFT JOIN k ON k.entity = n_nationkey""",
    (LINKS,),
)
def relation_risk(spark, d):
    return graph.raised_risk(relation_entities(spark, d), links(spark, d), found_alerts(spark, d))


@query(
    """, t AS (SELECT txn_id, CASE WHEN credit > 0 THEN 'IN' ELSE 'OUT' END AS direction, CAST(txn_id % 10 * 10 AS INTEGER) AS risk_score, CASE WHEN txn_id % 10 >= 7 THEN 'High' ELSE 'Low' END AS risk_level, CASE WHEN txn_id % 4 = 0 THEN 'cash' ELSE '' END AS reason,
    regexp_replace(holder, '[^0-9]', '', 'g') AS k FROM txn), v AS (SELECT regexp_replace(s_name, '[^0-9]', '', 'g') AS k, min(s_name) AS vendor FROM supplier GROUP BY 1),
    j AS (SELECT t.*, vendor, CASE WHEN direction = 'IN' THEN 95 ELSE 90 END AS least FROM t LEFT JOIN v USING (k)), h AS (SELECT *, vendor IS NOT NULL AND (risk_score < least OR risk_level <> 'High') AS hit,
    CASE WHEN direction = 'IN' THEN 'Suspected Vendor Kickback from ' ELSE 'Undisclosed Vendor Payment to ' END || chr(39) || vendor || chr(39) || ' (number)' AS said FROM j)
    SELECT txn_id, direction, CASE WHEN hit THEN greatest(risk_score, least) ELSE risk_score END AS risk_score, CASE WHEN hit THEN 'High' ELSE risk_level END AS risk_level, CASE WHEN hit THEN CASE WHEN reason <> '' THEN reason || ' | ' || said ELSE said END ELSE reason END AS reason FROM h""",
    (views.TXN,),
)
def vendor_flow_risk(spark, d):
    key, digits = F.col("txn_id"), lambda c: F.regexp_replace(c, "[^0-9]", "")
    rows = views.txn(spark, d).select(
        "txn_id", F.when(F.col("credit") > 0, "IN").otherwise("OUT").alias("direction"), (key % 10 * 10).cast("int").alias("risk_score"), F.when(key % 10 >= 7, "High").otherwise("Low").alias("risk_level"),
        F.when(key % 4 == 0, "cash").otherwise("").alias("reason"), digits("holder").alias("k"),
    )
    vendors = table(spark, d, "supplier").select(digits("s_name").alias("k"), F.col("s_name").alias("vendor_name"), F.lit("number").alias("attributes"))
    return graph.raise_vendor_flows(rows.drop("k"), rows.select("txn_id", "k").join(vendors, "k"), "txn_id")


@query(
    """WITH e AS (SELECT DISTINCT c_custkey AS id, unnest([lower(c_mktsegment) || (c_custkey % 40), 'n' || c_nationkey || '-' || (c_custkey % 30)]) AS k FROM customer), f AS (SELECT * FROM e WHERE length(k) >= 3)
    SELECT k, id, members FROM f JOIN (SELECT k, count(*) AS members FROM f GROUP BY k HAVING count(*) >= 2) USING (k)"""
)
def keyword_circles(spark, d):
    key = F.col("c_custkey")
    words = F.array(F.concat(F.lower("c_mktsegment"), (key % 40).cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("-"), (key % 30).cast("string")))
    return graph.keyword_members(table(spark, d, "customer").select("c_custkey", words.alias("keywords")), "c_custkey", "keywords")


SENTENCES = (
    "Shri Venkatesan C, aged 40 is here. ", "wife of Mr. S Maharajan came. ", "Please call Suresh about it. ", "ARR Enterprises Ltd paid ravi.k@okaxis today. ", "nominee is J. Silviya. Silviya came. ",
    "1. Dhanasekaran, aged 50 and report.pdf with +91 9876543210. ", "Meeting Room and Main Road call Monday. ",
)


def sentences(spark, d):
    """Documents with sentences that name people and firms before their own text."""
    said = F.concat(*[F.when(F.col("doc_id") % (i + 2) == 0, s).otherwise("") for i, s in enumerate(SENTENCES)], F.col("text"))
    return table(spark, d, "documents").select("doc_id", said.alias("said"))


@query()
def entity_names(spark, d):
    profiles = spark.createDataFrame([("Suresh",), ("ARR Enterprises",)], "name string")
    return entities.names_of(sentences(spark, d), "doc_id", "said", keywords=spark.createDataFrame([("maharajan",)], "name string"), profiles=profiles)


@query(
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'EMAIL:a.' || c_custkey || '@x.y' WHEN 1 THEN 'ACC:AB' || c_custkey || '7' WHEN 2 THEN 'PHONE:91' || c_custkey WHEN 3 THEN 'PO:P' || c_custkey WHEN 4 THEN 'INV:I' || c_custkey ELSE 'VENDOR:ACME ' || c_custkey END AS identifier FROM customer"""
)
def entity_identifiers(spark, d):
    k, n = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit(" A."), n, F.lit("@X.y "))).when(k == 1, F.concat(F.lit("ab "), n, F.lit("-7"))).when(k == 2, F.concat(F.lit("+91 ("), n, F.lit(")"))).when(k == 3, F.concat(F.lit("p "), n))
        .when(k == 4, F.concat(F.lit("i "), n)).otherwise(F.concat(F.lit("Acme "), n, F.lit(" Pvt Ltd")))
    )
    kind = F.when(k == 0, "email_id").when(k == 1, "BANK_ACCOUNT").when(k == 2, "PHONE").when(k == 3, "PO").when(k == 4, "INVOICE").otherwise("VENDOR")
    return table(spark, d, "customer").select("c_custkey", entities.identifier(name, kind).alias("identifier"))
