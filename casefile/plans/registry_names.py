"""Registered queries on names, tags, enrichment and trail summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casefile.functions import text as X
from casefile.operators import naming, procurement, trail
from casefile.plans import views
from casefile.plans.registry import CHAT, HOPS, chat_rows, dec_sum, hit_sql, hops, query
from casefile.session import table

PARTY = "CASE c_custkey % 6 WHEN 0 THEN 'Acme Traders Ltd' WHEN 1 THEN 'north motors' WHEN 2 THEN 'p.one@okbank' WHEN 3 THEN 'State Bank' WHEN 4 THEN 'OUT' ELSE c_name END"


def parties(spark, d):
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, "Acme Traders Ltd").when(k == 1, "north motors").when(k == 2, "p.one@okbank").when(k == 3, "State Bank").when(k == 4, "OUT").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", name.alias("party"), F.when(F.col("c_custkey") % 17 == 0, "SAL/Employer House/1").otherwise("UPI").alias("narration"))


@query(
    f"""SELECT c_custkey, CASE WHEN contains(lower(party), '@') THEN 'EMAIL_ID' WHEN contains(lower(party), 'motors') OR c_custkey % 17 = 0 THEN 'COMPANY' WHEN contains(lower(party), 'ltd') THEN 'VENDOR'
    WHEN contains(lower(party), 'bank') THEN 'BANK_ACCOUNT' WHEN lower(party) = 'out' THEN 'UNKNOWN' ELSE 'EMPLOYEE' END AS kind, CASE WHEN c_custkey % 17 = 0 THEN 'Employer House' ELSE party END AS counterparty FROM (SELECT c_custkey, {PARTY} AS party FROM customer)"""
)
def party_kinds(spark, d):
    rows = parties(spark, d)
    return rows.select("c_custkey", naming.kind_of_party(F.col("party"), F.col("narration")).alias("kind"), naming.counterparty(F.col("party"), F.col("narration")).alias("counterparty"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'JOHN DOE' WHEN 1 THEN 'SUPPLY HOUSE' WHEN 2 THEN 'RESTAURANT CORNER' ELSE 'Internal Transfer' END AS name FROM orders")
def tracking_names(spark, d):
    key = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 4
    n = F.when(k == 0, F.concat(F.lit("UPI/"), key, F.lit("/john.doe@okbank/pay"))).when(k == 1, F.concat(F.lit("NEFT/"), key, F.lit("/Supply  House/HDFC0001234"))).when(k == 2, F.concat(F.lit("POS "), key, F.lit(" restaurant corner"))).otherwise("  ")
    return table(spark, d, "orders").select("o_orderkey", naming.tracking_name(n).alias("name"))


@query("SELECT txn_id, greatest(debit, credit) AS amount FROM txn WHERE greatest(debit, credit) >= 50000 OR contains(lower(party), 'nation_2') OR contains(narration, '@okbank/1-')", (views.TXN,))
def worth_linking(spark, d):
    rows = views.txn(spark, d).withColumn("amount", F.greatest("debit", "credit")).withColumn("risk", F.when(F.col("narration").contains("@okbank/1-"), 60).otherwise(0))
    return naming.worth_linking(rows, ["NATION_2", "x"], "amount", "risk", "party", "narration").select("txn_id", "amount")


CLASSES = (("suspicious", ("que", "burn")), ("financial", ("la", "que", "the")), ("identity", ("of", "und")))


@query(" UNION ALL ".join(f"SELECT conv_id, turn, '{w.upper()}' AS term, '{k}' AS type FROM conversations WHERE {hit_sql(w)}" for w, k in (("que", "suspicious"), ("burn", "suspicious"), ("la", "financial"), ("the", "financial"), ("of", "identity"), ("und", "identity"))))
def voice_tags(spark, d):
    return naming.tags(table(spark, d, "conversations"), ["conv_id", "turn"], "text", CLASSES)


@query("SELECT s_suppkey, s_name, 3 AS match_rank FROM supplier WHERE contains(lower(s_name), '00001') ORDER BY s_name LIMIT 1")
def find_entity(spark, d):
    rows = table(spark, d, "supplier").withColumn("identifier", F.col("s_suppkey").cast("string")).withColumn("alias", F.lit(None).cast("string"))
    return naming.find_entity(rows, " 00001 ", "s_name").select("s_suppkey", "s_name", "match_rank")


@query(
    """WITH k AS (SELECT DISTINCT w AS entity FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT unnest(['the', 'that', 'with'])) WHERE length(w) >= 3),
    t AS (SELECT DISTINCT conv_id, turn, unnest(string_split_regex(lower(text), '[^\\pL\\pN_]+')) AS token FROM conversations)
    SELECT conv_id, turn, entity, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(entity) DESC, entity) AS place FROM t JOIN k ON token = entity"""
)
def names_in_texts(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).unionByName(spark.createDataFrame([("the",), ("that",), ("with",)], "w string"))
    texts = table(spark, d, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    out = naming.names_in_texts(texts, "id", "text", words, "w")
    return out.select("id.conv_id", "id.turn", "entity", "place")


@query("SELECT o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 'vendor_flow' WHEN o_orderpriority LIKE '2%' THEN 'layering' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
def relation_kinds(spark, d):
    label = F.when(F.col("o_orderpriority").startswith("1"), "KICKBACK").when(F.col("o_orderpriority").startswith("2"), "RAPID_LAYERING").otherwise("x")
    return table(spark, d, "orders").withColumn("kind", naming.relation_kind(label, F.lit(""))).groupBy("o_orderpriority", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'none - Not Applicable' ELSE c_nationkey || ' - ' || coalesce(CASE WHEN n_nationkey < 20 THEN n_name END, 'Not Applicable') END AS nation_label FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def master_enrichment(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")).alias("nation"))
    return naming.enrich(rows, [(table(spark, d, "nation").filter("n_nationkey < 20"), "nation", "n_nationkey", "n_name")]).select("c_custkey", "nation_label")


@query(f"SELECT cost_ctr, {dec_sum('amount_lc')} AS amount FROM prpo GROUP BY cost_ctr ORDER BY amount DESC, cost_ctr LIMIT 5", (views.PRPO,))
def top_sloc(spark, d):
    return procurement.top_by_amount(views.prpo(spark, d), "cost_ctr", "amount_lc")


@query(HOPS + f" SELECT count(*) AS hops, count(DISTINCT account) AS conduits, {dec_sum('out_amount')} AS volume, {dec_sum('retained')} AS retained, count(*) FILTER (tier = 'RAPID_LAYERING') AS rapid, min(gap_seconds) AS fastest FROM hops", (views.FLOW,))
def trail_metrics(spark, d):
    h = hops(spark, d)
    return h.agg(
        F.count(F.lit(1)).alias("hops"), F.count_distinct("account").alias("conduits"), procurement.total("out_amount").alias("volume"), procurement.total("retained").alias("retained"),
        F.count_if(F.col("tier") == "RAPID_LAYERING").alias("rapid"), F.min("gap_seconds").alias("fastest"),
    )


@query(HOPS + " SELECT account, count(*) AS hops, row_number() OVER (ORDER BY count(*) DESC, account) AS rank FROM hops WHERE retained_pct > 10 GROUP BY account ORDER BY rank LIMIT 20", (views.FLOW,))
def conduit_deck(spark, d):
    out = hops(spark, d).filter("retained_pct > 10").groupBy("account").agg(F.count(F.lit(1)).alias("hops"))
    top = out.orderBy(F.desc("hops"), "account").limit(20)
    return top.withColumn("rank", F.row_number().over(trail.Window.orderBy(F.desc("hops"), "account")))


@query("SELECT role, count(*) AS flagged FROM chat WHERE risk_score >= 50 GROUP BY role ORDER BY flagged DESC, role LIMIT 6", (CHAT,))
def top_flagged_senders(spark, d):
    return chat_rows(spark, d).filter("risk_score >= 50").groupBy("role").agg(F.count(F.lit(1)).alias("flagged")).orderBy(F.desc("flagged"), "role").limit(6)


@query("SELECT doc_id, CASE WHEN n_chars >= 1024 THEN ((n_chars * 200 + 1024) // 2048) / 100.0 ELSE n_chars END AS kb FROM documents")
def size_in_kb(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.when(n >= 1024, X.half_up(n, 1024, 2)).otherwise(n.cast("double")).alias("kb"))


@query("SELECT account, count(*) AS loops FROM (SELECT l_suppkey % 100 AS account, o_custkey % 100 AS other FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE account = other GROUP BY account")
def self_loops(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_suppkey") % 100).alias("account"), (F.col("o_custkey") % 100).alias("other"))
    return rows.filter(F.col("account") == F.col("other")).groupBy("account").agg(F.count(F.lit(1)).alias("loops"))
