"""More registered queries: grids, profiles, corroboration, suggestions, case graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from casefile.operators import cases, grid
from casefile.plans import views
from casefile.plans.registry import CHAT, HOPS, META, SCORE, chat_rows, dec_sum, hops, query, scored, scored_documents
from casefile.session import table


@query(f"SELECT txn_id, s AS risk_score FROM (SELECT txn_id, txn_date, holder, party, least(100, {SCORE}) AS s FROM txn) WHERE s >= 40 AND s < 70 AND CAST(txn_date AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND (contains(lower(holder), '00') OR contains(lower(party), '1'))", (views.TXN,))
def bank_grid_filter(spark, d):
    keep = grid.risk_band("risk_score", "medium") & grid.within_days("txn_date", "1995-01-01", "1996-06-30")
    return scored(spark, d).filter(keep & (grid.contains_any(["holder"], "00") | grid.contains_any(["party"], "1"))).select("txn_id", "risk_score")


@query(
    """SELECT s_suppkey, s_name, row, total, last_page, page FROM (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS row, count(*) OVER () AS total,
    CAST(greatest(1, ceil(count(*) OVER () / 7.0)) AS INTEGER) AS last_page, CAST(least(999, greatest(1, ceil(count(*) OVER () / 7.0))) AS INTEGER) AS page FROM supplier) WHERE row > (page - 1) * 7 AND row <= page * 7"""
)
def vendor_grid_last_page(spark, d):
    return grid.page_of(table(spark, d, "supplier"), [F.desc("s_acctbal"), F.asc("s_suppkey")], 999, 7).select("s_suppkey", "s_name", "row", "total", "last_page", "page")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000 AND (contains(lower(s_name), '1') OR contains(CAST(s_nationkey AS VARCHAR), '2')) ORDER BY s_acctbal DESC, s_suppkey LIMIT 200")
def vendor_directory(spark, d):
    named = grid.contains_any(["s_name"], "1") | grid.contains_any(["s_nationkey"], "2")
    rows = table(spark, d, "supplier").filter((F.col("s_acctbal") > 5000) & named)
    return rows.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(200).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT page_id FROM pages WHERE NOT (starts_with(lower(url), 'http://m.') OR list_contains(string_split(lower(url), '/'), 'de') OR regexp_extract(lower(url), '(\\.[^./]+)$', 1) = '.html')")
def path_exclusion(spark, d):
    return table(spark, d, "pages").filter(~grid.excluded_path("url", [], ["de"], [".html"]) & ~F.lower("url").startswith("http://m.")).select("page_id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS row, CASE WHEN role = 'user' THEN 'right' ELSE 'left' END AS side FROM conversations QUALIFY row <= 2")
def chat_page(spark, d):
    return grid.chat_page(table(spark, d, "conversations"), "conv_id", "turn", 2, F.col("role") == "user").select("conv_id", "turn", "row", "side")


@query("SELECT c_custkey, c_mktsegment || ',n' || c_nationkey AS keywords FROM customer")
def keyword_normalise(spark, d):
    raw = F.concat_ws(" , ", F.col("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lower("c_mktsegment"), F.lit(""), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return cases.normalise_keywords(table(spark, d, "customer").withColumn("raw", raw), "c_custkey", "raw").withColumn("keywords", F.array_join("keywords", ","))


@query(
    f"""SELECT txn_id, n_name AS person, CASE WHEN credit > 0 THEN 'IN' ELSE 'OUT' END AS direction, greatest(debit, credit) AS amount FROM txn JOIN nation ON lower(party) = lower(n_name)
    WHERE greatest(debit, credit) >= 1000""",
    (views.TXN,),
)
def one_sided_match(spark, d):
    # Names differ in their number only, so the number is the token that tells them apart.
    number = F.regexp_replace("party", "_", "")
    names = table(spark, d, "nation").select(F.regexp_replace("n_name", "_", "").alias("n_name"))
    got = cases.one_sided(views.txn(spark, d).withColumn("party", number), names, "n_name", "party", ["txn_id"])
    return got.withColumn("person", F.regexp_replace("person", "NATION", "NATION_"))


@query(
    """WITH p AS (SELECT DISTINCT upper(c_name) AS k, c_name FROM customer), s AS (SELECT DISTINCT upper('Customer#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) AS w, 'ledger' AS source FROM lineitem
    UNION SELECT DISTINCT upper('Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')), 'events' FROM events UNION SELECT DISTINCT upper('Customer#' || lpad(CAST(doc_id AS VARCHAR), 9, '0')), 'verify' FROM labels)
    SELECT c_name, array_to_string(list_sort(list(source)), ',') AS sources, count(*) AS n, count(*) >= 2 AS badge FROM p JOIN s ON k = w GROUP BY c_name"""
)
def corroboration(spark, d):
    who = lambda c: F.concat(F.lit("customer#"), F.lpad(F.col(c).cast("string"), 9, "0"))
    sources = {"ledger": (table(spark, d, "lineitem"), who("l_suppkey")), "events": (table(spark, d, "events"), who("user_id")), "verify": (table(spark, d, "labels"), who("doc_id"))}
    return cases.corroborate(table(spark, d, "customer"), "c_name", sources)


@query(
    HOPS + f""", k AS (SELECT account, {dec_sum('out_amount')} AS volume, 'CONDUIT' AS kind, 85 AS score, 0 AS p FROM hops WHERE tier = 'RAPID_LAYERING' GROUP BY 1
    UNION ALL SELECT account, {dec_sum('out_amount')}, 'LAYERING', 75, 1 FROM hops GROUP BY 1 UNION ALL SELECT account, {dec_sum('amount')}, 'DIRECT', 60, 2 FROM flow GROUP BY 1)
    SELECT account, volume, kind, score FROM k QUALIFY row_number() OVER (PARTITION BY account ORDER BY p) = 1""",
    (views.FLOW,),
)
def suggestions(spark, d):
    h = hops(spark, d)
    return cases.suggest(views.flow(spark, d).select("account", "amount"), h.select("account", F.col("out_amount").alias("amount")), h.filter("tier = 'RAPID_LAYERING'").select("account", F.col("out_amount").alias("amount")), "account", "amount")


@query(
    """WITH f AS (SELECT o_custkey AS p, [o_custkey % 7, o_custkey % 11, o_custkey] AS s, o_orderpriority AS type, o_orderkey % 2 = 0 AS o, o_totalprice AS weight FROM orders), e AS (SELECT p, unnest(s) AS s, type, o, weight FROM f)
    SELECT CASE WHEN o THEN p ELSE s END AS src, CASE WHEN o THEN s ELSE p END AS dst, type, weight FROM e WHERE p <> s"""
)
def finding_edges(spark, d):
    key = F.col("o_custkey")
    rows = table(spark, d, "orders").select(key.alias("p"), F.array(key % 7, key % 11, key).alias("s"), F.col("o_orderpriority").alias("k"), (F.col("o_orderkey") % 2 == 0).alias("o"), F.col("o_totalprice").alias("w"))
    return cases.findings_to_edges(rows, "p", "s", "k", "o", "w")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey FROM orders ORDER BY day DESC, o_custkey DESC LIMIT 100")
def timeline(spark, d):
    return cases.timeline(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_custkey"), ["day", "o_custkey"])


@query("SELECT '1997-WB-' || CAST(max(CASE WHEN year(o_orderdate) = 1997 THEN o_orderkey % 90 END) + 1 AS VARCHAR) AS name FROM orders")
def next_case_number(spark, d):
    names = table(spark, d, "orders").select(F.concat(F.year("o_orderdate").cast("string"), F.lit("-WB-"), (F.col("o_orderkey") % 90).cast("string")).alias("name"))
    return cases.next_number(names, "name", 1997)


@query(
    """WITH f AS (SELECT 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS c_name, 'events' AS category, 0 AS p FROM events UNION SELECT 'Customer#' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), 'verify', 1 FROM documents)
    SELECT c_name, arg_min(category, p) AS category FROM f WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 3 = 0) GROUP BY c_name"""
)
def profile_back_fill(spark, d):
    who = lambda t, c: table(spark, d, t).select(F.concat(F.lit("Customer#"), F.lpad(F.col(c).cast("string"), 9, "0")).alias("c_name"))
    return cases.back_fill(table(spark, d, "customer").filter("c_custkey % 3 = 0"), "c_name", {"events": who("events", "user_id"), "verify": who("documents", "doc_id")})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    orders = table(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    return cases.delete_with_children(customers, orders, "k", customers.filter("c_acctbal < 0"))[1].select("o_orderkey", "o_custkey")


@query(
    """, u AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), t AS (SELECT n_name AS node FROM nation WHERE n_nationkey IN (1, 8)),
    n1 AS (SELECT DISTINCT b AS node FROM t JOIN u ON a = node), n2 AS (SELECT DISTINCT b AS node FROM n1 JOIN u ON a = node),
    r AS (SELECT node, min(ring) AS ring FROM (SELECT node, 0 AS ring FROM t UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2) GROUP BY node)
    SELECT node, CAST(ring AS INTEGER) AS ring, CAST(n_nationkey * 3 % 10 AS INTEGER) AS risk FROM r JOIN nation ON n_name = node ORDER BY (ring <> 0), risk DESC, node LIMIT 120""",
    (views.EDGE,),
)
def case_graph(spark, d):
    nations = table(spark, d, "nation").withColumn("name", F.col("n_name"))
    risk = nations.select("name", (F.col("n_nationkey") * 3 % 10).cast("int").alias("risk"))
    return cases.graph_of(views.edge(spark, d), nations.filter("n_nationkey in (1, 8)"), "src", "dst", "name", risk)


@query("SELECT 'bank' AS module, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders UNION ALL SELECT 'events', count(*), strftime(max(ts), '%Y-%m-%d') FROM events UNION ALL SELECT 'verify', count(*), NULL FROM documents")
def module_stats(spark, d):
    return cases.module_stats({"bank": (table(spark, d, "orders"), "o_orderdate"), "events": (table(spark, d, "events"), "ts"), "verify": (table(spark, d, "documents"), None)})


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'KINSHIP' WHEN doc_id % 3 = 1 THEN 'EMPLOYMENT' ELSE '' END AS category,
    CASE WHEN doc_id % 3 = 0 THEN 'N' || doc_id || ' is Spouse of E' || doc_id WHEN doc_id % 3 = 1 THEN 'E' || doc_id || ', Buyer, ' || source ELSE '' END AS inference FROM documents"""
)
def snippet_inference(spark, d):
    k = F.col("doc_id").cast("string")
    kin = F.concat(F.lit("Employee: E"), k, F.lit(" (77) | Nominee: N"), k, F.lit(" | Relationship: Spouse"))
    job = F.concat(F.lit("Name: E"), k, F.lit(" | Designation: Buyer | Department: "), F.col("source"))
    rows = table(spark, d, "documents").select("doc_id", F.lit("kw").alias("kw"), F.when(F.col("doc_id") % 3 == 0, kin).when(F.col("doc_id") % 3 == 1, job).otherwise("nothing").alias("snippet"))
    return cases.infer(rows, "kw", "snippet").select("doc_id", "category", "inference")


@query("SELECT level, count(*) FILTER (score < 50) AS low, min(score) AS worst FROM (SELECT CAST(score AS INTEGER) AS score, CASE WHEN score >= 80 THEN 'AUTHENTIC' WHEN score >= 50 THEN 'SUSPICIOUS' ELSE 'HIGH_RISK_TAMPERED' END AS level FROM p) GROUP BY level", (META,))
def level_summary(spark, d):
    return scored_documents(spark, d).groupBy("level").agg(F.count_if(F.col("score") < 50).alias("low"), F.min("score").alias("worst"))


@query("SELECT conv_id, count(*) AS n FROM chat WHERE risk_score >= 50 OR flagged <> '' GROUP BY conv_id", (CHAT,))
def flagged_by_channel(spark, d):
    rows = chat_rows(spark, d).filter((F.col("risk_score") >= 50) | (F.col("flagged") != ""))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
