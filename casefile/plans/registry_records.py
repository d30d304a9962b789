"""Registered queries on profiles, accounts, reviews, grids and texts of narrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from casefile.functions import text as X
from casefile.operators import grid, procurement, records, trail
from casefile.plans import views
from casefile.plans.registry import CHAT, HOPS, LEVEL, META, ORACLE_SQL, chat_rows, dec_sum, hops, query, scored_documents
from casefile.session import table

@query("""WITH a AS (SELECT c_custkey AS profile_id, c_name AS name, 'old' AS origin FROM customer WHERE c_nationkey < 12), b AS (SELECT c_custkey AS profile_id, ' ' || upper(c_name) AS name, 'new' AS origin FROM customer)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM a)""")
def profile_create(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_nationkey < 12").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("name"), F.lit("old").alias("origin"))
    new = c.select(F.col("c_custkey").alias("profile_id"), F.concat(F.lit(" "), F.upper("c_name")).alias("name"), F.lit("new").alias("origin"))
    return records.append_new(old, new, "name")


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey > 3 THEN 'R' || c_nationkey ELSE c_name END AS c_name, CASE WHEN c_acctbal > 0 AND c_nationkey % 2 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def profile_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    even = F.col("c_nationkey") % 2 == 0
    changes = rows.filter("c_acctbal > 0").select("c_custkey", F.when(F.col("c_nationkey") > 3, F.concat(F.lit("R"), F.col("c_nationkey").cast("string"))).otherwise(" ").alias("c_name"), F.when(even, "X").alias("c_mktsegment"))
    return records.update(rows, changes, "c_custkey", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query("""WITH b AS (SELECT c_nationkey AS audit, c_custkey AS profile FROM customer), ch AS (SELECT n_nationkey AS audit, n_regionkey AS profile, n_nationkey % 3 = 0 AS replace, n_nationkey % 2 AS author FROM nation), ok AS (SELECT * FROM ch WHERE author = 0)
    SELECT audit, profile FROM (SELECT * FROM b WHERE audit NOT IN (SELECT audit FROM ok WHERE replace) UNION SELECT audit, profile FROM ok)""")
def audit_mapping(spark, d):
    bridge = table(spark, d, "customer").select(F.col("c_nationkey").alias("audit"), F.col("c_custkey").alias("profile"))
    key = F.col("n_nationkey")
    changes = table(spark, d, "nation").select(key.alias("audit"), F.col("n_regionkey").alias("profile"), (key % 3 == 0).alias("replace"), (key % 2).alias("by"))
    owners = table(spark, d, "nation").select(key.alias("audit"), F.lit(0).cast("bigint").alias("creator"))
    return records.map_members(bridge, records.allowed(changes, owners, "audit"), "audit", "profile")


@query("SELECT c_nationkey AS audit, c_custkey AS profile FROM customer WHERE NOT (c_acctbal < 0)")
def audit_unmapping(spark, d):
    c = table(spark, d, "customer")
    pair = (F.col("c_nationkey").alias("audit"), F.col("c_custkey").alias("profile"))
    return records.unmap_members(c.select(*pair), c.filter("c_acctbal < 0").select(*pair), "audit", "profile")


@query("SELECT o_orderkey AS account, c_name AS holder, CASE WHEN c_custkey % 3 = 0 THEN -1 WHEN c_nationkey < 15 THEN c_custkey END AS person_id FROM orders JOIN customer ON o_custkey = c_custkey")
def orphan_accounts(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    accounts = rows.select(F.col("o_orderkey").alias("account"), F.col("c_name").alias("holder"), F.when(F.col("c_custkey") % 3 == 0, F.lit(-1).cast("bigint")).alias("person_id"))
    persons = table(spark, d, "customer").filter("c_nationkey < 15").select(F.col("c_custkey").alias("person_id"), F.concat(F.upper("c_name"), F.lit(" ")).alias("name"))
    return records.link_orphans(accounts, persons)


@query("""WITH r AS (SELECT o_orderkey % 2000 AS k, arg_max('n' || o_orderkey, o_orderkey) AS notes FROM orders GROUP BY 1) SELECT p_partkey, k IS NOT NULL AS reviewed, notes FROM part LEFT JOIN r ON k = p_partkey""")
def hit_reviews(spark, d):
    reviews = table(spark, d, "orders").select((F.col("o_orderkey") % 2000).alias("p_partkey"), F.col("o_orderkey").alias("at"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("notes"))
    return records.review(table(spark, d, "part").select("p_partkey"), reviews, "p_partkey")


@query("SELECT n_nationkey, n_nationkey = 3 OR n_regionkey = 1 AS acknowledged FROM nation")
def alert_acknowledge(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") == 3).alias("acknowledged"))
    return records.acknowledge(n, n.filter("n_regionkey = 1"), "n_nationkey").select("n_nationkey", "acknowledged")


@query("""SELECT o_orderkey, array_to_string(CASE WHEN o_custkey < 500 THEN ['p' || o_custkey] WHEN c.c_nationkey < 10 THEN CASE WHEN c.c_nationkey = 4 THEN [] ELSE ['n' || c.c_nationkey] END ELSE ['own'] END, ',') AS words FROM orders JOIN customer c ON o_custkey = c_custkey""")
def keywords_in_force(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_custkey").alias("profile"), F.col("c_nationkey").alias("audit"), F.array(F.lit("own")).alias("own"))
    one = table(spark, d, "customer").filter("c_custkey < 500").select(F.col("c_custkey").alias("profile"), F.array(F.concat(F.lit("p"), F.col("c_custkey").cast("string"))).alias("keywords"))
    two = table(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("audit"), F.when(F.col("n_nationkey") != 4, F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).alias("keywords"))
    return records.keywords_in_force(rows, [(one, "profile"), (two, "audit")], "own").select("o_orderkey", F.array_join("keywords_in_force", ",").alias("words"))


@query("""SELECT o_orderkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey WHEN c_custkey % 5 = 1 THEN c_custkey WHEN c_custkey % 5 = 2 AND c_custkey > 1 THEN c_custkey - 1 END AS profile_id FROM orders JOIN customer ON o_custkey = c_custkey""")
def profile_resolution(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == k)
    number = lambda n: F.concat(F.lit("CUSTOMER#"), F.lpad(n.cast("string"), 9, "0"), F.lit(" "))
    asked = rows.select("o_orderkey", F.when(k % 5 == 0, k).alias("asked_id"), F.when(k % 5 == 1, number(k)).when(k % 5 == 2, number(k - 1)).alias("asked_name"))
    profiles = table(spark, d, "customer").select(k.alias("profile_id"), F.col("c_name").alias("name"))
    return records.resolve_profile(asked, profiles, [("asked_id", "profile_id"), ("asked_name", "name")]).select("o_orderkey", "profile_id")


@query(f"""WITH p AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS department FROM customer WHERE c_nationkey < 15), a AS (SELECT o_custkey AS p, count(*) AS accounts, CAST(sum(o_orderkey % 3) AS BIGINT) AS transactions, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS banks,
    {dec_sum('o_totalprice')} AS total_debit, {dec_sum('round(o_totalprice / 2)')} AS total_credit FROM orders GROUP BY 1)
    SELECT id, name, department, coalesce(accounts, 0) AS accounts, coalesce(transactions, 0) AS transactions, coalesce(banks, '') AS banks, coalesce(total_debit, 0.0) AS total_debit, coalesce(total_credit, 0.0) AS total_credit, coalesce(transactions, 0) > 0 AS has_data FROM p LEFT JOIN a ON p = id
    UNION ALL SELECT 100000 + c_custkey, upper(c_name), 'Investigation', 0, 0, '', 0.0, 0.0, false FROM customer WHERE c_nationkey >= 15""")
def available_profiles(spark, d):
    c = table(spark, d, "customer")
    persons = c.filter("c_nationkey < 15").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"))
    accounts = table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("bank"), (F.col("o_orderkey") % 3).alias("n"), F.col("o_totalprice").alias("debit"), F.round(F.col("o_totalprice") / 2).alias("credit"))
    profiles = c.select((F.lit(100_000) + F.col("c_custkey")).alias("profile_id"), F.upper("c_name").alias("name"), F.lit(" ").alias("department"))
    return records.available_profiles(persons, accounts, profiles)


@query("""WITH w AS (SELECT DISTINCT lower(n_name) AS w FROM nation WHERE n_regionkey = 2 UNION SELECT '00012' UNION SELECT 'machinery'), x AS (SELECT c_custkey AS profile_id, c_name AS name, [lower(c_mktsegment), 'nation_' || c_nationkey] AS k FROM customer),
    m AS (SELECT profile_id, name, w, list_contains(k, w) AS own FROM x JOIN w ON list_contains(k, w) OR contains(lower(name), w))
    SELECT profile_id, name, coalesce(nullif(array_to_string(list_sort(list(w) FILTER (own)), ', '), ''), name) AS shared FROM m GROUP BY 1, 2""")
def vault_matches(spark, d):
    outside = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("name"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string"))).alias("keywords"))
    inside = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias("keyword")).unionByName(spark.createDataFrame([("00012",), ("MACHINERY ",), ("ab",)], "keyword string"))
    return records.vault_matches(outside, inside)


@query("""WITH e AS (SELECT DISTINCT o_custkey AS a, 100000 + o_orderkey % 400 AS b FROM orders) SELECT DISTINCT x.a AS target, x.b AS document, y.a AS party FROM e x JOIN e y ON x.b = y.b WHERE x.a < 40 AND y.a >= 1400""")
def document_bridges(spark, d):
    # Documents are nodes with numbers below zero, as customers may have any other.
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("x"), (F.lit(-100_000) - F.col("o_orderkey") % 400).alias("y"), (F.col("o_orderkey") % 2 == 0).alias("f"))
    edges = edges.select(F.when(F.col("f"), F.col("x")).otherwise(F.col("y")).alias("src"), F.when(F.col("f"), F.col("y")).otherwise(F.col("x")).alias("dst"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    found = records.bridges(edges, c.filter("id < 40"), edges.select(F.least("src", "dst").alias("id")), c.filter("id >= 1400"))
    return found.withColumn("document", -F.col("document"))


@query("""WITH d AS (SELECT conv_id, turn // 2 AS label, arg_min(role || turn, turn) AS found FROM conversations WHERE length(text) % 2 = 0 GROUP BY 1, 2) SELECT c.conv_id, c.turn, found FROM conversations c LEFT JOIN d ON d.conv_id = c.conv_id AND d.label = c.turn // 2""")
def segment_detections(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr("turn div 2").alias("label"), "role", "text")
    found = rows.filter(F.length("text") % 2 == 0).withColumn("found", F.concat("role", F.col("turn").cast("string")))
    return records.detections_of(rows, found, ["conv_id"], "label", "turn", "found").select("conv_id", "turn", "found")


@query("""WITH c AS (SELECT DISTINCT 'N' || (l_suppkey % 7) AS name FROM lineitem WHERE l_linenumber = 3), s AS (SELECT DISTINCT 'N' || (l_suppkey % 30) AS name FROM lineitem), t AS (SELECT DISTINCT 'N' || (l_partkey % 40) AS name FROM lineitem),
    e AS (SELECT name, name IN (SELECT name FROM s) AS f, name IN (SELECT name FROM t) AS g FROM (SELECT name FROM s UNION SELECT name FROM t) WHERE name NOT IN (SELECT name FROM c))
    SELECT name, 'conduit' AS part FROM c UNION ALL SELECT name, CASE WHEN lower(name) = 'n9' OR f AND NOT g THEN 'origin' ELSE 'beneficiary' END FROM e""")
def flow_columns(spark, d):
    rows = table(spark, d, "lineitem")
    name = lambda c, n: F.concat(F.lit("N"), (F.col(c) % n).cast("string"))
    return records.columns_of_flow(rows.select(name("l_suppkey", 30).alias("sender"), F.when(F.col("l_linenumber") == 3, name("l_suppkey", 7)).alias("conduit"), name("l_partkey", 40).alias("recipient")), "n9")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment <> 'X' AND c_custkey % 6 <> 0 AND c_nationkey NOT IN (1, 4)")
def graph_cleanup(spark, d):
    ids = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(table(spark, d, "customer").select((F.lit(1000) + F.col("c_custkey")).alias("id"), F.col("c_name").alias("name")))
    edges = table(spark, d, "customer").select((F.lit(1000) + F.col("c_custkey")).alias("src"), F.col("c_nationkey").alias("dst"), F.when(F.col("c_custkey") % 6 == 0, "DERIVED").alias("relation"))
    return records.clean_edges(edges, ids, ["NATION_1 ", "nation_4"], ["DERIVED"])[1].select((F.col("src") - 1000).alias("c_custkey"), F.col("dst").alias("c_nationkey"))


@query(HOPS + """ SELECT 'A' || account AS sender, 'R' || out_row AS recipient, 'CONDUIT' AS kind, out_amount AS amount, CASE WHEN retained_pct > 10 THEN 85 ELSE 75 END AS risk FROM hops
    UNION ALL SELECT 'A' || account, 'E' || event_id, 'DIRECT', amount, CASE WHEN event_id % 2 = 0 THEN 60 ELSE 40 END FROM flow""", (views.FLOW,))
def dossier_findings(spark, d):
    account = F.concat(F.lit("A"), F.col("account").cast("string")).alias("sender")
    direct = views.flow(spark, d).select(account, F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("recipient"), "amount", F.when(F.col("event_id") % 2 == 0, "FALLBACK_FUZZY").otherwise("UTR_EXACT").alias("method"))
    through = hops(spark, d).select(account, F.concat(F.lit("R"), F.col("out_row").cast("string")).alias("recipient"), F.col("out_amount").alias("amount"), "retained_pct")
    return records.dossier(direct, through)


@query(f"""WITH f AS (SELECT c_name AS src, n_name AS dst, 'TRANSFERRED_FUNDS' AS relation, 'q_bank' AS module, CAST(o_orderkey AS VARCHAR) AS evidence, o_totalprice AS weight, 0.9 AS confidence, 50 AS risk FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT s_name, n_name, 'ROLE_IN', 'q_ledger', CAST(s_suppkey AS VARCHAR), 1.0, 0.8, 30 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'NATION_' || r_regionkey, 'CITED', 'q_verify', CAST(n_nationkey AS VARCHAR), 1.0, 0.7, 20 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_' || r_regionkey)
    SELECT src, dst, relation, module, {dec_sum('weight')} AS weight, max(confidence) AS confidence, count(*) AS evidence, max(risk) AS risk FROM f GROUP BY 1, 2, 3, 4""")
def module_sync(spark, d):
    nation = table(spark, d, "nation")
    bank = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    bank = bank.select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"), F.col("o_orderkey").alias("evidence"), F.col("o_totalprice").alias("weight"))
    ledger = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"), F.col("s_suppkey").alias("evidence"), F.lit(1.0).alias("weight"))
    verify = nation.select(F.col("n_name").alias("src"), F.concat(F.lit("nation_"), F.col("n_regionkey").cast("string")).alias("dst"), F.col("n_nationkey").alias("evidence"), F.lit(1.0).alias("weight")).withColumn("dst", F.upper("dst"))
    found = records.findings_of([(bank, "TRANSFERRED_FUNDS", "q_bank", 0.9, 50), (ledger, "ROLE_IN", "q_ledger", 0.8, 30), (verify, "CITED", "q_verify", 0.7, 20)])
    once = found.groupBy("src", "dst", "relation", "module", "evidence").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max("risk").alias("risk"))
    return once.groupBy("src", "dst", "relation", "module").agg(procurement.total("weight").alias("weight"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence"), F.max("risk").alias("risk"))


# --- grids ------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '2-HIGH' AND contains(lower(c_name), '00') AND (contains(lower(c_name || '@x.com'), '7@x') OR contains(lower(c_mktsegment), 'mach'))
    AND contains(lower('po ' || o_orderkey), 'o 1') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND o_orderkey % 4 <> 0 AND o_orderkey % 100 >= 20""")
def mail_grid(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    mails = rows.select(
        "o_orderkey", F.col("o_orderpriority").alias("folder"), F.concat("c_name", F.lit("@x.com")).alias("sender"), F.col("c_mktsegment").alias("cc"), F.concat(F.lit("po "), key.cast("string")).alias("subject"),
        F.col("o_orderdate").alias("sent"), (key % 4 == 0).alias("has_attachment"), (key % 100).alias("risk_score"),
    )
    out = grid.mail_filter(grid.mail_filter(mails, "2-high", "00", "7@X", "O 1", "1993-01-01", "1997-12-31", False, 20).unionByName(grid.mail_filter(mails, "2-high", "00", "mach", "O 1", "1993-01-01", "1997-12-31", False, 20)), None)
    return out.select("o_orderkey").distinct()


@query(f"SELECT doc_id FROM ({ORACLE_SQL['mail_checkpoints']}) WHERE is_personal")
def mail_checkpoint_grid(spark, d):
    from casefile.plans.registry import QUERIES

    return grid.by_checkpoint(QUERIES["mail_checkpoints"](spark, d), "personal").select("doc_id")


@query("SELECT conv_id, turn FROM chat JOIN (SELECT conv_id AS i, turn AS t, text FROM conversations) ON i = conv_id AND t = turn WHERE role = 'user' AND (risk_score >= 50 OR flagged <> '' OR contains(lower(text), 'xa'))", (CHAT,))
def chat_grid(spark, d):
    rows = chat_rows(spark, d).withColumn("sender", F.col("role"))
    return grid.chat_filter(rows, flagged=True, sender="User", profile_keywords=["XA"]).select("conv_id", "turn")


@query(f"SELECT l_orderkey, l_linenumber FROM p WHERE {LEVEL} = 'SUSPICIOUS' AND contains(lower(software), 'pdf')", (META,))
def verify_grid(spark, d):
    return grid.verify_filter(scored_documents(spark, d).withColumn("mime", F.col("software")), "suspicious", "PDF").select("l_orderkey", "l_linenumber")


@query("SELECT page_id, regexp_extract(url, '^(.*)[/\\\\][^/\\\\]*$', 1) AS folder FROM pages")
def scan_folders(spark, d):
    return table(spark, d, "pages").select("page_id", grid.folder_of("url").alias("folder"))


# --- texts ------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Ravi Kumar' WHEN 1 THEN 'A.B. Traders' WHEN 2 THEN 'Party Ltd' WHEN 3 THEN NULL ELSE 'Anita' END AS name, CASE o_orderkey % 5 WHEN 1 THEN 'HDFC0001234' WHEN 3 THEN 'XXXX5678' END AS account FROM orders""")
def narration_names(spark, d):
    k, ref = F.col("o_orderkey") % 5, F.lpad(F.col("o_orderkey").cast("string"), 12, "4")
    said = (
        F.when(k == 0, F.concat(F.lit("UPI/OUT/"), ref, F.lit("/Sent To Ravi Kumar/ravi@okaxis/pay"))).when(k == 1, F.concat(F.lit("NEFT-HDFCN00"), ref, F.lit("-A.B. Traders-HDFC0001234")))
        .when(k == 2, F.concat(F.lit("UPI/"), ref, F.lit("/OUT/x"))).when(k == 3, F.lit("ATM withdrawal XXXX5678")).otherwise(F.concat(F.lit("MMT/IMPS/"), ref, F.lit("/Anita/SBIN")))
    )
    party = F.when(k == 2, "Party Ltd").when(k == 3, "out").otherwise("other")
    return table(spark, d, "orders").select("o_orderkey", X.counterparty_name(said, party).alias("name"), X.account_mask(said).alias("account"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE format('{:,}', CAST(c_custkey * 12345 AS BIGINT)) END AS grouped, CASE c_custkey % 3 WHEN 0 THEN 'CU' WHEN 1 THEN upper(left(c_name, 1) || left(c_mktsegment, 1)) ELSE 'Q' END AS initials,
    CASE WHEN c_nationkey = 3 THEN c_name ELSE c_name || ' (' || c_mktsegment || ')' END AS shown, CASE c_custkey % 4 WHEN 0 THEN 'Bank' WHEN 1 THEN 'Profile' WHEN 2 THEN '' ELSE 'Odd thing' END AS module, 'a' || c_custkey || ' | b' AS snippets, CASE WHEN c_custkey % 2 = 0 THEN 'k=new,z=1' ELSE 'k=old' END AS meta FROM customer""")
def labels_of_profiles(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    name = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat("c_name", F.lit("  x "), "c_mktsegment")).otherwise("  ")
    code = F.when(k % 4 == 0, " Q_Bank").when(k % 4 == 1, "core").when(k % 4 == 3, "q_odd thing")
    old, new = F.create_map(F.lit("k"), F.lit("old")), F.when(k % 2 == 0, F.create_map(F.lit("k"), F.lit("new"), F.lit("z"), F.lit("1")))
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(X.merged_map(old, new))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return c.select(
        "c_custkey", X.group_western(F.when(k % 7 == 0, "n/a").otherwise((k * 12345).cast("string"))).alias("grouped"), X.initials(name).alias("initials"),
        X.display_name(F.col("c_name"), F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))).alias("shown"), X.module_name(code).alias("module"),
        X.first_snippets(F.array(F.concat(F.lit("a"), k.cast("string")), F.lit("b"), F.lit("c"))).alias("snippets"), meta.alias("meta"),
    )


# --- cycles with their money ------------------------------------------------------------------------------------

MONEY = """, e AS (SELECT DISTINCT src, dst FROM redge), c AS (SELECT a.src || '>' || a.dst AS cycle, [a.src, a.dst] AS nodes FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst),
    leg AS (SELECT cycle, unnest(range(1, len(nodes) + 1)) AS leg, nodes FROM c), l AS (SELECT cycle, CAST(leg AS INTEGER) AS leg, nodes[leg] AS sender, nodes[leg % len(nodes) + 1] AS recipient FROM leg),
    m AS (SELECT ns.n_name AS sender, nc.n_name AS recipient, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey),
    s AS (SELECT sender, recipient, sum(c) AS c, min(day) AS a, max(day) AS b FROM m GROUP BY 1, 2)
    SELECT cycle, leg, sender, recipient, CAST(c AS BIGINT) / 100.0 AS outflow, CAST(c AS BIGINT) / 100.0 AS inflow, 0.0 AS retained, 'Direct Banking' AS conduits, a AS first_date, b AS last_date FROM l JOIN s USING (sender, recipient)"""


@query(MONEY, (views.EDGE, views.REGION_EDGE))
def cycle_legs(spark, d):
    e = views.region_edge(spark, d).select("src", "dst")
    back = e.select(F.col("dst").alias("b_src"), F.col("src").alias("b_dst"))
    pairs = e.filter("src < dst").join(back, (F.col("src") == F.col("b_src")) & (F.col("dst") == F.col("b_dst")))
    cycles = pairs.select(F.concat_ws(">", "src", "dst").alias("cycle"), F.array("src", "dst").alias("nodes"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = (table(spark, d, "nation").select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_name").alias(x)) for x in ("sender", "recipient"))
    direct = rows.join(a, F.col("s_nationkey") == F.col("sender_key")).join(b, F.col("c_nationkey") == F.col("recipient_key")).select("sender", "recipient", F.col("l_extendedprice").alias("amount"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    none = spark.createDataFrame([], "sender string, recipient string, conduit string, outflow double, inflow double, out_date string, in_date string")
    return trail.cycle_metrics(cycles, "nodes", direct, none)



STORY = HOPS + """, h AS (SELECT account AS c, in_row AS r, out_row AS o, in_amount, out_amount, retained FROM hops),
    e AS (SELECT account AS c, 0 AS p, event_id AS f, 0 AS l, 'direct' AS kind, 'A' || account AS a, 'B' || (event_id % 3) AS b, '' AS via, amount, 0.0 AS kept, strftime(ts, '%Y-%m-%d') AS day FROM flow WHERE leg = 'OUT'
    UNION ALL SELECT c, 1, min(r * 1000000 + o) AS f, -1, 'hop', 'S' || (r % 4), 'X' || (o % 2), 'X' || (o % 2), CAST(sum(CAST(in_amount AS DECIMAL(18,2))) AS DOUBLE), 0.0, '1999-01-0' || (r % 5 + 1) FROM h GROUP BY c, r % 4, o % 2, r % 5
    UNION ALL SELECT c, 1, min(r * 1000000 + o) OVER (PARTITION BY c, r % 4, o % 2, r % 5), r * 1000000 + o, 'hop', 'X' || (o % 2), 'R' || (o % 6), 'X' || (o % 2), out_amount, retained, CASE WHEN o % 7 = 0 THEN '' ELSE '1999-02-0' || (o % 9 + 1) END FROM h),
    n AS (SELECT *, row_number() OVER w AS n, CAST(sum(CAST(kept AS DECIMAL(18,2))) OVER (PARTITION BY c ORDER BY CASE WHEN day = '' THEN '9999-99-99' ELSE day END, p, f, l ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative FROM e WINDOW w AS (PARTITION BY c ORDER BY CASE WHEN day = '' THEN '9999-99-99' ELSE day END, p, f, l))
    SELECT c AS "case", CAST(n AS INTEGER) AS n, kind, a || ' → ' || b AS title, day AS date, amount, kept AS retained, cumulative FROM n
    UNION ALL SELECT c, CAST(max(n) + 1 AS INTEGER), 'summary', 'Case Position: Full Topology Reconciled', 'All Dates', 0.0, 0.0, CAST(sum(CAST(kept AS DECIMAL(18,2))) AS DOUBLE) FROM n GROUP BY c"""


@query(STORY, (views.FLOW,))
def case_story(spark, d):
    name = lambda letter, c, n: F.concat(F.lit(letter), (F.col(c) % n).cast("string"))
    direct = views.flow(spark, d).filter("leg = 'OUT'").select(
        F.col("account").alias("case"), F.col("event_id").alias("row"), F.concat(F.lit("A"), F.col("account").cast("string")).alias("sender"), name("B", "event_id", 3).alias("recipient"), "amount", F.date_format("ts", "yyyy-MM-dd").alias("date")
    )
    h = hops(spark, d)
    day = lambda month, c, n: F.concat(F.lit(month), (F.col(c) % n + 1).cast("string"))
    through = h.select(
        F.col("account").alias("case"), (F.col("in_row") * 1_000_000 + F.col("out_row")).alias("row"), name("S", "in_row", 4).alias("sender"), name("X", "out_row", 2).alias("conduit"), name("R", "out_row", 6).alias("recipient"),
        day("1999-01-0", "in_row", 5).alias("out_date"), F.when(F.col("out_row") % 7 != 0, day("1999-02-0", "out_row", 9)).alias("in_date"), F.col("in_amount").alias("outflow"), F.col("out_amount").alias("inflow"), "retained",
    )
    loops = spark.createDataFrame([], "case bigint, row bigint, originator string, counterparty string, amount double, date string")
    return trail.case_story(direct, through, loops).select("case", "n", "kind", "title", "date", "amount", "retained", "cumulative")
