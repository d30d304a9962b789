"""Registered queries for small column functions, dates, keyword files, transcripts and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from casefile.functions import text as X
from casefile.operators import cases, graph, grid, naming
from casefile.plans import views
from casefile.plans.registry import LEVEL, META, query, scored_documents
from casefile.session import put, table, work_dir
from casefile.sources import lines, office, tables
from casefile.streaming import flows


@query("SELECT txn_id FROM txn WHERE txn_id % 3 = 0", (views.TXN,))
def balance_markers(spark, d):
    said = F.when(F.col("txn_id") % 3 == 0, "Opening Balance").otherwise(F.col("narration"))
    return views.txn(spark, d).filter(naming.is_balance_marker(F.col("party"), said)).select("txn_id")


@query("SELECT c_custkey, lower('x' || c_nationkey || '.Com') AS domain, 'ab_' || c_custkey || '_c' AS slug FROM customer")
def domains_and_slugs(spark, d):
    c, n = table(spark, d, "customer"), F.col("c_nationkey").cast("string")
    return c.select("c_custkey", X.mail_domain(F.concat(F.lit("Some One <a@b@X"), n, F.lit(".Com >"))).alias("domain"), X.slug(F.concat(F.lit("-Ab: "), F.col("c_custkey").cast("string"), F.lit("  C!"))).alias("slug"))


@query("""WITH n AS (SELECT c_nationkey AS k, list_sort(list_distinct(list(c_mktsegment))) AS s FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT n_nationkey, array_to_string(list_concat(['Building', 'own'], list_filter(coalesce(s, []), lambda x: x <> 'BUILDING')), ',') AS keywords FROM nation LEFT JOIN n ON k = n_nationkey""")
def keyword_append(spark, d):
    profiles = table(spark, d, "nation").select("n_nationkey", F.array(F.lit("Building"), F.lit("own")).alias("keywords"))
    new = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"), F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("keyword"))
    return cases.add_keywords(profiles, new, "n_nationkey").select("n_nationkey", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 1 THEN ' 08:30:15' WHEN o_orderkey % 3 = 0 THEN ' 05:00:15' ELSE ' 10:30:15' END AS at, CASE WHEN o_orderkey % 2 = 0 THEN 3723.5 ELSE 83.0 END AS seconds FROM orders")
def document_times(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(k % 3 == 0, F.concat(F.lit("D:"), day, F.lit("103015+05'30'"))).when(k % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:30:15Z"))).otherwise(F.concat(day, F.lit("103015")))
    stamp = F.when(k % 2 == 0, "1:02:03,5").otherwise("01:23")
    rows = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), stamp.alias("stamp"))
    return rows.select("o_orderkey", F.date_format(office.document_date("raw"), "yyyy-MM-dd HH:mm:ss").alias("at"), lines.seconds_of(F.col("stamp")).alias("seconds"))


@query("""SELECT doc_id, w AS term, CAST((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w) AS INTEGER) AS hits FROM documents, (SELECT unnest(['the', 'license']) AS w) WHERE contains(lower(text), w)""")
def new_terms(spark, d):
    terms, done = spark.createDataFrame([("The",), ("license",), ("old",)], "term string"), spark.createDataFrame([("old",)], "term string")
    return flows.search_new_terms(table(spark, d, "documents"), done, terms, "doc_id", "text")


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, turn * 10.0 AS starts, turn * 10.0 + 4.5 AS ends, CASE WHEN turn % 2 = 0 THEN 'Anna B' ELSE 'Speaker ' || ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 + 1) END AS speaker, 'line ' || turn AS text FROM conversations""")
def transcript_files(spark, d):
    t = F.col("turn")
    stamp = lambda tenths: F.format_string("%02d:%02d.%d", (tenths / 600).cast("int"), (tenths / 10 % 60).cast("int"), (tenths % 10).cast("int"))
    said = F.concat(F.when(t % 2 == 0, "<v Anna B>").otherwise(""), F.lit("line "), t.cast("string"))
    block = F.concat(stamp((t * 100).cast("int")), F.lit(" --> "), stamp((t * 100 + 45).cast("int")), F.lit("\n"), said, F.lit("\n"))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    files = files.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n")).alias("body"))
    return lines.parse_transcript(files, ["conv_id"]).select("conv_id", "seq", "starts", "ends", "speaker", "text")


@query(
    """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS seq, role AS sender, 'said ' || turn AS text, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE conv_id % 7 <> 3
    UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, 'Expecting value at character 0' FROM conversations WHERE conv_id % 7 = 3"""
)
def chat_json(spark, d):
    t = F.col("turn")
    message = F.to_json(F.struct(F.when(t % 2 == 0, F.col("role")).alias("from"), F.when(t % 2 == 1, F.col("role")).alias("sender_name"), F.when(t % 3 == 0, F.to_json(F.array(F.lit("said "), t.cast("string")))).otherwise(F.concat(F.lit("said "), t.cast("string"))).alias("message")))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit("]"))
    files = files.select("conv_id", F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("broken "), listed)).when(F.size("ms") % 2 == 0, listed).otherwise(F.concat(F.lit('{"messages": '), listed, F.lit("}"))).alias("body"))
    return lines.parse_chat_json(files, ["conv_id"]).select("conv_id", "seq", "sender", "text", "error")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, 'Word ' || n_name AS keyword FROM nation")
def keyword_file(spark, d):
    path = work_dir(spark, "keywords")
    words = [r.n_name for r in table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # a fixture
    put(spark, f"{path}/words.txt", "\n".join(["# words", *(f'"Word {w}"' for w in words), "", f"word {words[0].lower()}", "// end"]).encode())
    return tables.keyword_list(spark, path)


@query("SELECT n_nationkey || '.bin' AS file, sha256('content of ' || n_name) AS sha256 FROM nation")
def file_digests(spark, d):
    path = work_dir(spark, "digests")
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # a fixture
        put(spark, f"{path}/{r.n_nationkey}.bin", f"content of {r.n_name}".encode())
    return office.properties(office.read_binary(spark, path)).select(F.substring_index("path", "/", -1).alias("file"), "sha256")


@query(f"SELECT software, count(*) AS documents, count(*) FILTER ({LEVEL} = 'HIGH_RISK_TAMPERED') AS tampered FROM p GROUP BY software ORDER BY documents DESC, software LIMIT 6", (META,))
def top_software(spark, d):
    rows = scored_documents(spark, d).groupBy("software").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("level") == "HIGH_RISK_TAMPERED").alias("tampered"))
    return rows.orderBy(F.desc("documents"), "software").limit(6)


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0 OR (c_nationkey % 3 = 1 AND c_custkey % 5 = 2)")
def visible_cases(spark, d):
    status = F.when(F.col("c_nationkey") % 3 == 0, "COMPLETED").when(F.col("c_nationkey") % 3 == 1, "ACTIVE").otherwise("DRAFT")
    rows = table(spark, d, "customer").select("c_custkey", status.alias("status"), (F.col("c_custkey") % 5).cast("string").alias("creator"))
    return grid.visible_cases(rows, "2").select("c_custkey")


#: What is said, and whether it is a notice of the chat program.
SAYINGS = (
    ("Messages and calls are end-to-end encrypted. No one outside", True), ("\u200eYour security code with {} changed.", True), ("{}'s security code changed", True), ("{} is a contact", True), ("{} was added to your contacts.", True),
    ('{} created group "x"', True), ('{} changed the subject to "y"', True), ("{} left", True), ("{} left the group.", True), ("{} added you to this group", True), ("{} removed ~bob-1", True), ("You're now an admin", True),
    ("Waiting for this message. This may take a while.", True), ("left", False), ("{} left the building", False), ("what end-to-end encrypted means", False), ("{} added sugar to it", False), ("created group x", False), ("the contact of {}", False),
)


@query(
    "SELECT c_custkey, CASE c_custkey % " + str(len(SAYINGS)) + " " + " ".join(f"WHEN {i} THEN {str(is_one).lower()}" for i, (_, is_one) in enumerate(SAYINGS)) + " END AS notice FROM customer"
)
def chat_notices(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    said = F.element_at(F.array(*(F.replace(F.lit(t), F.lit("{}"), name) for t, _ in SAYINGS)), (k % len(SAYINGS) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", lines.is_notice(said).alias("notice"))


@query(
    """, s AS (SELECT src, dst FROM redge WHERE transfers % 5 >= 2), u AS (SELECT src AS a, dst AS b FROM s UNION SELECT dst, src FROM s), h1 AS (SELECT DISTINCT b FROM u WHERE a = 'NATION_0' AND b <> 'NATION_0'),
    h2 AS (SELECT DISTINCT u.b FROM h1 JOIN u ON u.a = h1.b WHERE u.b <> 'NATION_0' AND u.b NOT IN (SELECT b FROM h1))
    SELECT 'NATION_0' AS name, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2""",
    (views.EDGE, views.REGION_EDGE),
)
def bfs_confident(spark, d):
    """Neighbours over edges of a confidence from 0.5 on."""
    edges = views.region_edge(spark, d).withColumn("confidence", (F.col("transfers") % 5) / 4.0)
    return graph.neighbourhood(edges, "src", "dst", "NATION_0", 2, confidence="confidence", least=0.5)
