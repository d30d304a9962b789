"""The views that the registered queries run on: the driver's tables as evidence, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.session import dealt, shares, table

PRPO = """prpo AS (
  SELECT l_suppkey AS vendor, s_name AS vendor_name, l_partkey AS material, p_type AS material_type, p_name AS description,
         l_orderkey AS po, l_linenumber AS line, o_orderdate AS po_date, l_shipdate AS pstng_date, p_size AS po_qty,
         l_quantity AS gr_qty, p_retailprice AS net_price, l_extendedprice AS amount_lc, l_returnflag AS cost_ctr, l_linestatus AS gl
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

TXN = """txn AS (
  SELECT o_orderkey AS txn_id, o_custkey AS account, c_name AS holder, n_name AS party, o_orderdate AS txn_date, o_orderpriority AS mode,
         CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice ELSE 0.0 END AS debit, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END AS credit,
         'UPI/' || (CASE WHEN o_orderkey % 2 = 1 THEN 'OUT' ELSE 'IN' END) || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '4') || '/' || lower(n_name) || '@okbank/' || o_orderpriority AS narration
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

FLOW = """flow AS (
  SELECT event_id, user_id AS account, ts, value AS amount, event_type,
         CASE WHEN event_type = 'purchase' THEN 'IN' WHEN event_type = 'click' THEN 'OUT' END AS leg,
         CASE event_id % 5 WHEN 0 THEN 'Acme Traders' WHEN 1 THEN 'acme' WHEN 2 THEN 'Zed' WHEN 3 THEN 'Account ' || CAST(user_id AS VARCHAR) END AS party, 'Account ' || CAST(user_id AS VARCHAR) AS holder
  FROM events WHERE event_type IN ('purchase', 'click'))"""

EDGE = """edge AS (
  SELECT ns.n_name AS src, nc.n_name AS dst, count(*) AS transfers, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey GROUP BY 1, 2)"""

REGION_EDGE = """redge AS (
  SELECT src, dst, transfers, amount FROM edge JOIN nation a ON src = a.n_name JOIN nation b ON dst = b.n_name WHERE a.n_regionkey = b.n_regionkey AND src <> dst)"""


def prpo(spark: SparkSession, d: str) -> DataFrame:
    """Receipts with their order, vendor and material; small masters are left to the optimizer to broadcast.

    Large tables are dealt to as many tasks as they need. Orders come last, so what is grouped by order is not dealt again.
    """
    lines, orders, parts = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    n = shares(lines)
    rows = dealt(lines, n, "l_partkey").join(dealt(parts, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = dealt(rows, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    names = {
        "l_suppkey": "vendor", "s_name": "vendor_name", "l_partkey": "material", "p_type": "material_type", "p_name": "description",
        "l_orderkey": "po", "l_linenumber": "line", "o_orderdate": "po_date", "l_shipdate": "pstng_date", "p_size": "po_qty", "l_quantity": "gr_qty",
        "p_retailprice": "net_price", "l_extendedprice": "amount_lc", "l_returnflag": "cost_ctr", "l_linestatus": "gl",
    }
    return rows.select(*(F.col(a).alias(b) for a, b in names.items()))


def txn(spark: SparkSession, d: str) -> DataFrame:
    """Bank transactions: orders as debits (odd keys) and credits."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    odd = F.col("o_orderkey") % 2 == 1
    parts = [F.lit("UPI/"), F.when(odd, "OUT").otherwise("IN"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "4"), F.lit("/"), F.lower("n_name"), F.lit("@okbank/"), F.col("o_orderpriority")]
    return rows.select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("account"), F.col("c_name").alias("holder"), F.col("n_name").alias("party"),
        F.col("o_orderdate").alias("txn_date"), F.col("o_orderpriority").alias("mode"),
        F.when(odd, F.col("o_totalprice")).otherwise(0.0).alias("debit"), F.when(odd, 0.0).otherwise(F.col("o_totalprice")).alias("credit"),
        F.concat(*parts).alias("narration"),
    )


def flow(spark: SparkSession, d: str) -> DataFrame:
    """Money into (purchase) and out of (click) an account."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "click"))
    leg = F.when(F.col("event_type") == "purchase", "IN").otherwise("OUT")
    holder, five = F.concat(F.lit("Account "), F.col("user_id").cast("string")), F.col("event_id") % 5
    party = F.when(five == 0, "Acme Traders").when(five == 1, "acme").when(five == 2, "Zed").when(five == 3, holder)
    return rows.select("event_id", F.col("user_id").alias("account"), "ts", F.col("value").alias("amount"), "event_type", leg.alias("leg"), party.alias("party"), holder.alias("holder"))


def edge(spark: SparkSession, d: str) -> DataFrame:
    """Totals from supplier nation to customer nation, self flows too: lines are summed per nation keys before names are joined."""
    return _edges(spark, d).select("src", "dst", "transfers", "amount")


def region_edge(spark: SparkSession, d: str) -> DataFrame:
    """The edges between different nations of a region, for paths, cycles and neighbourhoods."""
    return _edges(spark, d).filter((F.col("src_region") == F.col("dst_region")) & (F.col("src") != F.col("dst"))).select("src", "dst", "transfers", "amount")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("transfers"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    a, b = (table(spark, d, "nation").select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_name").alias(x), F.col("n_regionkey").alias(f"{x}_region")) for x in ("src", "dst"))
    return sums.join(a, F.col("s_nationkey") == F.col("src_key")).join(b, F.col("c_nationkey") == F.col("dst_key"))
