"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import text as X
from casefile.operators import bank, graph, grid, procurement, screening, trail
from casefile.plans import views
from casefile.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2001-01-01"
KEYWORDS = ("the", "under", "license", "example.com", "que de")
WATCH = (("the", 20), ("of", 15), ("que", 40), ("license", 60), ("and", 10))
INTENTS = (("Contact", (("the", 40), ("of", 30))), ("Romance", (("que", 45), ("la", 35))), ("Other", (("und", 50), ("and", 40))))


def query(sql: str | None = None, views_used: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(views_used)} " if views_used else "") + sql
        return f

    return add


def whole_days(a: str, b: str) -> str:
    return f"CAST(floor((epoch({a}) - epoch({b})) / 86400) AS BIGINT)"


def dec_sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


RECEIPT = ["vendor", "material", "po", "line"]


@query(f"SELECT DISTINCT vendor, material, po, line, {whole_days('pstng_date', 'po_date')} AS days_late FROM prpo WHERE {whole_days('pstng_date', 'po_date')} > 365", (views.PRPO,))
def late_receipt(spark, d):
    return procurement.late_receipts(views.prpo(spark, d), "po_date", "pstng_date", RECEIPT)


@query(
    f"""SELECT vendor, material, po, line, CASE WHEN late AND early THEN 'both' WHEN late THEN 'after_gap' ELSE 'before_gap' END AS tag FROM (
    SELECT *, coalesce({whole_days('pstng_date', 'lag(pstng_date) OVER w')} > 365, false) AS late, coalesce({whole_days('lead(pstng_date) OVER w', 'pstng_date')} > 365, false) AS early
    FROM prpo WINDOW w AS (PARTITION BY vendor, material ORDER BY pstng_date, po, line)) WHERE late OR early""",
    (views.PRPO,),
)
def receipt_gap(spark, d):
    return procurement.receipt_gaps(views.prpo(spark, d), ["vendor", "material"], "pstng_date", ["po", "line"], RECEIPT)


@query(
    f"""SELECT vendor, material, po, max(po_qty) AS po_qty, sum(gr_qty) AS gr_qty, max(po_qty) - sum(gr_qty) AS remaining, {whole_days(f"TIMESTAMP '{AS_OF}'", 'min(po_date)')} AS age_days
    FROM prpo GROUP BY vendor, material, po HAVING max(po_qty) - sum(gr_qty) > 0 AND {whole_days(f"TIMESTAMP '{AS_OF}'", 'min(po_date)')} > 750""",
    (views.PRPO,),
)
def open_po(spark, d):
    return procurement.open_orders(views.prpo(spark, d), ["vendor", "material", "po"], "po_date", "po_qty", "gr_qty", F.to_timestamp(F.lit(AS_OF)))


@query(
    f"""SELECT vendor, material, net_price, count(*) AS orders, {whole_days('max(po_date)', 'min(po_date)')} AS span_days FROM prpo WHERE material_type IN ('PROMO', 'SMALL')
    GROUP BY vendor, material, net_price HAVING {whole_days('max(po_date)', 'min(po_date)')} > 730""",
    (views.PRPO,),
)
def stagnant_price(spark, d):
    return procurement.stagnant_prices(views.prpo(spark, d), ["vendor", "material", "net_price"], "po_date", types=("material_type", ["PROMO", "SMALL"]))


@query(
    """WITH b AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS bag FROM part)
    SELECT p_partkey, bag, members FROM b JOIN (SELECT bag, count(*) AS members FROM b GROUP BY bag HAVING count(*) > 1) USING (bag)"""
)
def token_bag_groups(spark, d):
    return procurement.same_bags(table(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT DISTINCT material, material_type, gl FROM prpo WHERE material_type IN ('LARGE', 'MEDIUM') AND gl IN ('F')", (views.PRPO,))
def typed_spares(spark, d):
    return procurement.typed_on_accounts(views.prpo(spark, d), "material_type", ["LARGE", "MEDIUM"], "gl", ["F"], ["material", "material_type", "gl"])


@query("SELECT vendor, material, po, line, po_qty, gr_qty, po_qty - gr_qty AS po_rem, CAST(vendor AS VARCHAR) || ' - ' || vendor_name AS vendor_label FROM prpo", (views.PRPO,))
def material_list(spark, d):
    return procurement.with_remainders(views.prpo(spark, d)).select(*RECEIPT, "po_qty", "gr_qty", "po_rem", "vendor_label")


@query(
    f"SELECT {dec_sum('amount_lc')} AS total_amount, count(DISTINCT vendor) AS vendors, count(DISTINCT material) AS materials, count(DISTINCT po) AS orders, count(DISTINCT gl) AS accounts FROM prpo",
    (views.PRPO,),
)
def ledger_kpis(spark, d):
    return procurement.kpis(views.prpo(spark, d), "amount_lc", {"vendors": "vendor", "materials": "material", "orders": "po", "accounts": "gl"})


@query(f"SELECT vendor, {dec_sum('amount_lc')} AS amount FROM prpo GROUP BY vendor ORDER BY amount DESC, vendor LIMIT 5", (views.PRPO,))
def top_vendors(spark, d):
    return procurement.top_by_amount(views.prpo(spark, d), "vendor", "amount_lc")


@query(f"SELECT gl, {dec_sum('amount_lc')} AS amount FROM prpo GROUP BY gl ORDER BY amount DESC, gl LIMIT 5", (views.PRPO,))
def top_gl(spark, d):
    return procurement.top_by_amount(views.prpo(spark, d), "gl", "amount_lc")


YEARS = list(range(1992, 2003))


@query(
    f""", s AS (SELECT vendor, year(pstng_date) AS y, {dec_sum('amount_lc')} AS a FROM prpo GROUP BY 1, 2), t AS (SELECT vendor FROM prpo GROUP BY vendor ORDER BY {dec_sum('amount_lc')} DESC, vendor LIMIT 10)
    SELECT t.vendor, CAST(g.y AS VARCHAR) AS year, coalesce(s.a, 0.0) AS amount FROM t CROSS JOIN (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS y) g LEFT JOIN s ON s.vendor = t.vendor AND s.y = g.y""",
    (views.PRPO,),
)
def vendor_year_pivot(spark, d):
    return procurement.year_pivot(views.prpo(spark, d), "vendor", "pstng_date", "amount_lc", YEARS)


@query(
    """, s AS (SELECT cost_ctr, CAST(sum(CAST(amount_lc AS DECIMAL(18,2))) * 100 AS BIGINT) AS c FROM prpo GROUP BY 1 ORDER BY c DESC, cost_ctr LIMIT 12)
    SELECT cost_ctr, ((c * 200 + 10000000) // 20000000) / 100.0 AS lakhs FROM s""",
    (views.PRPO,),
)
def cost_centre_spend(spark, d):
    return procurement.lakh_totals(views.prpo(spark, d), "cost_ctr", "amount_lc")


@query(
    f"""SELECT c.cost_ctr, g.gl, coalesce(s.a, 0.0) AS amount FROM (SELECT DISTINCT cost_ctr FROM prpo ORDER BY 1 LIMIT 8) c CROSS JOIN (SELECT unnest(['F', 'O']) AS gl) g
    LEFT JOIN (SELECT cost_ctr, gl, {dec_sum('amount_lc')} AS a FROM prpo GROUP BY 1, 2) s ON s.cost_ctr = c.cost_ctr AND s.gl = g.gl""",
    (views.PRPO,),
)
def cost_gl_crosstab(spark, d):
    return procurement.crosstab(views.prpo(spark, d), "cost_ctr", "gl", "amount_lc", ["F", "O"])


@query("SELECT vendor, material, po, line FROM prpo WHERE vendor = 7 OR vendor_name = 'Supplier#000000003' OR material = 11", (views.PRPO,))
def vendor_slice(spark, d):
    return procurement.vendor_slice(views.prpo(spark, d), vendor=7, vendor_name="Supplier#000000003", material=11, po=None).select(RECEIPT)


@query(
    f"""SELECT p.vendor, p.material, po, line FROM prpo p JOIN (SELECT vendor, material, net_price FROM prpo GROUP BY 1, 2, 3 HAVING {whole_days('max(po_date)', 'min(po_date)')} > 730) g
    ON p.vendor = g.vendor AND p.material = g.material AND p.net_price = g.net_price""",
    (views.PRPO,),
)
def stagnant_receipts(spark, d):
    return procurement.stagnant_rows(views.prpo(spark, d), ["vendor", "material", "net_price"], "po_date").select(RECEIPT)


@query(
    """WITH o AS (SELECT s_suppkey AS code, s_name AS name, CAST(s_nationkey AS VARCHAR) AS place, s_suppkey % 5 = 0 AS is_flagged FROM supplier WHERE s_suppkey % 3 <> 0),
    n AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE upper(s_name) END AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'P' || s_nationkey END AS place FROM supplier WHERE s_suppkey % 3 <> 1)
    SELECT coalesce(n.code, o.code) AS code, coalesce(nullif(trim(n.name), ''), o.name) AS name, coalesce(nullif(trim(n.place), ''), o.place) AS place, coalesce(o.is_flagged, false) AS is_flagged
    FROM o FULL OUTER JOIN n ON o.code = n.code"""
)
def vendor_upsert(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    old = s.filter(key % 3 != 0).select(key.alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("place"), (key % 5 == 0).alias("is_flagged"))
    new = s.filter(key % 3 != 1).select(
        key.alias("code"), F.when(key % 2 == 0, "").otherwise(F.upper("s_name")).alias("name"), F.when(key % 4 != 0, F.concat(F.lit("P"), F.col("s_nationkey").cast("string"))).alias("place")
    )
    return procurement.upsert_vendors(old, new, "code", ["name", "place"], "is_flagged")


@query(
    """SELECT vendor, material, po, line, CAST(CAST(gr_qty AS DECIMAL(18,2)) * CAST(net_price AS DECIMAL(18,2)) AS DOUBLE) AS due,
    CAST(CAST(amount_lc AS DECIMAL(18,2)) - CAST(gr_qty AS DECIMAL(18,2)) * CAST(net_price AS DECIMAL(18,2)) AS DOUBLE) AS variance FROM prpo
    WHERE abs(CAST(amount_lc AS DECIMAL(18,2)) - CAST(gr_qty AS DECIMAL(18,2)) * CAST(net_price AS DECIMAL(18,2))) > CAST(0.5 AS DECIMAL(6,4)) * (CAST(gr_qty AS DECIMAL(18,2)) * CAST(net_price AS DECIMAL(18,2)))""",
    (views.PRPO,),
)
def three_way_match(spark, d):
    return procurement.match_three_ways(views.prpo(spark, d), RECEIPT, "gr_qty", "gr_qty", "net_price", "amount_lc", tolerance=0.5)


# --- bank -------------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS transactions, {dec_sum('debit')} AS total_debit, {dec_sum('credit')} AS total_credit, count(*) FILTER (debit >= 500000) AS high_debits, count(*) FILTER (credit >= 50000) AS large_credits FROM txn", (views.TXN,))
def bank_kpis(spark, d):
    return bank.dashboard(views.txn(spark, d))


@query(f"SELECT party, count(*) AS n, {dec_sum('debit')} AS debit, {dec_sum('credit')} AS credit FROM txn GROUP BY party HAVING count(*) >= 40", (views.TXN,))
def frequent_parties(spark, d):
    return bank.frequent_parties(views.txn(spark, d), "party", 40)


@query(f"SELECT CAST(year(txn_date) AS INTEGER) AS year, count(*) AS n, {dec_sum('debit')} AS debit, {dec_sum('credit')} AS credit FROM txn WHERE txn_date IS NOT NULL GROUP BY 1", (views.TXN,))
def year_breakdown(spark, d):
    return bank.by_year(views.txn(spark, d), "txn_date")


@query(
    f"""SELECT total_debit, total_credit, credits, ((c * 2 + credits) // (2 * credits)) / 100.0 AS mean_credit FROM (
    SELECT {dec_sum('debit')} AS total_debit, {dec_sum('CASE WHEN credit > 0 THEN credit END')} AS total_credit, count(*) FILTER (credit > 0) AS credits, CAST(sum(CAST(round(credit * 100) AS BIGINT)) AS BIGINT) AS c FROM txn)""",
    (views.TXN,),
)
def corporate_metrics(spark, d):
    return bank.payer_metrics(views.txn(spark, d))


DAYS = "strftime(min(txn_date), '%Y-%m-%d') AS first_day, strftime(max(txn_date), '%Y-%m-%d') AS last_day"


@query(f"SELECT account, count(*) AS n, {dec_sum('debit')} AS debit, {dec_sum('credit')} AS credit, {DAYS} FROM txn GROUP BY account", (views.TXN,))
def account_rollup(spark, d):
    return bank.rollup_accounts(views.txn(spark, d), ["account"], "txn_date")


@query(f"SELECT party, mode, count(*) AS n, {dec_sum('debit')} AS debit, {dec_sum('credit')} AS credit, {DAYS} FROM txn GROUP BY party, mode", (views.TXN,))
def person_rollup(spark, d):
    return bank.rollup_accounts(views.txn(spark, d), ["party", "mode"], "txn_date")


BALANCE = "CAST(sum(CAST(credit - debit AS DECIMAL(18,2))) OVER (PARTITION BY account ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)"


@query(f"SELECT account, arg_max(balance, (txn_date, txn_id)) AS latest_balance FROM (SELECT *, {BALANCE} AS balance FROM txn) GROUP BY account", (views.TXN,))
def latest_balance(spark, d):
    return bank.latest(bank.running_balance(views.txn(spark, d), "account", ["txn_date", "txn_id"]), "account", "balance", ["txn_date", "txn_id"])


@query(
    f"""SELECT party, txn_id, gap_days FROM (SELECT party, txn_id, coalesce(greatest({whole_days('txn_date', 'lag(txn_date) OVER w')}, 0), 0) AS gap_days, count(*) OVER (PARTITION BY party) AS n
    FROM txn WHERE credit > 0 WINDOW w AS (PARTITION BY party ORDER BY txn_date, txn_id)) WHERE n >= 2""",
    (views.TXN,),
)
def party_day_gaps(spark, d):
    return bank.party_gaps(views.txn(spark, d).filter("credit > 0"), "party", "txn_date", ["txn_id"])


RULES = (("nation_3", 40), ("nation_1", 30), ("urgent", 25))
SCORE = "(CASE WHEN mode = '5-LOW' AND credit >= 50000 THEN 40 ELSE 0 END) + (CASE WHEN debit >= 500000 THEN 35 ELSE 0 END)" + "".join(
    f" + (CASE WHEN contains(lower(narration), '{w}') OR contains(lower(party), '{w}') THEN {n} ELSE 0 END)" for w, n in RULES
)
REASONS = "concat_ws('; ', CASE WHEN mode = '5-LOW' AND credit >= 50000 THEN 'large cash deposit' END, CASE WHEN debit >= 500000 THEN 'high value debit' END" + "".join(
    f", CASE WHEN contains(lower(narration), '{w}') OR contains(lower(party), '{w}') THEN 'watched: {w}' END" for w, _ in RULES
) + ")"


def scored(spark, d):
    return bank.risk(views.txn(spark, d), RULES, cash=F.col("mode") == "5-LOW")


@query(f"SELECT txn_id, s AS risk_score, CASE WHEN s >= 70 THEN 'High' WHEN s >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level, reasons FROM (SELECT txn_id, least(100, {SCORE}) AS s, {REASONS} AS reasons FROM txn)", (views.TXN,))
def txn_risk(spark, d):
    return scored(spark, d).select("txn_id", "risk_score", "risk_level", "reasons")


@query("SELECT txn_id, account, party, credit FROM txn WHERE credit > 0 AND lower(party) = 'nation_3' ORDER BY credit DESC, txn_id LIMIT 25 OFFSET 50", (views.TXN,))
def txn_grid_page(spark, d):
    rows = views.txn(spark, d).filter((F.col("credit") > 0) & (F.lower("party") == "nation_3")).select("txn_id", "account", "party", "credit")
    return bank.page(rows, "credit", ["txn_id"], 3, 25)


# Statements as they may come: listed forward, newest first, or either with the rows of a month turned; some balances missing or zero.
LISTED = f""", p AS (SELECT account, txn_id, debit, credit, CAST(date_trunc('month', txn_date) AS DATE) AS day, {BALANCE} AS b, row_number() OVER (PARTITION BY account ORDER BY txn_date, txn_id) AS pos FROM txn),
    l AS (SELECT account, txn_id, CASE WHEN txn_id % 13 = 0 THEN NULL ELSE day END AS day, CAST(round((credit - debit) * 100) AS BIGINT) AS net,
    CASE WHEN txn_id % 7 = 0 THEN NULL WHEN txn_id % 11 = 0 THEN 0 ELSE CAST(round(b * 100) AS BIGINT) END AS c,
    CASE account % 4 WHEN 0 THEN pos WHEN 1 THEN -pos WHEN 2 THEN (year(day) * 12 + month(day)) * 1000 - pos ELSE pos - (year(day) * 12 + month(day)) * 1000 END AS seq FROM p)"""


def vote_sql(then: str, step: str, name: str) -> str:
    return f"""coalesce(c > 0 AND {then} > 0 AND abs({then} - (c + {step})) < 5, false) AS {name}f, coalesce(c > 0 AND {then} > 0 AND abs(c - ({then} + net)) < 5, false) AS {name}r"""


@query(
    LISTED
    + f""", v AS (SELECT *, {vote_sql('lead(c) OVER a', 'lead(net) OVER a', 'a')}, {vote_sql('lead(c) OVER d', 'lead(net) OVER d', 'd')} FROM l WINDOW a AS (PARTITION BY account ORDER BY seq), d AS (PARTITION BY account, day ORDER BY seq)),
    per AS (SELECT account, count(*) FILTER (ar) > count(*) FILTER (af) OR count(*) FILTER (ar) = count(*) FILTER (af) AND coalesce(arg_min(day, seq) FILTER (day IS NOT NULL) > arg_max(day, seq) FILTER (day IS NOT NULL), false) AS flip FROM v GROUP BY account),
    days AS (SELECT account, day, count(*) FILTER (df) AS f, count(*) FILTER (dr) AS r FROM v GROUP BY 1, 2)
    SELECT v.account, txn_id, row_number() OVER (PARTITION BY v.account ORDER BY v.day NULLS FIRST, CASE WHEN CASE WHEN r > f THEN true WHEN f > r THEN false ELSE flip END THEN -seq ELSE seq END) AS row_order
    FROM v JOIN per ON per.account = v.account JOIN days ON days.account = v.account AND days.day IS NOT DISTINCT FROM v.day""",
    (views.TXN,),
)
def order_repair(spark, d):
    rows = bank.running_balance(views.txn(spark, d), "account", ["txn_date", "txn_id"])
    pos = F.row_number().over(trail.Window.partitionBy("account").orderBy("txn_date", "txn_id"))
    rows = rows.withColumn("pos", pos).withColumn("day", F.trunc("txn_date", "month"))
    month, kind = (F.year("day") * 12 + F.month("day")) * 1000, F.col("account") % 4
    seq = F.when(kind == 0, F.col("pos")).when(kind == 1, -F.col("pos")).when(kind == 2, month - F.col("pos")).otherwise(F.col("pos") - month)
    balance = F.when(F.col("txn_id") % 7 == 0, None).when(F.col("txn_id") % 11 == 0, 0.0).otherwise(F.col("balance"))
    rows = rows.select("account", "txn_id", "debit", "credit", seq.alias("seq"), balance.alias("balance"), F.when(F.col("txn_id") % 13 != 0, F.col("day")).alias("day"))
    return bank.repair_order(rows, "account", "seq", "day", "balance").select("account", "txn_id", "row_order")


@query(
    """SELECT txn_id, upper(nullif(regexp_extract(narration, '/([0-9]{12})/', 1), '')) AS utr, lower(nullif(regexp_extract(narration, '[-/]([A-Za-z0-9._]+@[A-Za-z]+)', 1), '')) AS vpa,
    upper(regexp_extract(narration, '^UPI/(IN|OUT)/', 1)) AS direction FROM txn""",
    (views.TXN,),
)
def narration_features(spark, d):
    n = F.col("narration")
    return views.txn(spark, d).select("txn_id", X.utr(n).alias("utr"), X.vpa(n).alias("vpa"), F.upper(F.regexp_extract(n, "^UPI/(IN|OUT)/", 1)).alias("direction"))


def fixed_sql(unit: int) -> str:
    h = f"((c * 200 + {100 * unit}) // {200 * unit})"
    return f"(CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0'))"


@query(
    f"""SELECT o_orderkey, CASE WHEN length(i) > 3 THEN ltrim(reverse(regexp_replace(reverse(left(i, -3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right(i, 3) ELSE i END || '.' || f AS grouped,
    CASE WHEN o_totalprice >= 1e7 THEN {fixed_sql(10_000_000)} || 'Cr' WHEN o_totalprice >= 1e5 THEN {fixed_sql(100_000)} || 'L' WHEN o_totalprice >= 1e3 THEN {fixed_sql(1_000)} || 'K' ELSE {fixed_sql(1)} END AS short
    FROM (SELECT o_orderkey, o_totalprice, CAST(round(o_totalprice * 100) AS BIGINT) AS c, split_part(format('{{:.2f}}', o_totalprice), '.', 1) AS i, split_part(format('{{:.2f}}', o_totalprice), '.', 2) AS f FROM orders)"""
)
def inr_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.group_indian(F.col("o_totalprice")).alias("grouped"), X.short_inr(F.col("o_totalprice")).alias("short"))


# --- trail ------------------------------------------------------------------------------------------------------


@query(
    """SELECT d.utr, d.sender, c.recipient, d.amount FROM (SELECT o_orderkey // 2 AS utr, o_custkey AS sender, o_totalprice AS amount FROM orders WHERE o_orderkey % 2 = 1) d
    JOIN (SELECT o_orderkey // 2 AS utr, o_custkey AS recipient FROM orders WHERE o_orderkey % 2 = 0) c ON d.utr = c.utr WHERE d.sender <> c.recipient"""
)
def direct_utr_match(spark, d):
    rows = views.txn(spark, d).withColumn("utr", F.expr("txn_id div 2"))
    out = trail.match_reference(rows.filter("debit > 0").withColumn("amount", F.col("debit")), rows.filter("txn_id % 2 = 0").withColumn("amount", F.col("credit")), "utr", "account", "amount", [])
    return out.select("utr", "sender", "recipient", "amount")


@query(
    """, d AS (SELECT holder AS sender, CAST(txn_date AS DATE) AS day, floor(debit / 1000) AS amount, party, txn_id FROM txn WHERE txn_id % 2 = 1),
    c AS (SELECT holder AS recipient, CAST(txn_date AS DATE) AS day, floor(credit / 1000) AS amount, party, txn_id FROM txn WHERE txn_id % 2 = 0)
    SELECT d.txn_id AS debit_row, c.txn_id AS credit_row, d.amount FROM d JOIN c ON d.day = c.day AND d.amount = c.amount WHERE sender <> recipient AND right(sender, 1) = right(recipient, 1)""",
    (views.TXN,),
)
def direct_fallback_match(spark, d):
    # A person's name and what a debit says of the other side have the last digit of the holder's name as a token.
    rows = views.txn(spark, d)
    token = F.concat(F.lit("grp"), F.substring("holder", -1, 1))
    leg = lambda odd, amount, said: rows.filter(F.col("txn_id") % 2 == odd).select(
        F.concat_ws(" ", token, "holder").alias("person"), F.to_date("txn_date").alias("day"), F.floor(F.col(amount) / 1000).alias("amount"), F.concat(F.lit(said), token).alias("said"), "txn_id"
    )
    found = trail.match_fallback(leg(1, "debit", "paid to "), leg(0, "credit", "by "), "person", "day", "amount", "said", "txn_id")
    return found.select(F.col("debit_row"), F.col("credit_row"), "amount")


SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
HOPS = f""", i AS (SELECT account, event_id AS in_row, {SEC} AS t_in, amount AS in_amount, CAST(round(amount * 100) AS BIGINT) AS ic FROM flow WHERE leg = 'IN'),
    o AS (SELECT account, event_id AS out_row, {SEC} AS t_out, amount AS out_amount, CAST(round(amount * 100) AS BIGINT) AS oc FROM flow WHERE leg = 'OUT'),
    hops AS (SELECT account, in_row, out_row, in_amount, out_amount, (ic - oc) / 100.0 AS retained, CASE WHEN in_amount > 0 THEN ((20000 * (ic - oc) + ic) // (2 * ic)) / 100.0 ELSE 0.0 END AS retained_pct,
    t_out - t_in AS gap_seconds, CASE WHEN t_out - t_in <= 86400 THEN 'RAPID_LAYERING' ELSE 'DELAYED' END AS tier FROM i JOIN o USING (account)
    WHERE t_out >= t_in AND out_amount <= in_amount AND t_out - t_in <= 3 * 86400)"""


def hops(spark, d):
    rows = views.flow(spark, d)
    return trail.conduits(rows.filter("leg = 'IN'"), rows.filter("leg = 'OUT'"), "account", "ts", "amount", "event_id")


@query(HOPS + " SELECT * FROM hops", (views.FLOW,))
def conduit_hops(spark, d):
    return hops(spark, d)


@query(
    HOPS + f""", g AS (SELECT account, count(*) AS hops, {dec_sum('out_amount')} AS volume, {dec_sum('retained')} AS retained, min(gap_seconds) AS fastest FROM hops GROUP BY account),
    s AS (SELECT *, CASE WHEN retained > 0 THEN least(100, CAST(round(retained * 100) AS BIGINT) // 50000) ELSE 5 END AS v,
    CASE WHEN fastest <= 43200 THEN 98 WHEN fastest <= 86400 THEN 90 WHEN fastest <= 172800 THEN 75 WHEN fastest <= 259200 THEN 60 ELSE greatest(20, 100 - (fastest + 8639) // 8640) END AS w FROM g)
    SELECT account, hops, volume, retained, fastest, CAST(v AS INTEGER) AS value_score, CAST(w AS INTEGER) AS velocity_score, CAST(least(99, greatest(10, (4 * v + 3 * w + 300) // 10)) AS INTEGER) AS composite FROM s""",
    (views.FLOW,),
)
def conduit_groups(spark, d):
    return trail.conduit_groups(hops(spark, d), "account")


@query("SELECT e.src AS a, e.dst AS b, e.amount AS there, f.amount AS back FROM edge e JOIN edge f ON e.src = f.dst AND e.dst = f.src AND e.src <> e.dst", (views.EDGE,))
def round_trips(spark, d):
    return trail.round_trips(views.edge(spark, d), "src", "dst", "amount")


LEG = "SELECT account, event_id, {sec} AS t, amount, CAST(round(amount * 100) AS BIGINT) AS c, lower(trim(coalesce(party, ''))) AS p FROM flow WHERE leg = '{leg}' AND amount >= 1 AND party IS NOT NULL AND party <> holder"


@query(
    f""", o AS ({LEG.format(sec=SEC, leg="OUT")}), i AS ({LEG.format(sec=SEC, leg="IN")}),
    k AS (SELECT o.account, o.event_id AS out_row, i.event_id AS in_row, o.amount AS out_amount, i.amount AS in_amount, greatest(0, o.c - i.c) AS kept, o.c AS oc, i.t - o.t AS gap,
    row_number() OVER (PARTITION BY o.account, o.t, i.t, o.amount ORDER BY o.event_id, i.event_id) AS place FROM o JOIN i ON o.account = i.account AND i.t >= o.t AND i.t - o.t <= 2 * 86400
    AND (i.p = o.p OR length(i.p) >= 4 AND contains(o.p, i.p) OR length(o.p) >= 4 AND contains(i.p, o.p)))
    SELECT account, out_row, in_row, out_amount, in_amount, kept / 100.0 AS retained, CASE WHEN oc > 0 THEN ((2000 * kept + oc) // (2 * oc)) / 10.0 ELSE 0.0 END AS retained_pct, greatest(0.1, ((20 * gap + 3600) // 7200) / 10.0) AS gap_hours FROM k WHERE place = 1""",
    (views.FLOW,),
)
def kickback_pairs(spark, d):
    rows = views.flow(spark, d)
    return trail.kickbacks(rows.filter("leg = 'OUT'"), rows.filter("leg = 'IN'"), "account", "ts", "amount", "event_id", "party", 2, 1.0, "holder")


@query(
    f"""SELECT s.n_name AS sender, r.n_name AS recipient, CAST(coalesce(e.transfers, 0) AS BIGINT) AS transfers, coalesce(e.amount, 0.0) AS volume FROM nation s CROSS JOIN nation r
    LEFT JOIN edge e ON e.src = s.n_name AND e.dst = r.n_name""",
    (views.EDGE,),
)
def pair_matrix(spark, d):
    return trail.pair_matrix(table(spark, d, "nation"), views.edge(spark, d), "n_name", "src", "dst", "transfers", "amount")


@query(
    HOPS + """ SELECT account, in_row, out_row, retained, 'L' || row_number() OVER w AS leg, CAST(sum(CAST(retained AS DECIMAL(18,2))) OVER (PARTITION BY account ORDER BY in_row, out_row ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
    FROM hops WINDOW w AS (PARTITION BY account ORDER BY in_row, out_row)""",
    (views.FLOW,),
)
def beats(spark, d):
    return trail.beats(hops(spark, d).select("account", "in_row", "out_row", "retained"), "account", ["in_row", "out_row"], "retained")


@query()
def rapid_layering(spark, d):
    return trail.rapid_layering(views.flow(spark, d), "account", "ts", "amount", "leg", "party", "event_id", least=1.0, holder="holder")


@query()
def pass_through_patterns(spark, d):
    return trail.pass_through(views.flow(spark, d), "account", "ts", "amount", "leg", "party", ["event_id"], least=1.0)


# --- graph ------------------------------------------------------------------------------------------------------


@query("SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(src || '>' || dst, (amount, transfers, src)) AS dominant, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS weight, CAST(sum(transfers) AS BIGINT) AS evidence, count(DISTINCT src) > 1 AS both_ways FROM edge GROUP BY 1, 2", (views.EDGE,))
def merged_edges(spark, d):
    return graph.merge_parallel(views.edge(spark, d), "src", "dst", "amount", "transfers")


@query("SELECT count(DISTINCT least(src, dst) || '|' || greatest(src, dst)) AS pairs, count(*) AS edges FROM edge", (views.EDGE,))
def unordered_pairs(spark, d):
    return graph.unordered_pairs(views.edge(spark, d), "src", "dst")


@query(
    """, u AS (SELECT src AS a, dst AS b FROM redge UNION SELECT dst, src FROM redge), h1 AS (SELECT DISTINCT b FROM u WHERE a = 'NATION_0'),
    h2 AS (SELECT DISTINCT u.b FROM h1 JOIN u ON u.a = h1.b WHERE u.b <> 'NATION_0' AND u.b NOT IN (SELECT b FROM h1))
    SELECT 'NATION_0' AS name, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2""",
    (views.EDGE, views.REGION_EDGE),
)
def bfs(spark, d):
    return graph.neighbourhood(views.region_edge(spark, d), "src", "dst", "NATION_0", 2)


@query(
    """, e AS (SELECT src, dst, src || '>' || dst AS id FROM redge UNION ALL SELECT dst, src, src || '>' || dst FROM redge), w1 AS (SELECT ['NATION_0', dst] AS p FROM e WHERE src = 'NATION_0'),
    w2 AS (SELECT list_append(p, dst) AS p FROM w1 JOIN e ON e.src = p[-1] WHERE p[-1] <> 'NATION_10' AND NOT list_contains(p, dst)),
    w3 AS (SELECT list_append(p, dst) AS p FROM w2 JOIN e ON e.src = p[-1] WHERE p[-1] <> 'NATION_10' AND NOT list_contains(p, dst))
    SELECT array_to_string(p, '>') AS path, CAST(len(p) - 1 AS INTEGER) AS length FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) WHERE p[-1] = 'NATION_10'""",
    (views.EDGE, views.REGION_EDGE),
)
def paths(spark, d):
    return graph.paths(views.region_edge(spark, d), "src", "dst", "NATION_0", "NATION_10", 3, F.concat_ws(">", "src", "dst")).select("path", "length")


@query(
    """, e AS (SELECT DISTINCT src, dst FROM redge), w2 AS (SELECT [src, dst] AS p FROM e),
    w3 AS (SELECT list_append(p, dst) AS p FROM w2 JOIN e ON e.src = p[-1] WHERE NOT list_contains(p, dst)),
    w4 AS (SELECT list_append(p, dst) AS p FROM w3 JOIN e ON e.src = p[-1] WHERE NOT list_contains(p, dst)),
    w5 AS (SELECT list_append(p, dst) AS p FROM w4 JOIN e ON e.src = p[-1] WHERE NOT list_contains(p, dst)),
    c AS (SELECT p FROM (SELECT p FROM w2 UNION ALL SELECT p FROM w3 UNION ALL SELECT p FROM w4 UNION ALL SELECT p FROM w5) JOIN e ON e.src = p[-1] AND e.dst = p[1] WHERE p[1] = list_min(p))
    SELECT array_to_string(list_sort(p), ',') AS members, min(array_to_string(p, '>')) AS cycle, CAST(any_value(len(p)) AS INTEGER) AS nodes FROM c GROUP BY 1""",
    (views.EDGE, views.REGION_EDGE),
)
def cycles(spark, d):
    return graph.cycles(views.region_edge(spark, d), "src", "dst")


@query(
    """WITH m AS (SELECT o_custkey AS entity, 'bank' AS module FROM orders UNION ALL SELECT user_id, 'events' FROM events UNION ALL SELECT l_suppkey, 'ledger' FROM lineitem UNION ALL SELECT doc_id, 'verify' FROM documents)
    SELECT entity, count(DISTINCT module) AS modules, array_to_string(list_sort(list_distinct(list(module))), ',') AS which, 'HIGH' AS level, 85 AS risk FROM m GROUP BY entity HAVING count(DISTINCT module) >= 3"""
)
def module_alerts(spark, d):
    part = lambda t, c, m: table(spark, d, t).select(F.col(c).cast("long").alias("entity"), F.lit(m).alias("module"))
    rows = part("orders", "o_custkey", "bank").unionByName(part("events", "user_id", "events")).unionByName(part("lineitem", "l_suppkey", "ledger")).unionByName(part("documents", "doc_id", "verify"))
    return graph.module_alerts(rows, "entity", "module")


@query(
    """WITH f AS (SELECT c_custkey % 50 AS src, c_nationkey AS dst, c_mktsegment AS rel, c_custkey // 2 AS ev, round(c_acctbal) AS w, CAST(c_custkey % 7 AS INTEGER) AS conf FROM customer),
    o AS (SELECT src, dst, rel, ev, max(w) AS w, max(conf) AS conf FROM f GROUP BY 1, 2, 3, 4)
    SELECT src, dst, rel, CAST(sum(CAST(w AS DECIMAL(18,2))) AS DOUBLE) AS weight, max(conf) AS confidence, count(*) AS evidence FROM o GROUP BY 1, 2, 3"""
)
def edge_upsert(spark, d):
    c = table(spark, d, "customer").select(
        (F.col("c_custkey") % 50).alias("src"), F.col("c_nationkey").alias("dst"), F.col("c_mktsegment").alias("rel"), F.expr("c_custkey div 2").alias("ev"), F.round("c_acctbal").alias("w"), (F.col("c_custkey") % 7).cast("int").alias("conf")
    )
    return graph.upsert_edges(c, ["src", "dst", "rel"], "ev", "w", "conf")


@query(
    """WITH e AS (SELECT DISTINCT c_custkey AS id, unnest([lower(c_mktsegment) || (c_custkey % 40), 'n' || c_nationkey || '-' || (c_custkey % 30)]) AS k FROM customer), f AS (SELECT * FROM e WHERE length(k) >= 3)
    SELECT l.id AS a, r.id AS b, count(*) AS shared, array_to_string(list_sort(list(l.k)), ',') AS keywords FROM f l JOIN f r ON l.k = r.k AND l.id < r.id GROUP BY 1, 2"""
)
def profile_keyword_nexus(spark, d):
    key = F.col("c_custkey")
    words = F.array(F.concat(F.lower("c_mktsegment"), (key % 40).cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("-"), (key % 30).cast("string")))
    return graph.keyword_nexus(table(spark, d, "customer").select("c_custkey", words.alias("keywords")), "c_custkey", "keywords")


@query(
    f"""SELECT v.s_suppkey, v.s_name, t.party, CASE WHEN debit > 0 THEN 'OUT' ELSE 'IN' END AS direction, count(*) AS n, {dec_sum('debit + credit')} AS volume
    FROM txn t JOIN supplier v ON regexp_replace(t.holder, '[^0-9]', '', 'g') = regexp_replace(v.s_name, '[^0-9]', '', 'g') GROUP BY 1, 2, 3, 4""",
    (views.TXN,),
)
def vendor_txn_nexus(spark, d):
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return graph.vendor_nexus(
        views.txn(spark, d), table(spark, d, "supplier"), digits("holder"), digits("s_name"), ["party"], ["s_suppkey", "s_name"], F.when(F.col("debit") > 0, "OUT").otherwise("IN"), F.col("debit") + F.col("credit")
    )


@query(
    """, n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS node FROM (SELECT src AS name FROM edge UNION SELECT dst FROM edge))
    SELECT a.node AS source, b.node AS target, amount AS value FROM edge JOIN n a ON src = a.name JOIN n b ON dst = b.name""",
    (views.EDGE,),
)
def sankey(spark, d):
    return graph.sankey(views.edge(spark, d), "src", "dst", "amount")


SUFFIX_SQL = "lower(trim(s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Enterprises' WHEN 2 THEN ' Inc' ELSE '' END))"


def canonical_sql() -> str:
    from casefile.params import LEGAL_SUFFIXES

    out = SUFFIX_SQL
    for s in LEGAL_SUFFIXES:
        out = f"regexp_replace({out}, '{s}', ' ', 'g')"
    return f"upper(trim(regexp_replace(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')))"


@query(f"SELECT s_suppkey, {canonical_sql()} AS key FROM supplier")
def entity_clean(spark, d):
    k = F.col("s_suppkey") % 4
    name = F.concat("s_name", F.when(k == 0, " Pvt. Ltd.").when(k == 1, " Enterprises").when(k == 2, " Inc").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", X.canonical_name(name).alias("key"))


@query()
def entity_resolve(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_mktsegment"), F.lit(" Traders Ltd"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.col("c_mktsegment"), F.lit(" Trader"))).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" Tradars")))
    return graph.resolve(c.select("c_custkey", name.alias("name")), "c_custkey", "name")


def each_entity(kind: str, pattern: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, lower(unnest(regexp_extract_all(text, '{pattern}'))) AS entity FROM documents"


@query(
    "WITH e AS ("
    + " UNION ALL ".join([each_entity("EMAIL", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"), each_entity("PHONE", "\\b[0-9]{10}\\b"), each_entity("URL", "https?://[A-Za-z0-9./_-]+")])
    + ") SELECT doc_id, kind, entity, count(*) AS hits FROM e GROUP BY 1, 2, 3"
)
def entity_extract(spark, d):
    return graph.extract_entities(table(spark, d, "documents"), "doc_id", "text")


# --- screening --------------------------------------------------------------------------------------------------


def count_sql(source: str, id_col: str, text: str) -> str:
    each = " UNION ALL ".join(f"SELECT {id_col}, '{k}' AS keyword, CAST((length(lower({text})) - length(replace(lower({text}), '{k}', ''))) // {len(k)} AS INTEGER) AS hits FROM {source}" for k in KEYWORDS)
    return f"SELECT * FROM ({each}) WHERE hits > 0"


@query(count_sql("documents", "doc_id", "text"))
def keyword_hits(spark, d):
    return screening.count_keywords(table(spark, d, "documents"), "doc_id", "text", KEYWORDS)


@query(f"SELECT keyword, count(*) AS pages, CAST(sum(hits) AS BIGINT) AS hits, min(page_id) AS first_page FROM ({count_sql('pages', 'page_id', 'html')}) GROUP BY keyword")
def keyword_pages(spark, d):
    return screening.keyword_pages(table(spark, d, "pages"), "page_id", "html", KEYWORDS)


@query(f"SELECT doc_id, hits FROM (SELECT doc_id, concat_ws(',', {', '.join(f'''CASE WHEN contains(upper(text), '{k.upper()}') THEN '{k.upper()}' END''' for k in KEYWORDS)}) AS hits FROM documents) WHERE hits <> ''")
def keyword_list(spark, d):
    return screening.listed_hits(table(spark, d, "documents"), "doc_id", "text", KEYWORDS)


def hit_sql(term: str) -> str:
    # RE2 knows word boundaries of ASCII only.
    return f"regexp_matches(lower(text), '(^|[^\\pL\\pN_]){term}($|[^\\pL\\pN_])')"


CHAT_SCORE = " + ".join(f"(CASE WHEN {hit_sql(t)} THEN {w} ELSE 0 END)" for t, w in WATCH)
CHAT = f"chat AS (SELECT conv_id, turn, role, concat_ws(',', {', '.join(f'''CASE WHEN {hit_sql(t)} THEN '{t}' END''' for t, _ in WATCH)}) AS flagged, CASE WHEN {CHAT_SCORE} > 0 THEN least(100, greatest(50, {CHAT_SCORE})) ELSE 0 END AS risk_score FROM conversations)"


def chat_rows(spark, d):
    return screening.chat(table(spark, d, "conversations"), "text", WATCH)


@query("SELECT conv_id, turn, flagged, risk_score FROM chat", (CHAT,))
def chat_screening(spark, d):
    return chat_rows(spark, d).select("conv_id", "turn", "flagged", "risk_score")


@query(
    """SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_seq, role) AS seen_as FROM (SELECT conv_id, role, count(*) AS messages, count(*) FILTER (risk_score >= 50) AS flagged, min(turn) AS first_seq, max(turn) AS last_seq
    FROM chat GROUP BY conv_id, role)""",
    (CHAT,),
)
def chat_participants(spark, d):
    return screening.participants(chat_rows(spark, d), "conv_id", "role", "turn")


@query("SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS senders, count(*) FILTER (risk_score >= 50) AS flagged, max(risk_score) AS max_risk, CASE WHEN count(DISTINCT role) <= 2 THEN 'DM' ELSE 'GROUP' END AS kind FROM chat GROUP BY conv_id", (CHAT,))
def chat_dashboard(spark, d):
    return screening.channels(chat_rows(spark, d), "conv_id", "role")


FLAT = [(i, kw, w) for i, kws in INTENTS for kw, w in kws]
RANKED = sorted(enumerate(FLAT), key=lambda x: (-x[1][2], x[0]))


@query(
    f"""SELECT conv_id, turn, CASE {' '.join(f"WHEN {hit_sql(kw)} THEN '{i}'" for _, (i, kw, _) in RANKED)} ELSE 'General' END AS intent, CASE {' '.join(f"WHEN {hit_sql(kw)} THEN {w}" for _, (_, kw, w) in RANKED)} ELSE 0 END AS risk,
    {' + '.join(f"CAST({hit_sql(kw)} AS INTEGER)" for _, kw, _ in FLAT)} AS hits FROM conversations"""
)
def voice_intent(spark, d):
    return screening.voice_intent(table(spark, d, "conversations"), "text", INTENTS).select("conv_id", "turn", "intent", "risk", "hits")


MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
FLAGS = ["is_currency", "is_personal", "is_external", "is_bank", "is_upi", "is_keyword"]


def checked(spark, d):
    return screening.mail_checkpoints(table(spark, d, "documents"), "text", webmail=("mail5.example.com", "mail1.example.com"), own=("mail2.example.com",), bank=("license", "public"), keywords=("secret", "under"))


def mail_sql() -> str:
    domains = f"list_transform(regexp_extract_all(text, '{MAIL}'), lambda x: lower(split_part(x, '@', 2)))"
    currency = r"(?i)([₹$€£]\s*[\d,]+(\.\d+)?)|(\b(inr|rs\.?|usd|eur|gbp)\s*[\d,]+(\.\d+)?)|([\d,]+(\.\d+)?\s*(lakhs?|crores?|lacs?|cr\.?|inr|usd|eur|dollars?|rupees?))"
    upi = "', '".join(("phonepe.com", "google.com", "paytm.com", "cred.club", "razorpay.com", "npci.org.in", "bhimupi.org.in"))
    return f"""m AS (SELECT doc_id, regexp_matches(text, '{currency}') AS is_currency, list_has_any(dm, ['mail5.example.com', 'mail1.example.com']) AS is_personal, len(list_filter(dm, lambda x: x <> 'mail2.example.com')) > 0 AS is_external,
    contains(lower(text), 'license') OR contains(lower(text), 'public') AS is_bank, list_has_any(dm, ['{upi}']) OR contains(lower(text), 'upi') AS is_upi, contains(lower(text), 'secret') OR contains(lower(text), 'under') AS is_keyword
    FROM (SELECT doc_id, text, {domains} AS dm FROM documents))"""


@query("SELECT * FROM m", (mail_sql(),))
def mail_checkpoints(spark, d):
    return checked(spark, d).select("doc_id", *FLAGS)


@query(f"SELECT {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in FLAGS)}, count(*) FILTER ({' OR '.join(FLAGS)}) AS flagged FROM m", (mail_sql(),))
def mail_summary(spark, d):
    return screening.checkpoint_summary(checked(spark, d), FLAGS)


@query(f"SELECT address, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '{MAIL}'))) AS address FROM documents) GROUP BY address ORDER BY n DESC, address LIMIT 100")
def participants_top(spark, d):
    return screening.top_addresses(table(spark, d, "documents"), "text")


SCAN = ("license", "secret", "src7", "audit")


def scanned(spark, d):
    return screening.scan(table(spark, d, "documents"), "doc_id", "source", "text", SCAN)


def scan_sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT doc_id, source, '{k}' AS keyword, CASE WHEN contains(lower(source), '{k}') THEN 'NAME' WHEN contains(lower(text), '{k}') THEN 'CONTENT' END AS match_type,
        CASE WHEN NOT contains(lower(source), '{k}') AND strpos(lower(text), '{k}') > 0 THEN trim(regexp_replace(substr(text, greatest(1, strpos(lower(text), '{k}') - 45), strpos(lower(text), '{k}') - greatest(1, strpos(lower(text), '{k}') - 45) + {len(k)} + 45), '[\\s]+', ' ', 'g')) END AS snippet,
        {85 if k in ('secret',) else 65 if k in ('audit',) else 45} AS base FROM documents"""
        for k in SCAN
    )
    return f"scan AS (SELECT doc_id, source, keyword, match_type, snippet, CASE WHEN match_type = 'CONTENT' THEN least(99, base + 5) ELSE base END AS risk FROM ({each}) WHERE match_type IS NOT NULL)"


@query("SELECT * FROM scan", (scan_sql(),))
def scan_hits(spark, d):
    return scanned(spark, d)


@query("SELECT keyword, count(*) AS files, max(risk) AS max_risk FROM scan GROUP BY keyword ORDER BY files DESC, keyword LIMIT 10", (scan_sql(),))
def top_keywords(spark, d):
    return screening.top_keywords(scanned(spark, d))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s]+', ' ', 'g')) AS text FROM pages")
def xml_strip(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query()
def fuzzy_search(spark, d):
    return screening.fuzzy(table(spark, d, "part"), "p_name", ("widgit", "red ring", "bolt")).select("p_partkey", "fuzzy_score", "fuzzy_keyword")


@query(
    f"""WITH s AS (SELECT conv_id, turn, n, trim(sentence) AS sentence FROM (SELECT conv_id, turn, unnest(range(len(p))) AS n, unnest(p) AS sentence FROM
    (SELECT conv_id, turn, string_split(regexp_replace(trim(text, ' '), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM conversations)) WHERE trim(sentence) <> ''),
    c AS (SELECT *, greatest(400, len(string_split_regex(sentence, '\\s+')) * 45) AS c FROM s)
    SELECT conv_id, turn, CAST(n AS INTEGER) AS n, sentence, c / 100.0 AS seconds, sum(c) OVER w / 100.0 AS ends, (sum(c) OVER w - c) / 100.0 AS starts FROM c WINDOW w AS (PARTITION BY conv_id, turn ORDER BY n ROWS UNBOUNDED PRECEDING)"""
)
def transcript_segments(spark, d):
    out = screening.segments(table(spark, d, "conversations"), "conv_id", "text", ["turn"])
    return out.select("conv_id", "turn", "n", F.trim("sentence").alias("sentence"), "seconds", "ends", "starts")


@query(
    """WITH r AS (SELECT CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS custodian, CAST(coalesce(quality, 0) AS BIGINT) * 100 AS score, CASE WHEN quality IS NULL THEN 0 ELSE n_chars END AS w FROM documents LEFT JOIN labels USING (doc_id))
    SELECT coalesce(nullif(trim(custodian), ''), 'Unassigned') AS custodian, count(*) AS items, CASE WHEN sum(w) > 0 THEN CAST((CAST(sum(score * w) AS BIGINT) * 20 + CAST(sum(w) AS BIGINT)) // (2 * CAST(sum(w) AS BIGINT)) AS BIGINT) / 10.0 ELSE 100.0 END AS mean_score FROM r GROUP BY 1"""
)
def custodian_rollup(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select(F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("custodian"), (F.coalesce("quality", F.lit(0)).cast("long") * 100).alias("score"), F.when(F.col("quality").isNull(), 0).otherwise(F.col("n_chars")).alias("w"))
    return screening.rollup_custodians(rows, "custodian", "score", "w")


META = f"""meta AS (SELECT l_orderkey, l_linenumber, l_shipdate AS created, o_orderdate AS modified, CASE l_orderkey % 5 WHEN 0 THEN 'Adobe Photoshop' WHEN 1 THEN 'iLovePDF' ELSE 'Writer' END AS software, CAST(l_linenumber % 3 AS INTEGER) AS updates
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    p AS (SELECT *, greatest(0, 100 - (CASE WHEN epoch(created) - epoch(modified) > 60 THEN 35 ELSE 0 END) - (CASE WHEN created > TIMESTAMP '2001-01-02' OR modified > TIMESTAMP '2001-01-02' THEN 30 ELSE 0 END)
    - (CASE WHEN epoch(modified) - epoch(created) > 180 * 86400 THEN 15 ELSE 0 END) - (CASE software WHEN 'Adobe Photoshop' THEN 35 WHEN 'iLovePDF' THEN 25 ELSE 0 END) - least(30, 15 * updates)) AS score FROM meta)"""


def scored_documents(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    five = F.col("l_orderkey") % 5
    software = F.when(five == 0, "Adobe Photoshop").when(five == 1, "iLovePDF").otherwise("Writer")
    rows = rows.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("created"), F.col("o_orderdate").alias("modified"), software.alias("software"), (F.col("l_linenumber") % 3).cast("int").alias("updates"))
    return screening.authenticity(rows, "created", "modified", "software", "updates", F.to_timestamp(F.lit(AS_OF)))


LEVEL = "CASE WHEN score >= 80 THEN 'AUTHENTIC' WHEN score >= 50 THEN 'SUSPICIOUS' ELSE 'HIGH_RISK_TAMPERED' END"


@query(f"SELECT l_orderkey, l_linenumber, CAST(score AS INTEGER) AS score, {LEVEL} AS level FROM p", (META,))
def authenticity(spark, d):
    return scored_documents(spark, d).select("l_orderkey", "l_linenumber", "score", "level")


@query(f"SELECT {LEVEL} AS level, count(*) AS n FROM p GROUP BY 1", (META,))
def risk_distribution(spark, d):
    return scored_documents(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def scope_semijoin(spark, d):
    bridge = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return grid.in_scope(table(spark, d, "customer"), bridge, "c_custkey", ["1-URGENT"], "o_orderpriority").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exclude_antijoin(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return grid.without(table(spark, d, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey")
