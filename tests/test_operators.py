"""Operators on small evidence with results worked out by hand, and the registry against its SQL."""

import datetime as dt
import glob
import math
import os
import random
from decimal import Decimal

import pandas as pd
import pytest
from casefile.functions import text as X
from casefile.operators import bank, cases, entities, graph, grid, linking, naming, procurement, screening, trail
from casefile.plans import registry, registry_cases, registry_graph, registry_names, registry_records, registry_small, registry_sources  # noqa: F401  (register their queries)
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("amount", "want"), [(1000.0, "1,000.00"), (150000.0, "1,50,000.00"), (12345678.5, "1,23,45,678.50"), (-50000.0, "-50,000.00"), (999.0, "999.00")])
def test_indian_grouping(spark, amount, want):
    assert one(spark, X.group_indian(F.col("a")), a=amount) == want


@pytest.mark.parametrize(("amount", "want"), [(12500000.0, "1.25Cr"), (112500.0, "1.13L"), (1500.0, "1.50K"), (12.0, "12.00")])
def test_short_amounts(spark, amount, want):
    assert one(spark, X.short_inr(F.col("a")), a=amount) == want


def test_narration_features(spark):
    n = F.col("n")
    assert one(spark, X.utr(n), n="UPI-123456789012-NAME-user@bank-PAYMENT") == "123456789012"
    assert one(spark, X.utr(n), n="NEFT DR-hdfcn00123456789-NAME") == "HDFCN00123456789"
    assert one(spark, X.utr(n), n="CASH 1234567890123") is None
    assert one(spark, X.vpa(n), n="UPI/OUT/1/User.A@OkBank/UPI") == "user.a@okbank"
    assert one(spark, X.ifsc(n), n="TO HDFC0001234 X") == "HDFC0001234"


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, X.canonical_name(t), t="ABC Solutions Pvt. Ltd.") == "ABC"
    assert one(spark, X.slug(t), t="  A-b C! ") == "a_b_c"
    assert one(spark, X.mail_domain(t), t="P One <p.one@Mail.Example.com>") == "mail.example.com"
    assert one(spark, X.strip_tags(t), t="<p>a<b>b</b>\n c</p>") == "a b c"
    assert one(spark, X.keyword_count(t, "aa"), t="AAaa aa") == 3
    assert one(spark, X.snippet(t, F.lit("KEY"), 3), t="abcdef\n key  uvw") == "f key u"
    assert one(spark, X.snippet(t, F.lit("none")), t="abc") is None
    assert one(spark, F.array_join(X.token_bag(t), " "), t="precision ball bearing ball") == "ball bearing precision"
    assert one(spark, X.file_size(F.col("t")), t=1536.0) == "1.50 KB"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("kickback", "kick back"), ("sarla", "sarala"), ("hawala", "havala"), ("", "a"), ("abc", "xyz")])
def test_indel_ratio(spark, a, b):
    assert one(spark, X.indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def day(*a):
    return dt.datetime(*a)


def test_receipts(spark):
    rows = [(1, 1, day(2022, 1, 1), day(2023, 1, 1)), (1, 2, day(2022, 1, 1), day(2024, 6, 1)), (1, 3, day(2024, 6, 1), day(2024, 6, 2))]
    df = spark.createDataFrame(rows, "m int, line int, po_date timestamp, pstng timestamp")
    late = procurement.late_receipts(df, "po_date", "pstng", ["m", "line"])
    assert {tuple(r) for r in late.collect()} == {(1, 2, 882)}
    gaps = procurement.receipt_gaps(df, ["m"], "pstng", ["line"], ["line"])
    assert {tuple(r) for r in gaps.collect()} == {(1, "before_gap"), (2, "after_gap")}


def test_open_order_and_stagnant_price(spark):
    df = spark.createDataFrame([(1, day(2022, 1, 1), 50, 4.0, 9.5), (1, day(2022, 1, 1), 50, 6.0, 9.5), (2, day(2024, 12, 1), 5, 1.0, 9.5)], "po int, d timestamp, q int, g double, p double")
    got = procurement.open_orders(df, ["po"], "d", "q", "g", F.lit(day(2025, 1, 1))).collect()
    assert [(r.po, r.remaining) for r in got] == [(1, 40.0)]
    stale = procurement.stagnant_prices(df, ["p"], "d").collect()
    assert [(r.p, r.orders, r.span_days) for r in stale] == [(9.5, 3, 1065)]


def test_upsert_keeps_what_is_not_blank(spark):
    old = spark.createDataFrame([(1, "A", "x", True), (2, "B", "y", False)], "code int, name string, phone string, flag boolean")
    new = spark.createDataFrame([(1, " ", "z"), (3, "C", None)], "code int, name string, phone string")
    got = {tuple(r) for r in procurement.upsert_vendors(old, new, "code", ["name", "phone"], "flag").collect()}
    assert got == {(1, "A", "z", True), (2, "B", "y", False), (3, "C", None, False)}


def test_order_repair_of_a_reversed_statement(spark):
    rows = [("x", 1, day(2024, 1, 1, 12), 130.0, 0.0, 30.0), ("x", 2, day(2024, 1, 1, 12), 100.0, 50.0, 0.0), ("x", 3, day(2024, 1, 1, 12), 150.0, 0.0, 50.0)]
    rows += [("y", 1, day(2024, 1, 1), 100.0, 0.0, 0.0), ("y", 2, day(2024, 1, 2), 90.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "acc string, seq long, d timestamp, balance double, debit double, credit double")
    got = {(r.acc, r.seq): r.row_order for r in bank.repair_order(df, "acc", "seq", "d", "balance").collect()}
    assert got == {("x", 3): 1, ("x", 2): 2, ("x", 1): 3, ("y", 1): 1, ("y", 2): 2}


def test_risk(spark):
    df = spark.createDataFrame([("cash deposit", "p", 0.0, 75000.0), ("wire", "Big Corp", 600000.0, 0.0), (None, None, 1.0, 0.0)], "narration string, party string, debit double, credit double")
    got = [(r.risk_score, r.risk_level, r.reasons) for r in bank.risk(df, [("corp", 40)]).collect()]
    assert got == [(40, "Medium", "large cash deposit"), (75, "High", "high value debit; watched: corp"), (0, "Low", "")]


FLOW = "k string, id int, ts timestamp, amount double, leg string, party string, holder string"


def layered(spark, rows, **kw):
    df = spark.createDataFrame([(k, i, ts, float(a), leg, party, "Me") for k, i, ts, a, leg, party in rows], FLOW)
    return trail.rapid_layering(df, "k", "ts", "amount", "leg", "party", "id", holder="holder", **kw)


def test_allocation_by_hand(spark):
    """+30000 from P1, then 4000 and 25000 go on to others; a later 5000 has nothing left to go with it."""
    d = day(2024, 1, 1)
    rows = [("a", 1, d, 30_000, "IN", "P1"), ("a", 2, d, 4_000, "OUT", "P2"), ("a", 3, d, 25_000, "OUT", "P3"), ("a", 4, d, 5_000, "IN", "P4"), ("a", 5, d, 9_000, "OUT", "me"), ("a", 6, d, 7_000, "OUT", "p4")]
    got = [tuple(r) for r in layered(spark, rows).orderBy("in_row", "out_row").collect()]
    assert got == [("a", 1, 2, "p1", "p2", 4000.0, 4000.0, 0.0, 0.0, 0.5), ("a", 1, 3, "p1", "p3", 25000.0, 25000.0, 0.0, 0.0, 0.5), ("a", 1, 6, "p1", "p4", 1000.0, 1000.0, 0.0, 0.0, 0.5)]
    got = [tuple(r) for r in layered(spark, [*rows[:3], ("a", 9, day(2024, 1, 3), 5_000, "IN", "P4")]).orderBy("out_row").collect()]
    assert got == [("a", 1, 2, "p1", "p2", 4000.0, 4137.93, 137.93, 3.33, 0.5), ("a", 1, 3, "p1", "p3", 25000.0, 25862.07, 862.07, 3.33, 0.5)]


def allocated(rows, days):
    """Inflow by inflow over all outflows of an account, as the rule says it."""
    rows = sorted((r for r in rows if r[5] and not (r[4] == "OUT" and r[5].lower() == "me")), key=lambda r: (r[0], r[2], r[1]))
    left, found = {i: round(r[3] * 100) for i, r in enumerate(rows) if r[4] == "OUT"}, []
    for i, r in enumerate(rows):
        need = round(r[3] * 100) if r[4] == "IN" else 0
        for j in range(i + 1, len(rows)):
            o = rows[j]
            if need and o[4] == "OUT" and o[0] == r[0] and left[j] and o[5].lower() != r[5].lower() and (not days or (o[2] - r[2]).total_seconds() <= days * 86400):
                part = min(need, left[j])
                need, left[j] = need - part, left[j] - part
                found.append((r[0], r[1], o[1], part / 100))
    return sorted(found)


@pytest.mark.parametrize(("days", "step"), [(3, 7), (1, 30), (0, 20)])
def test_allocation_equals_brute_force(spark, days, step):
    r = random.Random(days + step)
    rows, ts = [], day(2024, 1, 1)
    for i in range(300):
        ts += dt.timedelta(hours=r.choice((0, 0, 1, step, 120 if r.random() < 0.05 else 2)))
        rows.append((r.choice("ab"), i, ts, r.randint(1000, 9000) + r.choice((0, 0.37)), r.choice(("IN", "OUT")), r.choice(("P", "q", "R", "me", None, ""))))
    got = layered(spark, rows, days=days)
    assert sorted((x.k, x.in_row, x.out_row, x.forwarded) for x in got.withColumnRenamed("account", "k").collect()) == allocated(rows, days)
    value = {x[1]: round(x[3] * 100) for x in rows}
    for x in got.groupBy("in_row").agg(F.sum(F.round(F.col("dispatched") * 100)).alias("s")).collect():
        assert x.s == value[x.in_row]


def test_allocation_keeps_to_amounts(spark):
    got = registry.rapid_layering(spark, SF).groupBy("out_row").agg(F.sum("forwarded").alias("s"))
    flow = registry.views.flow(spark, SF).select(F.col("event_id").alias("out_row"), "amount")
    assert got.count() > 0 and got.join(flow, "out_row").filter("s > amount + 0.005").count() == 0


def test_one_account_with_most_rows(spark):
    """An account with 60,000 rows in one unbroken chain is worked through as a stream."""
    leg = F.when(F.col("id") % 2 == 0, "IN").otherwise("OUT")
    rows = spark.range(60_000).select(F.lit("a").alias("k"), "id", F.timestamp_seconds(F.col("id") * 600).alias("ts"), (1000.0 + F.col("id") % 7).alias("amount"), leg.alias("leg"), F.concat(F.lit("p"), F.col("id") % 5).alias("party"))
    got = trail.rapid_layering(rows, "k", "ts", "amount", "leg", "party", "id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("in_row").alias("ins")).first()
    assert got.ins >= 29_000 and got.n < 120_000


@pytest.mark.parametrize(
    ("legs", "want"),
    [([("IN", 0, 100), ("OUT", 1, 90)], "1-to-1 Pass-Through"), ([("IN", 0, 50), ("IN", 0, 50), ("OUT", 2, 90)], "Merged Funds"), ([("IN", 0, 100), ("OUT", 0, 40), ("OUT", 1, 45)], "Split Funds"),
     ([("IN", 0, 60), ("IN", 0, 40), ("OUT", 0, 40), ("OUT", 1, 45)], "Merged & Split Funds"), ([("IN", 0, 100), ("OUT", 3, 90)], None), ([("IN", 0, 100), ("OUT", 1, 70)], None), ([("IN", 0, 100), ("OUT", 1, 1700)], None)],
)
def test_pass_through(spark, legs, want):
    rows = [("a", i, day(2024, 1, 1 + d), c * 1000.0, leg, "P", "Me") for i, (leg, d, c) in enumerate(legs)]
    got = trail.pass_through(spark.createDataFrame(rows, FLOW), "k", "ts", "amount", "leg", "party", ["id"]).collect()
    if want:
        assert [(r.pattern, r.note, r.day) for r in got] == [(want, None, "2024-01-01")]
    notes = {70: "On 2024-01-01, received ₹100,000.00 from P, but only passed ₹70,000.00 (70.0%) within 3 days.", 1700: "On 2024-01-01, received ₹100,000.00, but passed out significantly more: ₹1,700,000.00 within 3 days."}
    if not want:
        assert [(r.pattern, r.note) for r in got] == ([(None, notes[legs[1][2]])] if legs[1][2] in notes else [])


def test_pass_through_equals_brute_force(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), i, day(2024, 1, 1) + dt.timedelta(hours=r.randrange(24 * 60)), float(r.choice((1000, 2000, 2500, 900))), r.choice(("IN", "OUT")), "P", "Me") for i in range(160)]
    want = []
    for k in "ab":
        outs = {(x[1], x[2].date()): x[3] for x in rows if x[0] == k and x[4] == "OUT" and x[3] >= 1000}
        for date in sorted({x[2].date() for x in rows if x[0] == k and x[4] == "IN" and x[3] >= 1000}):
            ins = [x[3] for x in rows if x[0] == k and x[4] == "IN" and x[2].date() == date and x[3] >= 1000]
            near = {key: v for key, v in outs.items() if 0 <= (key[1] - date).days <= 2}
            if 0.8 * sum(ins) <= sum(near.values()) <= sum(ins):
                want.append((k, str(date), sum(ins), sum(near.values())))
                outs = {key: v for key, v in outs.items() if key not in near}
    got = trail.pass_through(spark.createDataFrame(rows, FLOW), "k", "ts", "amount", "leg", "party", ["id"]).filter("pattern is not null")
    assert sorted((x.account, x.day, x.total_in, x.total_out) for x in got.collect()) == sorted(want) and want


def test_kickbacks_by_hand(spark):
    d = day(2024, 1, 1)
    rows = [("a", 1, d, 5000.0, "OUT", "Acme Traders", "Me"), ("a", 2, day(2024, 1, 2), 4000.0, "IN", "acme", "Me"), ("a", 3, day(2024, 1, 3), 9000.0, "IN", "ACME TRADERS", "Me"), ("a", 4, d, 5000.0, "IN", "Me", "Me"),
            ("a", 5, d, 5000.0, "OUT", "Zed", "Me"), ("a", 6, d, 5000.0, "IN", "ze", "Me"), ("a", 7, day(2024, 1, 9), 5000.0, "IN", "acme", "Me"), ("a", 8, d, 5000.0, "OUT", None, "Me"), ("a", 9, d, 5000.0, "IN", "", "Me")]
    df = spark.createDataFrame(rows, FLOW)
    got = trail.kickbacks(df.filter("leg = 'OUT'"), df.filter("leg = 'IN'"), "k", "ts", "amount", "id", "party", 3, holder="holder").collect()
    assert sorted((r.out_row, r.in_row, r.retained, r.retained_pct, r.gap_hours) for r in got) == [(1, 2, 1000.0, 20.0, 24.0), (1, 3, 0.0, 0.0, 48.0)]
    assert trail.kickbacks(df.filter("leg = 'OUT'"), df.filter("leg = 'IN'"), "k", "ts", "amount", "id", "party", 0, holder="holder").count() == 3


def test_fallback_match_by_hand(spark):
    schema = "person string, day string, amount double, said string, vpa string, row int"
    debits = spark.createDataFrame([("Mr. Ravi Kumar", "d1", 10.0, "paid to shyam/upi", "ravi@x", 1), ("Ravi", "d1", 20.0, "nothing", "ravi@x", 2), ("Ravi", "d2", 30.0, "gone", None, 3), ("Ravi", "d1", 40.0, "to Shyam", None, 4)], schema)
    credits = spark.createDataFrame([("Shyam", "d1", 10.0, "", "s@y", 11), ("Shyam", "d1", 20.0, "from RAVI@X", "s@y", 12), ("Shyam", "d2", 30.0, "by Mr", None, 13), ("Shyam", "d1", 40.0, "", None, 14), ("Mr. Ravi Kumar", "d1", 10.0, "shyam", None, 15)], schema)
    got = trail.match_fallback(debits, credits, "person", "day", "amount", "said", "row", "vpa")
    assert sorted((r.debit_row, r.credit_row) for r in got.collect()) == [(1, 11), (2, 12), (4, 14)]
    left = trail.match_fallback(debits, credits, "person", "day", "amount", "said", "row", "vpa", matched=spark.createDataFrame([(4, 14)], "debit_row int, credit_row int"))
    assert sorted((r.debit_row, r.credit_row) for r in left.collect()) == [(1, 11), (2, 12)]


def test_case_story_by_hand(spark):
    direct = spark.createDataFrame([(1, 1, "A", "B", 100.0, "2024-01-05"), (1, 2, "b", "A", 40.5, "2024-01-09"), (2, 3, "Q", "R", 1.0, None)], "case int, row int, sender string, recipient string, amount double, date string")
    hops = spark.createDataFrame([(1, 1, "A", "Z", "C", "2024-01-01", "2024-01-02", 60.0, 50.0, 10.0), (1, 2, "A ", "Z", "D", "2024-01-01", "", 30.0, 29.5, 0.5)], "case int, row int, sender string, conduit string, recipient string, out_date string, in_date string, outflow double, inflow double, retained double")
    loops = spark.createDataFrame([(1, 1, "a", "B", 40.0, "2024-01-09"), (1, 2, "A", "D", 5.0, "2024-02-01"), (1, 3, "A", "D", 5.0, "-")], "case int, row int, originator string, counterparty string, amount double, date string")
    got = [(r.case, r.n, r.edge_id, r.kind, r.title, r.amount, r.cumulative) for r in trail.case_story(direct, hops, loops).orderBy("case", "n").collect()]
    assert got == [
        (1, 1, "L1", "hop", "A → Z", 90.0, 0.0), (1, 2, "L2", "hop", "Z → C", 50.0, 10.0), (1, 3, "L3", "direct", "A → B", 100.0, 10.0), (1, 4, "L4", "return", "Loop Return: B → a", 40.5, 10.0),
        (1, 5, "L5", "return", "Loop Return: D → A", 5.0, 10.0), (1, 6, "L6", "hop", "Z → D", 29.5, 10.5), (1, 7, "", "summary", "Case Position: Full Topology Reconciled", 0.0, 10.5),
        (2, 1, "L1", "direct", "Q → R", 1.0, 0.0), (2, 2, "", "summary", "Case Position: Full Topology Reconciled", 0.0, 0.0),
    ]


def test_cycle_metrics_by_hand(spark):
    cycles = spark.createDataFrame([("c1", ["A", "B", "C"])], "cycle string, nodes array<string>")
    direct = spark.createDataFrame([("A", "B", 100.0, "2024-01-02"), ("A", "B", 50.0, "2024-01-05"), ("C", "A", 30.0, "2024-02-01"), ("X", "Y", 1.0, "2024-01-01")], "sender string, recipient string, amount double, date string")
    hops = spark.createDataFrame([("A", "B", "Z", 10.0, 8.0, "2024-01-01", "2024-01-03"), ("B", "C", "W", 90.0, 80.5, "2024-01-07", "2024-01-08")], "sender string, recipient string, conduit string, outflow double, inflow double, out_date string, in_date string")
    legs = trail.cycle_metrics(cycles, "nodes", direct, hops)
    assert [tuple(r) for r in legs.orderBy("leg").collect()] == [
        ("c1", 1, "A", "B", 160.0, 158.0, 2.0, "Z", "2024-01-01", "2024-01-05"), ("c1", 2, "B", "C", 90.0, 80.5, 9.5, "W", "2024-01-07", "2024-01-08"), ("c1", 3, "C", "A", 30.0, 30.0, 0.0, "Direct Banking", "2024-02-01", "2024-02-01"),
    ]
    assert [tuple(r) for r in trail.cycle_totals(legs).collect()] == [("c1", 160.0, "2024-01-01", 30.0, "2024-02-01", 11.5)]


def test_conduits_by_hand(spark):
    rows = [("x", 1, day(2024, 1, 1), 100000.0, "IN"), ("x", 2, day(2024, 1, 3), 95000.0, "OUT"), ("x", 3, day(2024, 1, 9), 5.0, "OUT"), ("y", 4, day(2024, 1, 2), 10.0, "OUT"), ("y", 5, day(2024, 1, 2), 20.0, "IN")]
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp, amount double, leg string")
    got = trail.conduits(df.filter("leg = 'IN'"), df.filter("leg = 'OUT'"), "k", "ts", "amount", "id").collect()
    assert sorted((r.in_row, r.out_row, r.retained, r.retained_pct, r.gap_seconds, r.tier) for r in got) == [(1, 2, 5000.0, 5.0, 172800, "DELAYED"), (5, 4, 10.0, 50.0, 0, "RAPID_LAYERING")]
    assert trail.conduits(df.filter("leg = 'IN'"), df.filter("leg = 'OUT'"), "k", "ts", "amount", "id", days=0).count() == 3


def test_chat_screening(spark):
    df = spark.createDataFrame([("Give me CASH, no cashier",), ("delete it and clear chat",), ("hello",), (None,)], "t string")
    got = [(r.risk_score, r.flagged) for r in screening.chat(df, "t").collect()]
    assert got == [(70, "cash"), (100, "delete,clear chat"), (0, ""), (0, "")]


def test_voice_intent_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a kickback and a bribe",), ("burn this, hawala",), ("what",)], "t string")
    assert [(r.intent, r.risk, r.hits) for r in screening.voice_intent(df, "t").collect()] == [("Collusion", 95, 2), ("Collusion", 90, 2), ("General", 0, 0)]


def test_scan_and_fuzzy(spark):
    df = spark.createDataFrame([(1, "/temp/salary.txt", "no secret here"), (2, "/x", None)], "id int, path string, body string")
    got = {(r.keyword, r.match_type, r.risk) for r in screening.scan(df, "id", "path", "body", ["secret", "salary"]).collect()}
    assert got == {("secret", "CONTENT", 99), ("salary", "NAME", 75)}
    names = spark.createDataFrame([("red widgett",), ("Wid-get",), ("bolt",)], "n string")
    assert [(r.n, r.fuzzy_score) for r in screening.fuzzy(names, "n", ["widget"]).orderBy("n").collect()] == [("Wid-get", 100), ("red widgett", 100)]


def test_authenticity(spark):
    now = day(2025, 1, 1)
    rows = [(day(2024, 6, 30), day(2024, 5, 30), "Photoshop 1", 2), (day(2024, 6, 1), day(2024, 6, 1), "Writer", 0), (None, None, None, None)]
    got = screening.authenticity(spark.createDataFrame(rows, "c timestamp, m timestamp, s string, u int"), "c", "m", "s", "u", F.lit(now)).collect()
    assert [(r.score, r.level) for r in got] == [(0, "HIGH_RISK_TAMPERED"), (100, "AUTHENTIC"), (75, "SUSPICIOUS")]


def test_cases_by_hand(spark):
    raw = spark.createDataFrame([(1, '["Cash", " cash ", "Gift"]'), (2, "a, A ,b,"), (3, None)], "id int, raw string")
    assert {r.id: r.keywords for r in cases.normalise_keywords(raw, "id", "raw").collect()} == {1: ["Cash", "Gift"], 2: ["a", "b"], 3: []}
    profiles = spark.createDataFrame([(1, ["Cash"]), (2, None)], "id int, keywords array<string>")
    new = spark.createDataFrame([(1, "CASH"), (1, "gift"), (2, "x")], "id int, keyword string")
    assert {r.id: r.keywords for r in cases.add_keywords(profiles, new, "id").collect()} == {1: ["Cash", "gift"], 2: ["x"]}
    texts = [("kw", "Employee: P One (12) | Nominee: P Two | Relationship: Wife"), ("kw", "Name: P | Department: Stores"), ("kw", "Point of contact: Mark Lee"), ("P Two", "wife of Arun Das"), ("kw", None)]
    got = cases.infer(spark.createDataFrame(texts, "k string, s string"), "k", "s").collect()
    assert [(r.category, r.inference) for r in got] == [("KINSHIP", "P Two is Wife of P One"), ("EMPLOYMENT", "P, Stores"), ("VENDOR", "Contact: Mark Lee"), ("KINSHIP", "P Two is wife of Arun Das"), ("", "")]


@pytest.mark.parametrize(
    ("narration", "want"),
    [("UPI/428912/john.doe@okaxis/pay", "JOHN DOE"), ("NEFT/N123456/ABC LOGISTICS CORP/HDFC0001234", "ABC LOGISTICS CORP"), ("POS-RESTAURANT 1234 GREEN", "RESTAURANT GREEN"), ("", "Internal Transfer"),
     ("UPI/1/99887@bank/Mark Lee", "MARK LEE"), ("IMPS 1234 TO SOME BODY ELSE HERE", "TO SOME BODY"), ("123 / 456", "Other Account Operations")],
)
def test_tracking_names(spark, narration, want):
    assert one(spark, naming.tracking_name(F.col("n")), n=narration) == want


def test_parties(spark):
    rows = spark.createDataFrame([("OPENING BALANCE", "x"), ("-/Acme Pvt Ltd/", "UPI"), ("SAL", "SAL/Good House/Jan"), (None, None)], "p string, n string")
    got = rows.select(naming.is_balance_marker(F.col("p"), F.col("n")).alias("m"), naming.counterparty(F.col("p"), F.col("n")).alias("c")).collect()
    assert [(r.m, r.c) for r in got] == [(True, "OPENING BALANCE"), (False, "Acme Pvt Ltd"), (False, "Good House"), (False, "Unknown Counterparty")]


def test_grid_by_hand(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(10)], "id int, v double")
    got = grid.page_of(rows, [F.desc("v"), F.asc("id")], 2, 4).collect()
    assert [(r.id, r.row, r.total, r.last_page, r.page) for r in got] == [(4, 5, 10, 3, 2), (7, 6, 10, 3, 2), (0, 7, 10, 3, 2), (3, 8, 10, 3, 2)]
    assert grid.page_of(rows.limit(0), [F.asc("id")], 1, 4).collect() == []
    paths = spark.createDataFrame([("C:\\Windows\\a.txt",), ("C:/x/.git/b",), ("c:/x/c.DLL",), ("c:/x/d.txt",)], "p string")
    assert [r.x for r in paths.select(grid.excluded_path("p", ["c:/windows"], [".git"], [".dll"]).alias("x")).collect()] == [True, True, True, False]


EDGES = [("A", "B", 5.0, 1), ("B", "C", 4.0, 2), ("C", "A", 3.0, 1), ("B", "A", 9.0, 3), ("C", "D", 1.0, 1)]


def test_graph_by_hand(spark):
    e = spark.createDataFrame(EDGES, "s string, d string, w double, n int")
    assert {tuple(r) for r in graph.neighbourhood(e, "s", "d", "D", 2).collect()} == {("D", 0), ("C", 1), ("A", 2), ("B", 2)}
    assert {tuple(r) for r in graph.paths(e, "s", "d", "A", "D", 4).collect()} == {("A>B>C>D", 3)}
    assert {tuple(r) for r in graph.cycles(e, "s", "d").collect()} == {("A,B", "A>B", 2), ("A,B,C", "A>B>C", 3)}
    merged = {(r.a, r.b): (r.dominant, r.weight, r.evidence, r.both_ways) for r in graph.merge_parallel(e, "s", "d", "w", "n").collect()}
    assert merged["A", "B"] == ("B>A", 14.0, 4, True) and merged["C", "D"] == ("C>D", 1.0, 1, False)
    assert graph.unordered_pairs(e, "s", "d").first().pairs == 4


def test_resolution(spark):
    names = ["ABC Traders Pvt Ltd", "ABC Trader", "ABC Traders", "Other Inc", ""]
    got = {r.id: r.entity for r in graph.resolve(spark.createDataFrame(list(enumerate(names)), "id int, name string"), "id", "name").collect()}
    assert got[0] == got[1] == got[2] == "ABC TRADER" and got[3] == "OTHER" and got[4] == ""


def test_evidence_counts_once(spark):
    rows = [("a", "b", 1, 2.0, 5), ("a", "b", 1, 2.0, 7), ("a", "b", 2, 1.0, 1)]
    got = graph.upsert_edges(spark.createDataFrame(rows, "s string, d string, ev int, w double, c int"), ["s", "d"], "ev", "w", "c").collect()
    assert [tuple(r) for r in got] == [("a", "b", 3.0, 7, 2)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("percent", [85, 70])
def test_similar_pairs_lose_none(spark, percent):
    """Names that differ anywhere, in the first letters too, and in length."""
    r = random.Random(percent)
    words = ["ACMETRADERS", "NORTHMOTORS", "ZEDCO", "AB", "A", "VERYLONGNAMEOFAFIRMINTHEEAST"]
    names = set(words)
    for _ in range(110):
        w = list(r.choice(words))
        for _ in range(r.randint(1, 5)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.choice((0, 1))] = r.choice(("", "X", "A", "QQ"))
        names.add("".join(w))
    names = sorted(n for n in names if n)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 200 * lcs(a, b) >= percent * (len(a) + len(b))}
    got = linking.similar_pairs(spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "k string"), "k", percent)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 40


def test_resolution_of_other_first_letters_and_chains(spark):
    rows = [(1, "Bcme Traders"), (2, "Acme Traders Ltd"), (3, "Acme Tradersx"), (4, "Acme Traderxx"), (5, "Zed"), (6, "..."), (7, None)]
    got = {x.id: x.entity for x in graph.resolve(spark.createDataFrame(rows, "id int, name string"), "id", "name").collect()}
    assert got == {1: "ACME TRADERS", 2: "ACME TRADERS", 3: "ACME TRADERS", 4: "ACME TRADERS", 5: "ZED", 6: "", 7: None}


def test_alerts_by_hand(spark):
    who = spark.createDataFrame([(1, "Eve", "EMPLOYEE", True, 10), (2, "Vend", "VENDOR", False, 0), (3, "Sub", "COMPANY", False, 99)], "id int, name string, type string, target boolean, risk int")
    links = spark.createDataFrame([(1, 2, "EMAILED", "mail", 0.0, False), (3, 1, "SPOUSE", "chat", 0.0, False), (2, 1, "TRANSFERRED_FUNDS", "bank", 600_000.0, None)], "src int, dst int, relation string, module string, weight double, layering boolean")
    known = spark.createDataFrame([(" sub",), ("nobody",)], "name string")
    found = graph.alerts(who, links, known)
    want = {(1, "Multi-Tool Cross Correlation: Eve", "HIGH", 85, None), (1, "Employee-Vendor Nexus: Eve <-> Vend", "CRITICAL", 95, "2"), (1, "Nexus with Substantiated Target: Eve <->  sub", "CRITICAL", 95, "3")}
    assert {tuple(r) for r in found.collect()} == want
    seen = spark.createDataFrame([(1, "Employee-Vendor Nexus: Eve <-> Vend")], "entity int, title string")
    assert graph.alerts(who, links, known, acknowledged=seen).count() == 2
    assert {tuple(r) for r in graph.raised_risk(who, links, found).collect()} == {(1, 95), (2, 60), (3, 99)}


def test_names_with_speakers_and_pages(spark):
    df = spark.createDataFrame([("d", 1, "Mr. Ravi, came", ["Anita Rao"]), ("d", 2, "again Mr. Ravi, spoke", None), ("e", 1, None, None), ("e", 2, "", [])], "doc string, page int, t string, who array<string>")
    got = entities.names_of(df.filter("page = 1"), "doc", "t", extra=[entities.Known(F.col("who"), "PERSON", "Speaker", 0.95)]).collect()
    assert {(r.doc, r.name, r.role, r.confidence) for r in got} == {("d", "Ravi", "Identified Individual", 0.9), ("d", "Anita Rao", "Speaker", 0.95)}
    assert [(r.doc, r.name, r.mentions, list(r.pages)) for r in entities.citations(df, "doc", "page", "t").collect()] == [("d", "Ravi", 2, [1, 2])]


def test_addresses_in_long_runs(spark):
    """Runs of letters without an address are read once; addresses that touch are all found."""
    df = spark.createDataFrame([("a" * 300_000 + " x@y.com a@b.co_m@c.de " + "1" * 300_000 + " 5 lakhs",)], "t string")
    assert df.select(screening.addresses(df, "t").alias("a")).first().a == ["x@y.com", "a@b.co", "_m@c.de"]
    assert screening.mail_checkpoints(df, "t").first().is_currency


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)) or hasattr(v, "dtype") and v.dtype == bool:
        return str(v)
    return round(float(v), 6) if isinstance(v, (int, float, Decimal)) or hasattr(v, "dtype") else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registry(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]
