"""Vendors by any attribute and the evidence ledger, on small tables with odd rows."""

from casefile.operators import crossref, evidence
from casefile.session import work_dir
from pyspark.sql import functions as F


def test_contained_equals_comparing_all(spark):
    texts = ["abcabc", "xxabcd", "ab", "", None, "zzzzz", "cab", "a.c", "ABC"]
    needles = ["abc", "cab", "bcd", "zzz", "zz", None, "", "a.c", "abcabcabc", "abcabc"]
    t, n = spark.createDataFrame([(x,) for x in texts + texts[:2]], "text string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {tuple(r) for r in crossref.contained(t, n, 3).collect()}
    assert got == {(a, b) for a in texts for b in needles if a and b and len(b) >= 3 and b in a}
    assert crossref.contained(t.limit(0), n, 3).count() == 0 and crossref.contained(t, n.limit(0), 3).count() == 0


def test_vendor_attributes(spark):
    rows = spark.createDataFrame(
        [(1, "ACME Traders", "UPI/V-7/12"), (2, "x", "to 00 12345-67 ok"), (3, "V-7 paid", None), (4, None, None), (5, "owner mira", "ref 99 88877")], "id long, party string, narration string"
    ).selectExpr("*", "1 AS row", "2 AS text", "3 AS vendor")
    vendors = spark.createDataFrame([("a", "12 345 67", "v-7", "acme", "Mira", "+88 877"), ("b", None, "", "ac", None, "123"), ("c", "", None, None, "", None)], "vid string, bank string, code string, name string, owner string, phone string")
    got = {(r["id"], r["vid"]): r["attributes"] for r in crossref.vendor_matches(rows, "id", "party", "narration", vendors, "vid").collect()}
    assert got == {(1, "a"): "Code: v-7, Name: acme", (2, "a"): "Bank A/C: 12 345 67", (3, "a"): "Code: v-7", (5, "a"): "Owner: Mira, Phone: +88 877"}


def test_vendor_profiles(spark):
    vendors = spark.createDataFrame([("a", "Acme Steel", "v7", "Mira Sen", "m@acme.in", "98 765 432", "AC 55555"), ("b", None, None, None, None, None, None)], "vid string, name string, code string, owner string, email string, phone string, bank string")
    profiles = spark.createDataFrame([(1, "acme", ["V7", "x"]), (2, "Dr Mira Sen", None), (3, "Zed", ["call 98765432 now", "acct 0155555 9", "ACME.in"]), (4, None, [None, ""])], "pid long, name string, keywords array<string>")
    got = {r["pid"]: r["terms"] for r in crossref.vendor_profiles(vendors, "vid", profiles, "pid").collect()}
    assert got == {2: "Owner: Mira Sen", 3: "Bank A/C: acct 0155555 9, Email: m@acme.in, Phone: 98 765 432", 1: "acme"}


FOUND = "src long, dst long, relation string, module string, evidence_id string, weight double, confidence double"


def test_a_repeated_batch_writes_nothing_and_a_broken_one_is_made_whole(spark, monkeypatch):
    folder = work_dir(spark, "ledger-test")
    one = spark.createDataFrame([(1, 2, "R", "m", "e1", 5.0, 0.5), (1, 2, "R", "m", "e1", 7.0, 0.4), (2, 1, "R", None, "e1", 1.0, None), (3, 4, None, "m", "e2", None, 0.9), (None, 1, "R", "m", "e3", 1.0, 1.0), (1, 2, "R", "m", None, 1.0, 1.0)], FOUND)
    assert evidence.synchronise(spark, folder, one, "b1")["records"] == 3
    assert evidence.synchronise(spark, folder, one, "b1") == {"records": 0, "buckets": 0} == evidence.synchronise(spark, folder, one.limit(0), "b2")
    assert {tuple(r)[:7] for r in evidence.edges_of(spark, folder).collect()} == {(1, 2, "R", "m", 7.0, 0.5, 1), (2, 1, "R", None, 1.0, None, 1), (3, 4, None, "m", None, 0.9, 1)}
    two = spark.createDataFrame([(1, 2, "R", "m", "e9", 3.0, 0.95), (1, 2, "R", "m", "e1", 100.0, 1.0)], FOUND)

    def fails(ledger):
        raise RuntimeError("lost between the two writes")

    monkeypatch.setattr(evidence, "counted", fails)
    try:
        evidence.synchronise(spark, folder, two, "b3")
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert evidence.synchronise(spark, folder, two, "b3") == {"records": 0, "buckets": 1}
    rebuilt = evidence.counted(evidence.ledger_of(spark, folder))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(rebuilt) == key(evidence.edges_of(spark, folder)) and (1, 2, "R", "m", 10.0, 0.95, 2) in {r[:7] for r in key(rebuilt)}


def test_links_that_stand_for_nothing(spark):
    edges = spark.createDataFrame([(1, 5, 6, "R", "q_bank", 4.0), (2, 6, 5, "VOICE_CALL", "q_trail", 9.0), (3, 5, 5, None, None, None)], "edge_id long, src long, dst long, relation string, module string, weight double")
    wanted = spark.createDataFrame([("1,2, 1",), ("kw__6__5",), ("kw__x__5",), ("",), ("zz",), (None,), ("kw__5__5__k",), ("ext__7",)], "link string")
    assert {tuple(r) for r in evidence.edges_meant(wanted, edges).collect()} == {("1,2, 1", 1), ("1,2, 1", 2), ("kw__6__5", 1), ("kw__6__5", 2), ("kw__5__5__k", 3)}
    assert {r["link"]: r["weight"] for r in evidence.link_totals(wanted, edges).collect()} == {"1,2, 1": 9.0, "kw__6__5": 9.0, "kw__5__5__k": 0.0}
    records = spark.createDataFrame([("x", 1, "m", "s", None), ("x", 2, "m", "t", 3.0), ("y", 3, "m", None, None)], "evidence_id string, edge_id long, module string, summary string, amount double").withColumn("weight", F.lit(0))
    got = {(r["link"], r["evidence_id"]): (r["edge_id"], r["category"], r["amount"]) for r in evidence.evidence_of(wanted, edges, records).collect()}
    assert got == {("1,2, 1", "x"): (1, "FINANCIAL", 4.0), ("kw__6__5", "x"): (1, "FINANCIAL", 4.0), ("kw__5__5__k", "y"): (3, "FINANCIAL", None)}
