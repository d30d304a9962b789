"""Faults that show on tables larger than the driver's small ones."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from casefile import session
from casefile.operators import crossref, fuzzynames, graph, records

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "nation", "region")


@pytest.fixture(scope="module")
def spread_keys(tmp_path_factory):
    """The smallest tables with every key of customers, suppliers, parts and orders further apart."""
    d = str(tmp_path_factory.mktemp("keys"))
    far = {"customer": ["c_custkey"], "orders": ["o_custkey"]}
    for t in TABLES:
        cols = ", ".join(f"{c} * 701 AS {c}" for c in far.get(t, []))
        duckdb.sql(f"COPY (SELECT * {f'REPLACE ({cols})' if cols else ''} FROM '{SF}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
    return d


def same_as_sql(spark, name, d):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = queries()[name](spark, d)
    want = db.sql(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) > 0 and sorted(map(repr, got)) == sorted(map(repr, want))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_letter_pairs_stay_off_the_driver(spark, tmp_path):
    spark.createDataFrame([("V", "ACME TRADERS"), ("V", "ACME TRADER")], "cls string, key string").write.parquet(f"{tmp_path}/names")
    df = fuzzynames.similar_names(spark.read.parquet(f"{tmp_path}/names"), 85)
    assert "Broadcast" not in plan_of(df)
    assert [(r["a"], r["b"]) for r in df.collect()] == [("ACME TRADER", "ACME TRADERS")]


def test_pieces_of_names_stay_off_the_driver(spark, tmp_path):
    spark.createDataFrame([(1, "Big Customer#0012", ["x", "Audit "]), (2, "zed", ["ab"]), (3, "none", None)], "profile_id long, name string, keywords array<string>").write.parquet(f"{tmp_path}/profiles")
    words = spark.createDataFrame([("AUDIT",), (" 0012",), ("zed",), ("ab",)], "keyword string")
    df = records.vault_matches(spark.read.parquet(f"{tmp_path}/profiles"), words)
    assert "Broadcast" not in plan_of(df)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "Big Customer#0012", "audit"), (2, "zed", "zed")]


def test_document_numbers_are_not_customers(spark, spread_keys):
    assert duckdb.sql(f"SELECT count(*) FROM '{spread_keys}/customer.parquet' WHERE c_custkey BETWEEN 100000 AND 100399").fetchall()[0][0]
    same_as_sql(spark, "document_bridges", spread_keys)


def test_sets_of_keywords_open_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 2)
    rows = [(i, ["aaa", "bbb"] if i % 2 else ["bbb", "aaa", "aaa", "zz", None]) for i in range(7)] + [(7, ["bbb", "ccc"]), (8, ["ccc"]), (9, None), (8, ["ddd", "aaa"])]
    df = graph.keyword_nexus(spark.createDataFrame(rows, "id long, words array<string>"), "id", "words")
    held = {i: {k for j, ks in rows if i == j for k in ks or [] if k and len(k) >= 3} for i, _ in rows}
    want = {(a, b): ",".join(sorted(held[a] & held[b])) for a in held for b in held if a < b and held[a] & held[b]}
    assert {(r["a"], r["b"]): r["keywords"] for r in df.collect()} == want and df.count() == len(want)
    assert all(r["shared"] == len(r["keywords"].split(",")) for r in df.collect())
    # Nothing is shuffled once pairs are opened.
    assert "Exchange" not in plan_of(df).split("explode(y_ids")[0].rsplit("explode(x_ids", 1)[0]


@pytest.mark.parametrize("sent", [6_000_000, 0])
def test_blocks_of_ids_are_not_shuffled_for_each_pair_of_sets(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "IDS_SENT", sent)
    monkeypatch.setattr(graph, "MEMBERS", 2)
    rows = [(i, [f"k{i % 3}x", "all"]) for i in range(9)]
    df = graph.keyword_nexus(spark.createDataFrame(rows, "id long, words array<string>"), "id", "words")
    assert sorted((r["a"], r["b"], r["shared"]) for r in df.collect()) == [(a, b, 2 if a % 3 == b % 3 else 1) for a in range(9) for b in range(a + 1, 9)]
    # Pairs of sets are dealt out by their names and blocks; ids come after that.
    final = plan_of(df).split("== Initial Plan ==")[-1]
    above = final[: final.index("REPARTITION_BY_NUM")]
    assert ("Sort" in above) == (sent == 0)


def test_vendors_meet_without_shuffling_pairs(spark):
    rows = spark.createDataFrame([(1, "Acme", "pay 12345678 to Acme ACME/x"), (2, None, "tel 987654321"), (3, "zz", None)], "id long, party string, narration string")
    vendors = spark.createDataFrame([(7, "A/C 2345678", "acme", " Acme", "pay", "+98 76543"), (8, None, None, "zz9", "tel", "9876"), (9, "12345", "", "ac", None, "87-654")], "vid long, bank string, code string, name string, owner string, phone string")
    df = crossref.vendor_matches(rows, "id", "party", "narration", vendors, "vid")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 7, "Bank A/C: A/C 2345678, Code: acme, Name:  Acme, Owner: pay"), (1, 9, "Bank A/C: 12345"), (2, 7, "Phone: +98 76543"), (2, 8, "Owner: tel"), (2, 9, "Phone: 87-654")]
    assert "Aggregate" not in plan_of(df)


def test_pairs_are_not_shuffled_to_many_vendors(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if vendors were more than Spark sends by itself
    try:
        rows = spark.createDataFrame([(1, "Acme", "pay 12345678 to Acme ACME/x acme")], "id long, party string, narration string")
        vendors = spark.createDataFrame([(7, "A/C 2345678", "acme", " Acme", "pay", "+98 76543")], "vid long, bank string, code string, name string, owner string, phone string")
        df = crossref.vendor_matches(rows, "id", "party", "narration", vendors, "vid")
        assert "Exchange" not in plan_of(df).replace("BroadcastExchange", "") and df.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vendors_that_share_an_attribute_are_counted_once(spark, monkeypatch):
    vendors = spark.createDataFrame([(i, f"7654{i}", "x1", None, "mira" if i % 2 else None, "55 555") for i in range(4)] + [(9, None, None, None, "ed", "55555"), (8, None, "x1", "ravi", None, None)], "vid long, bank string, code string, name string, owner string, phone string")
    rows = spark.createDataFrame([(1, "P", "tel 55555 5555", 1.0), (2, "P", "a/c 76541 55555 mira", 2.0), (3, "P", "MIRA x1", 4.0), (4, None, "76540", 8.0), (5, "P", "x1 ravi ravi", 16.0)], "id long, party string, narration string, amount double")
    met = []
    original = crossref.vendor_met
    monkeypatch.setattr(crossref, "vendor_met", lambda *given: met.append(original(*given)) or met[-1])
    df = crossref.vendor_flows(rows, "id", "party", "party", "narration", F.lit("IN"), F.col("amount"), vendors, "vid")
    got = {(r["person"], r["vid"]): (r["n"], float(r["volume"]), r["attributes"]) for r in df.collect()}
    code, phone, owner = "Code: x1", "Phone: 55 555", "Owner: mira"
    want = {("P", 0): (4, 23.0, f"{code}, {phone}"), ("P", 1): (4, 23.0, f"Bank A/C: 76541, {code}, {owner}, {phone}"), ("P", 2): (4, 23.0, f"{code}, {phone}"), ("P", 3): (4, 23.0, f"{code}, {owner}, {phone}"), ("P", 9): (2, 3.0, "Phone: 55555"), ("P", 8): (2, 20.0, f"{code}, Name: ravi"), (None, 0): (1, 8.0, "Bank A/C: 76540")}
    assert got == want
    # The code and the telephone number of four vendors meet a transaction once, for all that have it as their main attribute.
    shared = met[0][0].filter("vendor IS NULL").count()
    assert 0 < shared <= 5


def test_profiles_of_one_set_of_keywords_meet_vendors_once(spark):
    vendors = spark.createDataFrame([(1, "Acme Ltd", "c1", "ravi", "a@acme.com", "123456", "999999"), (2, "Zed", "zed", "someone", None, None, None)], "vid long, name string, code string, owner string, email string, phone string, bank string")
    profiles = spark.createDataFrame([(1, "Acme", ["acme", " ZED "]), (2, "nobody", ["zed", "Acme", "acme"]), (3, None, ["tel 23456"]), (4, "zed", None), (5, "zed", ["zz"])], "pid long, name string, keywords array<string>")
    df = crossref.vendor_profiles(vendors, "vid", profiles, "pid")
    got = {(r["vid"], r["pid"]): r["terms"] for r in df.collect()}
    assert got == {(1, 1): "Acme, Email: a@acme.com, acme", (2, 1): "zed", (1, 2): "Email: a@acme.com, acme", (2, 2): "zed", (1, 3): "Phone: 123456", (2, 4): "zed", (2, 5): "zed"}
    assert "Aggregate" not in "\n".join(plan_of(df).splitlines()[:4])  # pairs are not grouped last


def exchanges_of(df, kind: str) -> list[str]:
    return [x for x in plan_of(df).splitlines() if "Exchange hashpartitioning" in x and kind in x]


@pytest.mark.parametrize("name", ["open_po", "ledger_reader"])
def test_tasks_grow_with_the_tables(spark, monkeypatch, name):
    """Large tables are dealt to as many tasks as their files ask for, not to a number that the session has; results are the same."""
    size = Path(f"{SF}/lineitem.parquet").stat().st_size
    monkeypatch.setattr(session, "SHARE_BYTES", size // 9)
    n = session.shares(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert n in (9, 10) and session.shares(spark.createDataFrame([(1,)], "a int")) == 0
    df = queries()[name](spark, SF)
    dealt = exchanges_of(df, "REPARTITION_BY_NUM")
    assert len([x for x in dealt if f", {n})" in x or f", {n}), " in x]) >= 4
    if name == "open_po":
        assert not exchanges_of(df, "ENSURE_REQUIREMENTS")
    else:
        assert any("G/L acct" in x and "PO" in x for x in dealt) and not [x for x in exchanges_of(df, "ENSURE_REQUIREMENTS") if "PO" in x]
    same_as_sql(spark, name, SF)


def test_small_tables_are_not_dealt_again(spark):
    assert not exchanges_of(queries()["open_po"](spark, SF), "REPARTITION_BY_NUM")
